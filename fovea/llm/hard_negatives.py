"""Hard negatives by a distributed kNN join over a Voronoi partition.

With ``M`` the greatest norm, a candidate x becomes (x, sqrt(M^2 - |x|^2)) and
an anchor q becomes (q, 0): the greater the inner product, the less the
distance, ``|q|^2 + M^2 - 2 q.x``. Pivots divide that space into cells. Anchors
are grouped by cell; from the radius of a group, the scores its anchors still
look for and the hyperplanes between cells follows which candidates it might be
served by. Only those are sent to it, packed in blocks, and a join of blocks by
group gives the exact scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved
from .vectors import EXACT, LONG, floors, matrices, sound

K, SCALE, SHARE = 5, 256, 80
#: Pivots at least and at most; known rows (of least hash) that first bounds come from, at most, and their components.
PIVOTS, SAMPLE, SAMPLE_COMPONENTS = (8, 256), 2048, 1 << 21
#: Labels are dealt to so many parts when rows of one label are looked for; rows of a block; candidates that one salt stands for.
LABEL_PARTS, BLOCK, SALT_ROWS = 16, 1024, 1 << 20
#: Bytes of vectors that a task holds before it packs them.
HELD = 8 << 20

BLOCKS = "pivot int, part int, salt int, ids binary, labels binary, x binary, low binary, goals binary"


def array(x: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(x, kind)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, by BLAS where float64 holds them."""
    reach = q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0))
    if reach < EXACT:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return q @ x.T


@dataclass
class Space:
    """Pivots with their added component, and the greatest squared norm."""

    pivots: np.ndarray
    top: float
    scale: int

    @property
    def slack(self) -> float:
        """More than rounding can amount to in a distance."""
        return 1e-6 * (1 + np.sqrt(self.top))

    @staticmethod
    def of(rows: np.ndarray, top: int, scale: int) -> Space:
        x = rows.astype(float)
        return Space(np.column_stack([x, Space.added(x, top)]), float(top), scale)

    @staticmethod
    def added(x: np.ndarray, top: float) -> np.ndarray:
        return np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Of rows from all pivots."""
        x = np.column_stack([x, np.zeros(len(x)) if anchors else self.added(x, self.top)])
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ self.pivots.T) + (self.pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(d, 0))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of an anchor from a candidate of that score; none is no bound."""
        return np.sqrt(np.maximum((q * q).sum(axis=1) + self.top - 2 * score, 0))


@dataclass
class Bounds:
    """Of each (pivot, part): radius and inner radius of its anchors, greatest and least distance looked for; and of each pair of pivots the least distance of the first's anchors from the hyperplane between them."""

    outer: np.ndarray
    inner: np.ndarray
    far: np.ndarray
    near: np.ndarray
    plane: np.ndarray

    @staticmethod
    def none(p: int, parts: int) -> Bounds:
        shape = (p, parts)
        return Bounds(np.full(shape, -np.inf), np.full(shape, np.inf), np.full(shape, -np.inf), np.full(shape, np.inf), np.full((p, p), np.inf))

    def add(self, space: Space, q: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Take anchors in; returns the pivot of each."""
        d = space.distances(q, True)
        pivot = d.argmin(axis=1)
        own = d[np.arange(len(q)), pivot]
        for at, value, take in ((self.outer, own, np.maximum), (self.inner, own, np.minimum), (self.far, space.reach(q, low), np.maximum), (self.near, space.reach(q, high), np.minimum)):
            take.at(at, (pivot, part), value)
        between = np.sqrt(((space.pivots[:, None] - space.pivots[None]) ** 2).sum(axis=2))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between[pivot] > 0, (d * d - (own * own)[:, None]) / (2 * between[pivot]), 0)
        np.minimum.at(self.plane, pivot, plane)
        return pivot

    def merged(self, other: Bounds) -> Bounds:
        return Bounds(np.maximum(self.outer, other.outer), np.minimum(self.inner, other.inner), np.maximum(self.far, other.far), np.minimum(self.near, other.near), np.minimum(self.plane, other.plane))

    def serves(self, space: Space, x: np.ndarray, part: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(pivot, part, places of the candidates that it might be served by)."""
        d = space.distances(x, False)
        cell = d.argmin(axis=1)
        own = d[np.arange(len(x)), cell]
        between = np.sqrt(((space.pivots[:, None] - space.pivots[None]) ** 2).sum(axis=2))
        for g in range(len(space.pivots)):
            apart = between[g, cell]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, self.plane[g, cell] + (d[:, g] ** 2 - own**2) / (2 * apart), 0)
            for b in range(self.outer.shape[1]):
                if not np.isfinite(self.outer[g, b]):
                    continue
                least = np.maximum(np.maximum(d[:, g] - self.outer[g, b], self.inner[g, b] - d[:, g]), plane)
                most = d[:, g] + self.outer[g, b]
                may = (least <= self.far[g, b] + space.slack) & (most >= self.near[g, b] - space.slack)
                if part is not None:
                    may &= part == b
                if may.any():
                    yield g, b, np.flatnonzero(may)


def held(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches joined up to ``HELD`` bytes of vectors: ids, labels, whole-number rows, then any other columns."""
    waiting, rows = [], 0
    for batch in batches:
        step = max(1, HELD // (8 * max(1, d)))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            waiting.append(part)
            rows += part.num_rows
            if rows >= step:
                yield columns(waiting, d)
                waiting, rows = [], 0
    if rows:
        yield columns(waiting, d)


def columns(batches: list[pa.RecordBatch], d: int) -> tuple[np.ndarray, ...]:
    table = pa.Table.from_batches(batches)
    flat = [c.combine_chunks() for c in table.columns]
    n = table.num_rows
    out = [flat[0].to_numpy(), flat[1].to_numpy(), np.asarray(flat[2].flatten().to_numpy(zero_copy_only=False), float).reshape(n, d)]
    for c in flat[3:]:
        out.append(c.flatten().to_numpy().reshape(n, -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False))
    return tuple(out)


def label_part(labels: np.ndarray, parts: int) -> np.ndarray:
    return (labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts


def anchor_bounds(anchors: DataFrame, space: Space, parts: int, d: int) -> Bounds:
    """Of all anchors (id, label, v, low, high, …); a task gives one row, no more than pivots x (pivots + 4 parts) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Bounds.none(len(space.pivots), parts)
        for _, labels, v, low, high, *_ in held(batches, d):
            found.add(space, floors(v, space.scale), label_part(labels, parts), low, high)
        names = ("outer", "inner", "far", "near", "plane")
        yield pa.RecordBatch.from_arrays([pa.array([getattr(found, n).tobytes()]) for n in names], list(names))

    rows = anchors.mapInArrow(run, "outer binary, inner binary, far binary, near binary, plane binary").rdd
    p = len(space.pivots)

    def read(r) -> Bounds:
        return Bounds(*(array(bytes(r[n]), float).reshape(p, parts) for n in ("outer", "inner", "far", "near")), array(bytes(r["plane"]), float).reshape(p, p))

    return rows.treeAggregate(Bounds.none(p, parts), lambda a, r: a.merged(read(r)), lambda a, b: a.merged(b))


def packed(pivot: int, part: int, salt: int, *values: np.ndarray) -> pa.RecordBatch:
    """One block: ids, labels and rows as longs, low bounds as doubles, goals as longs; the last two empty for candidates."""
    kinds = (np.int64, np.int64, np.int64, np.float64, np.int64)
    cells = [np.zeros(0, kind) if k >= len(values) else values[k].astype(kind) for k, kind in enumerate(kinds)]
    row = [*(pa.array([v], pa.int32()) for v in (pivot, part, salt)), *(pa.array([v.tobytes()], pa.binary()) for v in cells)]
    return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in BLOCKS.split(", ")])


def candidate_blocks(candidates: DataFrame, space: Space, bounds: Bounds, by_label: bool, salts: int, d: int) -> DataFrame:
    """Candidates (id, label, v) copied to the groups they might serve, in blocks that are dealt to salts."""
    parts = bounds.outer.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for ids, labels, v in held(batches, d):
            x = floors(v, space.scale)
            for g, b, at in bounds.serves(space, x, label_part(labels, parts) if by_label else None):
                for k in range(0, len(at), BLOCK):
                    own = at[k : k + BLOCK]
                    turn += 1
                    salt = (int(ids[own[0]]) + turn) % salts
                    yield packed(g, b, salt, ids[own], labels[own], x[own])

    return candidates.mapInArrow(run, BLOCKS)


def anchor_blocks(anchors: DataFrame, space: Space, parts: int, salts: int, d: int) -> DataFrame:
    """Anchors (id, label, v, low, high, goals) by group in blocks, each once for every salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, v, low, _, goals in held(batches, d):
            x, part = floors(v, space.scale), label_part(labels, parts)
            pivot = space.distances(x, True).argmin(axis=1)
            for g, b in np.unique(np.column_stack([pivot, part]), axis=0).tolist():
                at = np.flatnonzero((pivot == g) & (part == b))
                for k in range(0, len(at), BLOCK):
                    own = at[k : k + BLOCK]
                    yield packed(g, b, 0, ids[own], labels[own], x[own], low[own], goals[own])

    return anchors.mapInArrow(run, BLOCKS).drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def best_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: greatest score, then smallest id."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
    nth = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[nth < k]


#: (anchor ids, labels, rows, low bounds, goals, candidate ids, labels, rows) to columns of (anchor, place, candidate, score).
Pick = Callable[..., "tuple[np.ndarray, ...]"]
FOUND = "anchor_id long, place int, other_id long, score long"


def local_join(anchors: DataFrame, candidates: DataFrame, pick: Pick, d: int) -> DataFrame:
    """Blocks of anchors and of candidates that meet in a group, joined exactly, one pair of blocks at a time."""
    left = anchors.select("pivot", "part", "salt", *(F.col(c).alias("a_" + c) for c in ("ids", "labels", "x", "low", "goals")))
    right = candidates.select("pivot", "part", "salt", *(F.col(c).alias("c_" + c) for c in ("ids", "labels", "x")))
    met = left.join(right, ["pivot", "part", "salt"]).drop("pivot", "part", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells = [batch.column(j)[k].as_buffer() for j in range(8)]
                a_ids, a_labels, q, goals, ids, labels, x = (array(cells[j]) for j in (0, 1, 2, 4, 5, 6, 7))
                n, m = len(a_ids), len(ids)
                found = pick(a_ids, a_labels, q.reshape(n, d), array(cells[3], float), goals.reshape(n, -1) if n else goals, ids, labels, x.reshape(m, d))
                anchor, place, other, score = found
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(place.astype(np.int32)), pa.array(other), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")])

    return met.mapInArrow(run, FOUND)


def pick_positives(k: int) -> Pick:
    def pick(a_ids, a_labels, q, low, goals, ids, labels, x):
        scores = product(q, x)
        same = (a_labels[:, None] == labels[None]) & (a_ids[:, None] != ids[None]) & (scores >= low[:, None])
        row, at = np.nonzero(same)
        best = best_of(row, ids[at], scores[row, at], k)
        row, at = row[best], at[best]
        return a_ids[row], np.zeros(len(row)), ids[at], scores[row, at]

    return pick


def pick_negatives(k: int, share: int) -> Pick:
    """``goals`` are the scores of an anchor's positives by place; a negative one has no negatives."""

    def pick(a_ids, a_labels, q, low, goals, ids, labels, x):
        scores = product(q, x)
        other = (a_labels[:, None] != labels[None]) & (a_ids[:, None] != ids[None]) & (scores >= low[:, None])
        out = []
        for place in range(goals.shape[1]):
            goal = goals[:, place, None]
            row, at = np.nonzero(other & (scores <= goal) & (share * goal <= 100 * scores) & (goal >= 0))
            best = best_of(row, ids[at], scores[row, at], k)
            row, at = row[best], at[best]
            out.append((a_ids[row], np.full(len(row), place), ids[at], scores[row, at]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return pick


def first_of(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sizes(rows: DataFrame, scale: int) -> dict[int, tuple[int, int, int]]:
    """{components: (rows, greatest absolute component, greatest squared norm)} of whole-number rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in np.unique(pa.compute.list_value_length(batch.column(0)).to_numpy()).tolist():
                x = floors(matrices(batch.column(0), d)[1], scale)
                told = [[d], [len(x)], [float(np.abs(x).max(initial=0))], [float((x * x).sum(axis=1).max(initial=0))]]
                yield pa.RecordBatch.from_arrays([pa.array(told[0], pa.int32()), pa.array(told[1]), pa.array(told[2]), pa.array(told[3])], ["d", "n", "reach", "top"])

    told = rows.select("v").mapInArrow(run, "d int, n long, reach double, top double").groupBy("d").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), F.max("top").alias("top")).collect()
    for r in told:
        if 100 * max(1, r["d"]) * r["reach"] ** 2 >= LONG:
            raise ValueError("components are too large: a hundred times a score would not fit a long")
    return {r["d"]: (r["n"], int(r["reach"]), int(r["top"])) for r in told}


def mined(own: DataFrame, asked: DataFrame, d: int, n: int, top: int, k: int, scale: int, share: int) -> DataFrame:
    """The negatives of the anchors of ``d`` components."""
    own, asked = own.where(F.size("v") == d), asked.where(F.size("v") == d)
    limit = max(1, min(SAMPLE, SAMPLE_COMPONENTS // max(1, d)))
    known = own.orderBy(F.xxhash64("id"), "id", "label", "v").limit(limit).collect()
    s_ids, s_labels = np.array([r["id"] for r in known], np.int64), np.array([r["label"] for r in known], np.int64)
    s_x = floors(np.array([r["v"] for r in known], float).reshape(len(known), d), scale).astype(np.int64)
    different = np.sort(np.unique(s_x, axis=0, return_index=True)[1]) if d else np.zeros(1, int)
    count = asked.count()
    space = Space.of(s_x[different[: min(PIVOTS[1], max(PIVOTS[0], int(count**0.5)))]], top, scale)
    salts = max(1, min(1024, -(-n // SALT_ROWS)))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor with its k-th best score among the known rows of its label."""
        for batch in batches:
            ids, labels, v = columns([batch], d)
            scores = product(floors(v, scale).astype(np.int64), s_x).astype(float)
            scores[(labels[:, None] != s_labels[None]) | (ids[:, None] == s_ids[None])] = -np.inf
            low = np.partition(scores, len(s_ids) - k, axis=1)[:, len(s_ids) - k] if len(s_ids) >= k else np.full(len(ids), -np.inf)
            high = np.full(len(ids), np.inf)
            goals = pa.array(np.full((len(ids), k), -1).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low - 1e-9 * np.abs(low)), pa.array(high), goals], ["id", "label", "v", "low", "high", "goals"])

    vector = own.schema["v"].dataType.simpleString()
    kind = f"id long, label long, v {vector}, low double, high double, goals array<long>"
    first = saved(asked.select("id", "label", "v").mapInArrow(bounded, kind), "anchors")
    bounds = anchor_bounds(first, space, LABEL_PARTS, d)
    met = local_join(anchor_blocks(first, space, LABEL_PARTS, salts, d), candidate_blocks(own, space, bounds, True, salts, d), pick_positives(k), d)
    positives = saved(first_of(met, k, "anchor_id").select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    goals = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("g"), F.min(F.when(F.col("positive_score") >= 0, F.col("positive_score"))).alias("least"), F.max("positive_score").alias("most"))
    goals = goals.where("most >= 0").select("anchor_id", F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"), F.col("g.positive_score").alias("g"))
    second = first.drop("low", "high", "goals").join(goals, F.col("id") == F.col("anchor_id")).select(
        "id", "label", "v", (F.col("least") * share / 100 * (1 - 1e-9) - 1e-6).alias("low"), (F.col("most") * (1 + 1e-9) + 1e-6).alias("high"),
        F.slice(F.concat("g", F.array_repeat(F.lit(-1).cast("long"), k)), 1, k).alias("goals"),
    )
    second = saved(second, "goals")
    bounds = anchor_bounds(second, space, 1, d)
    met = local_join(anchor_blocks(second, space, 1, salts, d), candidate_blocks(own, space, bounds, False, salts, d), pick_negatives(k, share), d)
    negatives = first_of(met, k, "anchor_id", "place")
    return negatives.join(positives, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchors: DataFrame, k: int = K, scale: int = SCALE, share: int = SHARE) -> DataFrame:
    """For each anchor and each of its ``k`` best partners of its label, the ``k`` best rows of other labels whose score is at least ``share`` percent of the partner's and no more than it.

    Both tables have vec_id, label and embedding; the score is the inner
    product of components ``floor(scale * x)``, ties go to the smaller id. Null
    ids, labels and vectors, and vectors with null or non-finite components
    take no part; rows of an anchor's own id are no partners of it; vectors
    meet those of their own number of components. Repeated rows are rows each;
    of anchors with one id that of least components counts. Other columns,
    whatever their names, are ignored; an empty table on either side gives no
    rows. Components for which a hundred times a score would not fit a long
    fail.

    Bounds come from a bounded sample (its rows, pivots and what the groups
    look for go to every task) and only save work: every candidate that might
    serve a group is sent there. A hot group is no task of its own: its blocks
    are dealt to salts, and a task holds two blocks at a time.
    """
    take = lambda t: t.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & sound(F.col("v")))
    own = take(vectors)
    asked = saved(take(anchors).groupBy("id").agg(F.min(F.struct("v", "label")).alias("r")).select("id", "r.label", "r.v"), "asked")
    wanted = [r["d"] for r in asked.select(F.size("v").alias("d")).distinct().collect()]
    if not wanted:
        return vectors.sparkSession.createDataFrame([], OUT)
    known, seen = sizes(own, scale), sizes(asked, scale)
    parts = [mined(own, asked, d, known[d][0], max(known[d][2], seen[d][2]), k, scale, share) for d in sorted(wanted) if d in known]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], OUT)
