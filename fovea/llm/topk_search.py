"""Exact top-k by inner product: aggregation of sorted lists without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

K, SCALE, QUERY_STEP = 10, 1024, 100
#: Rows of a block of candidates and of a block of queries; bytes of queries that are sent to the tasks at a time.
BLOCK, QUERY_BLOCK, BATCH_BYTES = 4096, 1024, 16 << 20
#: Shares of all entries of a block after which queries look at their bounds; queries that read the lists together.
SHARES, TOGETHER = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1), 32


class SortedLists:
    """One list per dimension over a block of candidates, sorted once by falling distance of the component from the dimension's centre.

    So one list serves weights of either sign, and its front bounds what is
    unread from above and from below. In a turn each list is read on as far as
    its distances are as great as those read in the others (``depths``), until
    a share of all entries is read.
    """

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.d) = x, x.shape
        self.centre = np.round(x.mean(axis=0))  # whole, so that distances are too
        away = (x - self.centre).T
        self.order = np.argsort(-np.abs(away), axis=1, kind="stable")
        self.away = np.take_along_axis(away, self.order, axis=1)
        self.reach = np.abs(self.away[:, 0]) + np.abs(self.centre)
        far = np.abs(self.away)
        levels = np.quantile(far, [1 - s for s in SHARES], method="lower")
        levels[-1] = 0
        self.depths = np.stack([np.zeros(self.d, int), *((far >= v).sum(axis=1) for v in levels)])
        # after each turn: greatest distance that is left in a list, and squared norm of what is left of a candidate
        self.fronts = np.where(self.depths < self.n, np.take_along_axis(far, np.minimum(self.depths.T, self.n - 1), axis=1).T, 0.0)
        left = (away**2).sum(axis=0)
        self.loose = 1e-15 * self.d * left
        self.left = [left]
        for turn in range(len(SHARES)):
            left = left.copy()
            for j, at, part in self.entries(turn):
                left[at] -= part**2
            self.left.append(left)

    def entries(self, turn: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(dimension, candidates, distances) that are read in a turn."""
        for j, (a, z) in enumerate(zip(self.depths[turn].tolist(), self.depths[turn + 1].tolist(), strict=True)):
            if a < z:
                yield j, self.order[j, a:z], self.away[j, a:z]


class Reading:
    """Some queries that read the lists of a block together, and by candidate and query the sums over the entries reached."""

    def __init__(self, queries: np.ndarray, lists: SortedLists):
        self.lists, self.turn = lists, 0
        self.weights = queries.astype(float).T
        self.squares = self.weights**2
        self.known = np.tile(lists.centre @ self.weights, (lists.n, 1))
        self.left = np.tile(self.squares.sum(axis=0), (lists.n, 1))
        self.slack = 1e-9 * (lists.reach @ np.abs(self.weights)) + 1e-6  # more than rounding can amount to
        self.loose = 1e-15 * lists.d * self.squares.sum(axis=0)

    def advance(self) -> None:
        for j, at, away in self.lists.entries(self.turn):
            self.known[at] += away[:, None] * self.weights[j]
            self.left[at] -= self.squares[j]
        self.turn += 1

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores, candidates by queries.

        What is unread weighs no more, either way, than all fronts together,
        and no more than the product of the norms of what is unread of the
        query and of the candidate.
        """
        fronts = self.lists.fronts[self.turn] @ np.abs(self.weights)
        own = np.sqrt(np.maximum(self.lists.left[self.turn], 0) + self.lists.loose)
        rest = np.minimum(np.sqrt(np.maximum(self.left, 0) + self.loose) * own[:, None], fronts) + self.slack
        return self.known - rest, self.known + rest

    def keep(self, those: np.ndarray) -> None:
        """Go on with some of the queries only."""
        for name in ("weights", "squares", "known", "left", "slack", "loose"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[..., those]))


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * queries
        self.least = np.full(queries, -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.found[query][0], scores), np.append(self.found[query][1], ids)
        top = np.lexsort((ids, -scores))[: self.k]
        self.found[query] = scores[top], ids[top]
        if len(top) == self.k:
            self.least[query] = scores[top[-1]]


def search_block(queries: np.ndarray, query_ids: np.ndarray, lists: SortedLists, ids: np.ndarray, best: Best) -> np.ndarray:
    """Add the best of a block to ``best``; returns (entries read, candidates left) by query.

    A candidate stays while its upper bound reaches the k-th best lower bound
    of the block and the k-th best score of the blocks before. A query stops
    when few stay, and the scores of those are resolved in integers. Where all
    is read, the k best and their ties are left.
    """
    k, n, out = best.k, lists.n, np.zeros((len(queries), 2), np.int64)
    for first in range(0, len(queries), TOGETHER):
        active = np.arange(first, min(first + TOGETHER, len(queries)))
        reading = Reading(queries[active], lists)
        while len(active):
            reading.advance()
            lower, upper = (np.ascontiguousarray(side.T) for side in reading.bounds())
            own = query_ids[active][:, None] == ids
            lower[own] = upper[own] = -np.inf
            reach = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
            stay = (upper >= np.maximum(reach, best.least[active])[:, None]) & ~own
            done = (stay.sum(axis=1) <= max(4 * k, n // 16)) | (reading.turn == len(SHARES))
            for r in np.flatnonzero(done).tolist():
                at = np.flatnonzero(stay[r])
                best.add(int(active[r]), lists.x[at] @ queries[active[r]], ids[at])
                out[active[r]] = lists.depths[reading.turn].sum(), len(at)
            if done.any():
                active = active[~done]
                reading.keep(~done)
    return out


def blocks(batches: Iterator[pa.RecordBatch], size: int, dtype: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, ids, vectors) in blocks of one dimension each."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = x.values.to_numpy(zero_copy_only=False).astype(dtype)
            ids, rows = held.setdefault(len(x), ([], []))
            ids.append(vec_id)
            rows.append(x)
            if len(ids) == size:
                del held[len(x)]
                yield len(x), np.array(ids, np.int64), np.stack(rows)
    for d, (ids, rows) in held.items():
        yield d, np.array(ids, np.int64), np.stack(rows)


def query_batches(asked: DataFrame, dtype: type, limit: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """The queries, in blocks, ``limit`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, ids, x in blocks(batches, QUERY_BLOCK, dtype):
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], ["d", "ids", "x"])

    held, size = [], 0
    for d, ids, x in asked.mapInArrow(run, "d int, ids binary, x binary").toLocalIterator():
        held.append((d, bytes(ids), bytes(x)))
        size += len(ids) + len(x)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """The ``k`` candidates of greatest integer inner product for each query.

    Both tables have vec_id and embedding. Components count as
    ``floor(scale * x)``. Vectors that are null, or hold null or non-finite
    components, and null ids take no part; a query meets the candidates of its
    own dimension but for those of its own id. Ties go to the smaller id.
    Repeated candidates are candidates each; of queries with one id the one of
    least components counts. Returns query_id, rank, vec_id, score; an empty
    table on either side gives no rows.

    Candidates stay where they are read. Queries are sent to them in batches
    of ``BATCH_BYTES``, one pass over the candidates and one small table each;
    a batch is dropped before the next is sent. A task keeps one block of
    candidates and the k best of each query, by which later blocks are pruned,
    and sends only those on; ranking them needs one shuffle.
    """
    spark = vectors.sparkSession
    sound = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    candidates = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    asked = queries.where(sound).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    dtype = np.float64 if "double" in candidates.schema["embedding"].dataType.simpleString() else np.float32

    def whole(x: np.ndarray) -> np.ndarray:
        return np.floor(x.astype(float) * scale).astype(np.int64)

    out = None
    for batch in query_batches(asked, dtype, BATCH_BYTES):
        shared = spark.sparkContext.broadcast(batch)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            parts = [(d, np.frombuffer(ids, np.int64), whole(np.frombuffer(x, dtype)).reshape(len(ids) // 8, d)) for d, ids, x in shared.value]
            best = [Best(len(ids), k) for _, ids, _ in parts]
            for d, ids, x in blocks(batches, BLOCK, dtype):
                lists = SortedLists(whole(x)) if d else None
                for (q_d, q_ids, q), found in zip(parts, best, strict=True):
                    if q_d != d:
                        continue
                    if lists is None:  # vectors without components: every score is zero
                        for r, own in enumerate(q_ids.tolist()):
                            at = np.flatnonzero(ids != own)
                            found.add(r, np.zeros(len(at), np.int64), ids[at])
                    else:
                        search_block(q, q_ids, lists, ids, found)
            for (_, q_ids, _), found in zip(parts, best, strict=True):
                sizes = [len(s) for s, _ in found.found]
                columns = [np.repeat(q_ids, sizes), np.concatenate([i for _, i in found.found]), np.concatenate([s for s, _ in found.found])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

        found = saved(candidates.mapInArrow(run, "query_id long, vec_id long, score long"), "top-k")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
