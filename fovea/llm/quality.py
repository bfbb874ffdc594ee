"""Quality scores by a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one per feature, and one per chosen pair
of features. They are learned by cyclic gradient boosting: in turn each feature
gets a shallow tree on its bins, fitted to the residuals of the log loss and
added to its table at a small rate; then the pairs that explain most of what
is left are boosted alike. A score is a bin look-up and an addition a feature.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slices

#: Labelled rows that the model is fitted on, at most: those of least hash.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 32, 8, 8, 150, 60, 0.1, 3, 10
BATCH_BYTES = 4 << 20

FEATURES = (
    "log_bytes", "upper", "digits", "stops", "bangs", "symbols", "pipes", "brackets", "blanks", "lines", "non_ascii",
    "word_bytes", "distinct_words", "top_word", "line_words", "repeated_lines", "marked_words", "log_words",
)
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:?-'\"", "bangs": b"!", "symbols": b"#*$%&@^~=+\\/_", "pipes": b"|", "brackets": b"<>[]{}()", "blanks": b" \t", "lines": b"\n\r"}
KIND_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(KINDS.values(), 1):
    KIND_OF[list(_chars)] = _k
KIND_OF[128:] = len(KINDS) + 1
_MARKS = tuple("#*$%&|!")


def text_features(text: str | None) -> list[float]:
    """The features of one whole text; all zero for null and empty."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode()
    n = len(data)
    kinds = np.bincount(KIND_OF[np.frombuffer(data, np.uint8)], minlength=len(KINDS) + 2)[1:] / n
    words = text.split()
    count = len(words) or 1
    seen = Counter(words)
    lines = [line for line in text.split("\n") if line]
    marked = sum(c for w, c in seen.items() if w.endswith(_MARKS))
    return [
        np.log1p(n), *kinds, n / count, len(seen) / count, max(seen.values(), default=0) / count, count / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), marked / count, np.log1p(count),
    ]


def best_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: int, held: np.ndarray) -> np.ndarray:
    """Values by bin of a tree with ``leaves`` leaves on ordered bins (Newton steps)."""
    g, h, n = np.cumsum(gradient), np.cumsum(weight), np.cumsum(held)
    parts = [(0, len(gradient))]

    def sums(c: np.ndarray, a: int, z: np.ndarray | int) -> np.ndarray:
        return c[np.asarray(z) - 1] - (c[a - 1] if a else 0)

    while len(parts) < leaves:
        best = (1e-6, None, 0)
        for k, (a, z) in enumerate(parts):
            cut = np.arange(a + 1, z)
            if not len(cut):
                continue
            gl, hl, nl = sums(g, a, cut), sums(h, a, cut), sums(n, a, cut)
            gt, ht, nt = sums(g, a, z), sums(h, a, z), sums(n, a, z)
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < least) | (nt - nl < least)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), k, int(cut[gain.argmax()]))
        if best[1] is None:
            break
        a, z = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], z)]
    out = np.zeros(len(gradient))
    for a, z in parts:
        out[a:z] = sums(g, a, z) / (sums(h, a, z) + 1)
    return out


def best_pair_tree(gradient: np.ndarray, weight: np.ndarray, least: int, held: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by cell of a depth-two tree on two ordered features (a cut of one, then of the other on each side), and its gain."""
    best = (0.0, np.zeros_like(gradient))
    for turned in (False, True):
        g, h, n = (x.T if turned else x for x in (gradient, weight, held))
        for cut in range(1, len(g)):
            values, total = np.zeros_like(g), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs, ns = g[side].sum(0), h[side].sum(0), n[side].sum(0)
                tree = best_tree(gs, hs, 2, least, ns)
                values[side] = tree
                total += float((gs * tree - hs * tree**2 / 2).sum())
            if total > best[0]:
                best = (total, values.T if turned else values)
    return best[1], best[0]


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    @staticmethod
    def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Learn the tables; without rows the score is one half, without one of the classes near the other."""
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate))) if len(y) else 0.0
        if not len(y):
            x = np.zeros((1, len(FEATURES)))
        self.cuts, self.pair_cuts = self.edges(x, BINS), self.edges(x, PAIR_BINS)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        if not len(y) or y.min() == y.max():
            return self
        bins = [np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)]
        logit = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-logit))
            return y - p, p * (1 - p)

        held = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables, strict=True)]
        for _ in range(ROUNDS):
            for k, b in enumerate(bins):
                g, h = slopes()
                size = len(self.tables[k])
                step = RATE * best_tree(np.bincount(b, g, size), np.bincount(b, h, size), LEAVES, LEAST, held[k])
                self.tables[k] += step
                logit += step[b]
        coarse = [np.searchsorted(c, v, side="right") for c, v in zip(self.pair_cuts, x.T, strict=True)]
        cells, found = {}, []
        for i, j in combinations(range(x.shape[1]), 2):
            shape = (len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)
            cells[i, j] = (coarse[i] * shape[1] + coarse[j], shape)

        def boosted(i: int, j: int) -> tuple[np.ndarray, float]:
            (at, shape), (g, h) = cells[i, j], slopes()
            sums = [np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, None)]
            return best_pair_tree(sums[0], sums[1], LEAST, sums[2])

        for i, j in cells:
            found.append((boosted(i, j)[1], i, j))
        self.pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros(cells[p][1]) for p in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, p in enumerate(self.pairs):
                step = RATE * boosted(*p)[0]
                self.pair_tables[k] += step
                logit += step.ravel()[cells[p][0]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for c, t, v in zip(self.cuts, self.tables, x.T, strict=True):
            logit += t[np.searchsorted(c, v, side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            logit += t[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-logit))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fit the model on at most ``sample`` labelled rows that are not held out.

    The sample is the labelled ids of least hash, so it does not depend on the
    order of rows. Only their feature rows (no texts) come to the driver. An id
    with several labels counts as good if half of them or more are, of several
    texts of an id that of least features counts once; null labels and labels without a document are left out. Other columns of either
    table, whatever their names, are ignored.
    """
    known, quality = F.col("doc_id"), F.col("quality")
    chosen = (
        labels.where(known.isNotNull() & quality.isNotNull() & ~held_out(known))
        .groupBy(known.alias("labelled"))
        .agg((F.avg(quality) >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("text", "y", "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            x = [text_features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "labelled"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = rows.mapInArrow(run, f"x array<double>, y double, labelled {kind}").groupBy("labelled").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    got = each.select("y", "x").orderBy("y", "x").toPandas()
    return AdditiveModel().fit(np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES)), got["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, from the text alone.

    One narrow pass. Null and empty texts are scored from zero features; null
    ids and repeated rows are kept; other columns, whatever their names, are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            scores = model.score(np.array([text_features(t) for t in batch.column(1).to_pylist()], float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that ``score_documents`` predicts to be good, all columns kept as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            scores = model.score(np.array([text_features(t) for t in batch.column(at).to_pylist()], float))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
