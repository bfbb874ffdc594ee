"""Toxicity scores by non-negative positive-unlabelled learning.

Linear classifiers over the words of a text, their beginnings and their ends
are trained from confirmed toxic examples and unlabelled texts only. With the
class prior ``p``, the risk of a classifier is ``p R+(toxic) + max(0,
R-(unlabelled) - p R-(toxic))``: the share of toxic texts among the unlabelled
is taken out of their risk, and what is left may not fall below zero.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import saved, slices

#: Bounds of the fit: toxic examples, unlabelled texts (those of least hash) and features.
POSITIVES, UNLABELLED, FEATURES = 4000, 12_000, 512
THRESHOLD = 0.3
#: Prior where the labels don't tell it (no label of either kind).
PRIOR = 0.1
CLASSIFIERS, EPOCHS, RATE, DECAY, STEP_ROWS = 3, 40, 0.05, 1e-4, 512
LONGEST_WORD, LEAST_DOCUMENTS, LEAST_DEVIATIONS = 40, 4, 4.5
#: A feature's value is its count in ``SPAN`` words, of ``SPAN`` more than the text has, and this at most.
SPAN, MOST = 64, 3.0
HEADS, TAILS = (4, 5, 6), (4, 5)
BATCH_BYTES, MAX_KNOWN = 4 << 20, 200_000
_WORDS = re.compile(r"[^\W_]+")

Names = Callable[[str], "int | None"]


def token_features(token: str) -> list[str]:
    """Words of a token between blanks, and their beginnings (^) and ends ($); a word over 40 letters has these two only."""
    out = []
    for word in _WORDS.findall(token):
        n = len(word)
        if n <= LONGEST_WORD:
            out.append(word)
        out += ["^" + word[:k] for k in HEADS if n > k] + ["$" + word[-k:] for k in TAILS if n > k]
    return out


def batch_features(texts: pa.Array, name: Names, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) once for each feature in each text, sorted; ``name`` numbers features, None leaves one out.

    The value is the feature's density, ``SPAN`` times its count by the words
    and ``SPAN`` more, so one hit says less in a long text.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    if len(known) > MAX_KNOWN:
        known.clear()
    found = []
    for token in flat.dictionary.to_pylist():
        at = known.get(token)
        if at is None:
            numbers = (name(f) for f in token_features(token))
            at = tuple(k for k in numbers if k is not None)
            if len(token) <= LONGEST_WORD:
                known[token] = at
        found.append(at)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    every = np.fromiter((k for at in found for k in at), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    token = flat.indices.to_numpy().astype(np.int64)
    words = pc.list_value_length(lists).to_numpy()
    owner = np.repeat(np.arange(len(texts)), words)
    keep = sizes[token] > 0 if len(token) else np.zeros(0, bool)
    pairs, times = np.unique(owner[keep] * len(found) + token[keep], return_counts=True)
    owner, token = pairs // max(1, len(found)), pairs % max(1, len(found))
    n = sizes[token]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    feature, owner, times = every[np.repeat(starts[token], n) + place], np.repeat(owner, n), np.repeat(times, n)
    width = int(every.max(initial=0)) + 1
    pairs, at = np.unique(owner * width + feature, return_inverse=True)
    owner, count = pairs // width, np.bincount(at, times, len(pairs))
    return owner, pairs % width, np.minimum(count * SPAN / (words[owner] + SPAN), MOST)


def log_loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def risks(weights: np.ndarray, base: float, toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of the toxic as such, corrected risk of the others), before the latter is kept from below zero."""
    zp, zu = toxic @ weights + base, unlabelled @ weights + base
    return prior * float(log_loss(zp).mean()), float(log_loss(-zu).mean()) - prior * float(log_loss(-zp).mean())


def fit(toxic: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and base of one classifier, by Adam over shuffled parts of both samples.

    A step descends the whole risk; where the corrected risk of the others is
    below zero on its rows, the step goes against that part alone instead.
    """
    rng = np.random.default_rng(seed)
    d = toxic.shape[1]
    state = np.zeros(d + 1)
    state[d] = np.log(prior / (1 - prior))
    first, second, turn = np.zeros(d + 1), np.zeros(d + 1), 0
    steps = max(1, -(-len(unlabelled) // (3 * STEP_ROWS)))

    def slope(x: np.ndarray, sign: float) -> np.ndarray:
        """Mean gradient of the loss of ``x`` taken as toxic (1) or not (-1)."""
        z = sign * (x @ state[:d] + state[d])
        g = -sign / (1 + np.exp(np.clip(z, -500, 500))) / len(x)
        return np.append(g @ x, g.sum())

    for _ in range(epochs):
        # the smaller sample is dealt again within an epoch
        p = np.concatenate([rng.permutation(len(toxic)) for _ in range(-(-steps * STEP_ROWS // len(toxic)) + 1)])
        u = rng.permutation(len(unlabelled))
        for k in range(steps):
            xp, xu = toxic[p[k * STEP_ROWS : (k + 1) * STEP_ROWS]].astype(float), unlabelled[u[k::steps]].astype(float)
            others = slope(xu, -1) - prior * slope(xp, -1)
            if risks(state[:d], state[d], xp, xu, prior)[1] >= 0:
                g = prior * slope(xp, 1) + others
            else:
                g = -others
            g[:d] += DECAY * state[:d]
            turn += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            state -= RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return state[:d], float(state[d])


@dataclass
class ToxicityModel:
    """Features by name, and the weights and bases of the classifiers, whose log odds are averaged."""

    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bases: np.ndarray = field(default_factory=lambda: np.full(1, np.log(PRIOR / (1 - PRIOR))))
    prior: float = PRIOR

    def score(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        logit = np.full(n, float(self.bases.mean()))
        if self.weights.size:
            logit += np.bincount(rows, self.weights.mean(axis=0)[features] * values, n)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(text, toxic, free) of at most ``positives`` confirmed toxic texts and ``unlabelled`` texts of any kind, none held out.

    Those of least hash, one text an id. A text may be in both samples.
    """
    known, toxic = F.col("doc_id"), F.col("toxic")
    confirmed = (
        labels.where(known.isNotNull() & toxic.isNotNull() & ~held_out(known)).groupBy(known.alias("k")).agg(F.avg(toxic).alias("rate")).where("rate >= 0.5")
        .orderBy(F.xxhash64("k"), "k").limit(positives).select("k", F.lit(1).alias("toxic"), F.lit(0).alias("free"))
    )
    texts = docs.select(known.alias("id"), F.col("text").alias("body")).where("id IS NOT NULL")
    share = min(1.0, 2 * unlabelled / max(1, docs.count()))
    drawn = texts.where(~held_out(F.col("id")) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))).select(F.col("id").alias("k")).distinct()
    drawn = drawn.orderBy(F.xxhash64("k"), "k").limit(unlabelled).select("k", F.lit(0).alias("toxic"), F.lit(1).alias("free"))
    chosen = confirmed.unionByName(drawn).groupBy("k").agg(F.max("toxic").alias("toxic"), F.max("free").alias("free"))
    joined = texts.join(F.broadcast(chosen), F.col("id") == F.col("k"))
    return joined.groupBy("id").agg(F.min("body").alias("text"), F.max("toxic").alias("toxic"), F.max("free").alias("free")).select("text", "toxic", "free")


def chosen_features(sample: DataFrame, limit: int) -> list[str]:
    """The features whose mean in the toxic texts lies most deviations above that in the unlabelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            numbers: dict[str, int] = {}
            row, feature, value = batch_features(batch.column(0), lambda f, n=numbers: n.setdefault(f, len(n)), {})
            toxic, free = (batch.column(k).to_numpy()[row] for k in (1, 2))
            sums = [np.bincount(feature, x, len(numbers)) for x in (toxic, toxic * value, free * value, free * value**2)]
            yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()), *map(pa.array, sums)], ["feature", "n", "p", "u", "uu"])

    sizes = sample.agg(F.sum("toxic").alias("np"), F.sum("free").alias("nu")).first()
    n_p, n_u = (sizes["np"] or 0) + 1, (sizes["nu"] or 0) + 1
    counted = sample.mapInArrow(run, "feature string, n double, p double, u double, uu double").groupBy("feature").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("n", "p", "u", "uu")))
    # as if one text more of either kind held it once
    mean, spread = (F.col("u") + 0.5) / n_u, (F.col("uu") + 0.5) / n_u
    apart = (F.col("p") / n_p - mean) / F.sqrt((spread - mean * mean) * (1 / n_p + 1 / n_u))
    best = counted.where(F.col("n") >= LEAST_DOCUMENTS).select("feature", apart.alias("apart")).where(F.col("apart") >= LEAST_DEVIATIONS)
    return [r["feature"] for r in best.orderBy(F.desc("apart"), "feature").limit(limit).collect()]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES, prior: float | None = None) -> ToxicityModel:
    """Fit the classifiers on bounded samples of texts that are not held out.

    Only texts confirmed as toxic and unlabelled ones train; labels of zero
    serve for the prior alone (share of toxic labels; 0.1 where there are none
    of zero), unless it is given. Of an id with several labels the mean counts,
    with several texts the least; null ids, null labels and labels without a
    document are left out. What comes to the driver is a row of values an
    example, at most (positives + unlabelled) x features. Without a toxic
    example, without texts or without a feature that tells them apart, every
    score is the prior.
    """
    label = F.col("toxic")
    if prior is None:
        sound = F.col("doc_id").isNotNull() & label.isNotNull() & ~held_out(F.col("doc_id"))
        each = labels.where(sound).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))
        rate = each.agg(F.avg("y").alias("rate")).first()["rate"]
        prior = PRIOR if rate is None or rate >= 1 else max(rate, 1e-4)
    sample = saved(examples(docs, labels, positives, unlabelled), "toxicity-examples")
    names = chosen_features(sample, features)
    place = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, "text", BATCH_BYTES):
            row, feature, value = batch_features(batch.column(0), place.get, known)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            held = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*held, batch.column(1), batch.column(2)], ["at", "value", "toxic", "free"])

    got = sample.mapInArrow(run, "at array<int>, value array<float>, toxic int, free int").orderBy("toxic", "free", "at", "value").collect()
    if not names or not any(r["toxic"] for r in got) or not any(r["free"] for r in got):
        return ToxicityModel(bases=np.full(1, np.log(prior / (1 - prior))), prior=prior)

    def matrix(kind: str) -> np.ndarray:
        rows = [r for r in got if r[kind]]
        out = np.zeros((len(rows), len(names)), np.float32)
        for k, r in enumerate(rows):
            out[k, r["at"]] = r["value"]
        return out

    toxic, free = matrix("toxic"), matrix("free")
    fitted = [fit(toxic, free, prior, seed) for seed in range(CLASSIFIERS)]
    return ToxicityModel(names, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]), prior)


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row, from the whole text alone.

    One narrow pass. Null and empty texts are scored by the bases; null ids and
    repeated rows are kept; other columns, whatever their names, are ignored;
    an empty table gives no rows.
    """
    place = {f: k for k, f in enumerate(model.features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, "text", BATCH_BYTES):
            scores = model.score(*batch_features(batch.column(1), place.get, known), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
