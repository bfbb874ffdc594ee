"""Positive-unlabelled toxicity: features against a loop, the risk that can't fall below zero, held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fovea.llm import toxicity as T
from fovea.llm.tables import read

from .conftest import hard_rows

DATA = "/root/testdata/sf0.1"


def test_features_like_a_loop():
    texts = [t for _, t in hard_rows()] + ["Bad, BAD bad! worsen-worse", "a" * 60 + " bad"]
    names = {}
    row, feature, value = T.batch_features(pa.array(texts, pa.string()), lambda f: names.setdefault(f, len(names)), {})
    got = {}
    for r, f, v in zip(row.tolist(), feature.tolist(), value.tolist(), strict=True):
        got.setdefault(r, {})[f] = v
    for k, text in enumerate(texts):
        words = (text or "").lower().split()
        counts = Counter(f for w in words for f in T.token_features(w))
        want = {names[f]: min(T.MOST, n * T.SPAN / (len(words) + T.SPAN)) for f, n in counts.items()}
        assert got.get(k, {}).keys() == want.keys() and all(math.isclose(got[k][f], v) for f, v in want.items())
    long = T.token_features("a" * 60)
    assert long == ["^aaaa", "^aaaaa", "^aaaaaa", "$aaaa", "$aaaaa"]


def test_corrected_risk_stays_at_zero():
    """With as many features as rows the uncorrected risk of the others goes far below zero; the fit keeps it near zero."""
    rng = np.random.default_rng(1)
    toxic, free = (rng.random((80, 400)) < 0.1).astype(np.float32), (rng.random((240, 400)) < 0.1).astype(np.float32)
    w, b = T.fit(toxic, free, 0.3, 0, epochs=150)
    own, others = T.risks(w, b, toxic, free, 0.3)
    assert others > -0.1 and own >= 0
    p, state = 0.3, np.zeros(401)
    for _ in range(400):  # plain descent of the same risk without the correction
        slope = lambda x, sign: np.append((g := -sign / (1 + np.exp(sign * (x @ state[:400] + state[400]))) / len(x)) @ x, g.sum())  # noqa: E731, B023
        state = state - 5 * (p * slope(toxic, 1) + slope(free, -1) - p * slope(toxic, -1))
    assert T.risks(state[:400], state[400], toxic, free, p)[1] < others - 0.2


def test_prior_is_taken_out():
    """A quarter of the unlabelled are toxic; scores of both kinds still part at one half."""
    rng = np.random.default_rng(2)

    def rows(n, toxic):
        x = (rng.random((n, 20)) < 0.2).astype(np.float32)
        x[:, :3] = rng.random((n, 3)) < (0.9 if toxic else 0.05)
        return x

    w, b = T.fit(rows(400, True), np.concatenate([rows(300, True), rows(900, False)]), 0.25, 0)
    p = lambda x: 1 / (1 + np.exp(-(x @ w + b)))
    assert (p(rows(500, True)) > 0.5).mean() > 0.88 and (p(rows(500, False)) < 0.5).mean() > 0.97


def words(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "tempor", "labore", "magna"]) for _ in range(n))


def small(n=240):
    """Every fourth text holds insults with one beginning; half of these are labelled."""
    rng = random.Random(4)
    rows = [(i, words(rng, 30) + ("" if i % 4 else " krumbler krumbly") + " " + words(rng, 30)) for i in range(n)]
    return rows, [(i, int(i % 4 == 0)) for i in range(n) if i % 3]


def scored(docs, model):
    return sorted((str(r["doc_id"]), round(r["score"], 9), r["predicted"]) for r in T.score_documents(docs, model).collect())


def test_small_corpus(spark, docs):
    rows, labels = small()
    labels = spark.createDataFrame([*labels, (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    model = T.train(docs(rows), labels)
    held = {r["doc_id"]: r["h"] for r in docs(rows).select("doc_id", T.held_out(F.col("doc_id")).alias("h")).collect()}
    out = {r["doc_id"]: r for r in T.score_documents(docs(rows), model).collect()}
    assert any(held.values()) and all((out[i]["predicted"] == 1) == (i % 4 == 0) for i in out)
    # repeated documents change nothing, nor do clashing names
    names = ("score", "toxic", "free", "k", "id", "body", "text_", "at", "value", "rate")
    other = docs(rows * 3)
    for name in names:
        other = other.withColumn(name, F.lit("x"))
    again = T.train(other, labels.union(labels))
    assert again.features == model.features and np.allclose(again.weights, model.weights, atol=1e-9)
    # what is held out teaches nothing: turning its labels and texts over gives the same model
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    blank = docs([(i, "nothing" if held[i] else t) for i, t in rows])
    third = T.train(blank, turned)
    assert third.features == model.features and np.allclose(third.weights, model.weights, atol=1e-9)


def test_hard_rows_and_no_examples(spark, docs):
    rows, labels = small(80)
    model = T.train(docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = T.score_documents(docs(hard_rows(), True), model).collect()
    assert len(out) == len(hard_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for d, l in ((docs(rows), none), (docs([]), spark.createDataFrame(labels, none.schema)), (docs([]), none)):
        lone = T.train(d, l)
        assert {round(r["score"], 6) for r in T.score_documents(docs(rows), lone).collect()} == {round(lone.prior, 6)}
        assert T.score_documents(docs([]), lone).collect() == []


def test_held_out_accuracy(spark):
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    out = T.score_documents(docs, T.train(docs, labels)).where(T.held_out(F.col("doc_id"))).join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic, clean = [r["predicted"] for r in out if r["toxic"] == 1], [r["predicted"] for r in out if r["toxic"] == 0]
    assert sum(toxic) > 0.93 * len(toxic) and sum(clean) < 0.01 * len(clean)
