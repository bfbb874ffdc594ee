"""Quality and language models: held-out accuracy, edges, and what a score may depend on."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA
from llm.conftest import hard_rows

from fovea.llm import language_id, quality, queries

SMALL = DATA.replace("0.001", "0.01")


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op6_additive_quality(spark, SMALL).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    out = [(got[i]["predicted"], q) for i, q in labels.items() if got[i]["held_out"]]
    good = [p for p, q in out if q == 1]
    bad = [p for p, q in out if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_quality_edges(docs, spark):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(hard_rows(), clashing=True)
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.train(df, some.selectExpr("*", "1 AS y", "2 AS labelled", "'x' AS text"))
        rows = quality.score_documents(df, model).collect()
        assert len(rows) == len(hard_rows()) and all(0 <= r["score"] <= 1 for r in rows)
        kept = quality.accepted(df, model)
        assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.score_documents(docs([]), model).count() == quality.accepted(docs([]), model).count() == 0


def test_scores_are_sums_of_table_entries():
    """Each score against a plain walk: the bin of each feature is the number of cuts at or below it."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, len(quality.FEATURES))), 1)
    model = quality.AdditiveModel().fit(x, (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=400) > 0).astype(float))
    assert len(model.pairs) == quality.PAIRS
    for row, score in zip(x, model.score(x), strict=True):
        total = model.base
        for k, v in enumerate(row):
            total += model.tables[k][sum(1 for c in model.cuts[k] if c <= v)]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(1 for c in model.pair_cuts[i] if c <= row[i]), sum(1 for c in model.pair_cuts[j] if c <= row[j])]
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)


def plain_features(text):
    """The features of a text, counted one by one."""
    data = text.encode()
    words, lines = text.split(), [x for x in text.split("\n") if x]
    shares = [sum(b in chars for b in data) / len(data) for chars in quality.KINDS.values()] + [sum(b > 127 for b in data) / len(data)]
    count = len(words) or 1
    top = max((words.count(w) for w in words), default=0)
    return [np.log1p(len(data)), *shares, len(data) / count, len(set(words)) / count, top / count, count / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(w[-1] in "#*$%&|!" for w in words) / count, np.log1p(count)]


@pytest.mark.parametrize("text", ["One two, two!\nOne two, two!\nthree 45", "  \n\n ", "é中 #tag# a|b|", "AAA bbb$ CCC%\r\n\tx", "w" * 5000])
def test_features_against_plain_counts(text):
    assert quality.text_features(text) == pytest.approx(plain_features(text))


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)) > 0.9


def test_language_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op4_crf_language_id(spark, SMALL).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert set(got) == set(truth)
    out = [got[i]["lang_pred"] == lang for i, lang in truth.items() if got[i]["held_out"]]
    assert np.mean(out) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    words = {"xx": ["bal", "baru", "bol", "bem", "lab"], "yy": ["tik", "ket", "tuk", "kit", "tek"]}
    return language_id.fit([(lang, rng.choice(words[lang], 30).tolist()) for _ in range(60) for lang in ("xx", "yy")])


def brute(model, text):
    words = [w for w in language_id.cores(text.lower().split()) if w]
    scores = model.emissions(words).astype(float)
    e = np.exp(scores - scores.max(1, keepdims=True))
    a, b = [e[0]], [np.ones(e.shape[1])]
    for row in e[1:]:
        v = (a[-1] @ model.trans) * row
        a.append(v / v.sum())
    for row in e[:0:-1]:
        v = model.trans @ (row * b[-1])
        b.append(v / v.sum())
    g = np.array(a) * np.array(b[::-1])
    return (g / g.sum(1, keepdims=True)).sum(0) / len(words)


def test_forward_backward(model):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["bal", "tik", "zzz", "Bem!", "12", "ket"], n)) for n in (1, 5, 63, 64, 65, 128, 129, 1000)] + ["bal"]
    texts = [t + " bal" for t in texts]
    names, scores = model.label_texts(pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        want = brute(model, text)
        assert name == model.labels[int(want.argmax())] and score == pytest.approx(want.max(), abs=1e-3)


def test_code_switched_words(model):
    names, scores = model.label_texts(pa.array(["bal baru tik bol bem", "tik ket bal tuk kit", None, "", "12 !!"]))
    assert names == ["xx", "yy", "und", "und", "und"] and scores[2:].tolist() == [0, 0, 0]


def test_language_edges(docs, spark):
    model = language_id.train(docs([]))
    assert all(r["lang_pred"] == "und" for r in language_id.label_documents(docs(hard_rows()), model).collect())
    model = language_id.train(docs(hard_rows(), clashing=True))
    rows = language_id.label_documents(docs(hard_rows(), clashing=True), model).collect()
    assert len(rows) == len(hard_rows()) and {r["lang_pred"] for r in rows} <= {"en", "und"}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 12)) for r in rows if r["doc_id"] is not None)
    assert language_id.label_documents(docs([]), model).count() == 0


def test_documents_held_several_times_teach_once(spark, docs):
    """The model of documents held once is that of the same held five times, also where the sample is cut."""
    rows = [(k, f"word{k % 7} " * (k % 23 + 1) + "#" * (k % 5)) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int")
    for sample in (100, 1000):
        one, five = (quality.train(docs(r), labels, sample) for r in (rows, rows * 5))
        assert one.base == five.base and all((a == b).all() for a, b in zip(one.tables + one.pair_tables, five.tables + five.pair_tables, strict=True))


def test_documents_held_several_times_teach_languages_once(spark):
    """So do spans, where the sample is cut and where an id has several texts."""
    rows = [(k, ("le chat dort " if k % 2 else "the cat sleeps ") * (k % 60 + 1) + f"x{k % 9}", "fr" if k % 2 else "en") for k in range(200)]
    other = [(4, "a text of its own", "en"), (None, "sans nom", "fr"), (None, "no name", "en")]
    schema = "doc_id long, text string, lang string"
    for sample in (40, 1000):
        one, five = (language_id.train(spark.createDataFrame(r, schema), sample) for r in (rows + other, (rows + other) * 5))
        assert one.labels == five.labels and all(np.array_equal(a, b) for a, b in ((one.table, five.table), (one.weights, five.weights), (one.trans, five.trans)))
