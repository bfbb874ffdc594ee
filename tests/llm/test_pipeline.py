"""The stages on a small table, each against what it should do to its own input."""

import corpus_pipeline
import numpy as np
import pytest
from helpers import DATA
from llm.test_decontamination import brute

from fovea.llm.tables import read, saved


@pytest.fixture(scope="module")
def steps(spark):
    out = [read(spark, DATA, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], DATA), f"test-{name}"))
    return out


def test_columns_and_order(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "secrets", "packing"]
    assert all(sorted(s.dtypes) == sorted(steps[0].dtypes) for s in steps[:-1])
    counts = [s.count() for s in steps[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_rejected_documents_go(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in read(spark, DATA, "labels").collect()}
    kept = {r["doc_id"] for r in steps[1].select("doc_id").collect()}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.97
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.3


def test_leaks_go(spark, steps):
    before = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    items = [(r["item_id"], r["text"]) for r in read(spark, DATA, "benchmark").collect()]
    held = [(i, t) for i, t in before if len(t) < 4000]
    leaked = {i for i, _, _ in brute(held, items)}
    after = {r["doc_id"] for r in steps[3].collect()}
    assert {i for i, _ in held} - after == leaked


def test_secrets_are_masked(steps):
    before = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    for r in steps[4].collect():
        assert 'token = "0' not in r["text"] and r["n_chars"] == len(r["text"])
        if "token" not in before[r["doc_id"]].lower():
            assert r["text"] == before[r["doc_id"]]


def test_packed_tokens(steps):
    from fovea.llm.packing import encoder
    from fovea.llm.tables import tokenizer_path

    encode = encoder(tokenizer_path("byte_bpe_50k.json"))
    want = sum(len(ids) + 1 for ids in encode([r["text"] for r in steps[4].collect()]))
    assert sum(r["length"] for r in steps[5].collect()) == want


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, DATA).count() == steps[-1].count()
