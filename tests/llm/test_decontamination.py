import random
from collections import Counter

import pytest
from llm.conftest import hard_rows

from fovea.llm import decontamination


def words_of(text):
    import re

    return [w for w in (re.sub(r"[\W_]+", "", x) for x in (text or "").lower().split()) if w]


def grams(words, k=5):
    return Counter(tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))) if words else Counter()


def brute(rows, items, least=0.8):
    out = set()
    for i, text in rows:
        words = words_of(text)
        for j, item in items:
            want = words_of(item)
            if not want or not words:
                continue
            if len(want) < 5:
                if any(words[a : a + len(want)] == want for a in range(len(words))):
                    out.add((i, j, 1.0))
                continue
            width = min(len(want), len(words))
            target, best = grams(want), 0.0
            for a in range(len(words) - width + 1):
                held = grams(words[a : a + width])
                common = sum((held & target).values())
                best = max(best, common / (sum(held.values()) + sum(target.values()) - common))
            if best >= least:
                out.add((i, j, round(best, 9)))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [4096, 7])
def test_against_every_window(docs, spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_ITEMS", most)  # one index, or several
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(5, 60)))) for k in range(25)] + [(80, "w1"), (81, "W2, w3"), (82, "w4 w5 w6"), (83, "w7 w8 w9 w10"), (84, "w2 w3"), (90, "yes no"), (91, None), (92, "")]
    rows = [(1000, "Yes, no!"), (1001, "yes no maybe")]
    for k in range(120):
        body = [word() for _ in range(rng.randrange(3, 200))]
        if k % 2:
            item = items[rng.randrange(25)][1].split()
            for _ in range(k % 5):
                item[rng.randrange(len(item))] = word()
            body[rng.randrange(len(body)) :] = [*(w.upper() + "," for w in item), *body[:20]]
        rows.append((k, " ".join(body)))
    got = {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontamination.find_leaks(docs(rows), bench(spark, items)).collect()}
    want = brute(rows, items)
    assert got == want and len(want) > 15 and {j for _, j, _ in want} >= {80, 90}
    where = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(docs(rows), bench(spark, items)).collect()}
    short = [(r["start_word"], words_of(dict(rows)[i]), words_of(dict(items)[j])) for (i, j), r in where.items() if j >= 80]
    assert short and all(next(a for a in range(len(w)) if w[a : a + len(x)] == x) == at for at, w, x in short)
    kept = {r["doc_id"] for r in decontamination.without_leaks(docs(rows), bench(spark, items)).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _, _ in want}


def test_hard_rows(docs, spark):
    items = [(1, "The quick brown fox jumps over the lazy dog"), (1, "The quick brown fox jumps over the lazy dog")]
    df = docs(hard_rows(), clashing=True)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(df, bench(spark, items)).collect())
    assert got == [(6, 1)] * 4 + [(7, 1)] * 2
    out = decontamination.without_leaks(df, bench(spark, items))
    assert out.columns == df.columns and out.count() == len(hard_rows()) - 3


def test_empty_tables(docs, spark):
    assert decontamination.find_leaks(docs([]), bench(spark, [(1, "a b c d e f")])).count() == 0
    assert decontamination.find_leaks(docs(hard_rows()), bench(spark, [])).count() == 0
    assert decontamination.without_leaks(docs(hard_rows()), bench(spark, [])).count() == len(hard_rows())


def test_items_in_blocks(docs, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_ITEMS", 2)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(9))) for k in range(5)]
    rows = [(k, "before " + items[k][1] + " after") for k in range(5)]
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs(rows), bench(spark, items)).collect()} == {(k, k) for k in range(5)}
    assert decontamination.without_leaks(docs(rows), bench(spark, items)).count() == 0


def test_one_reading_of_the_texts(docs, spark, monkeypatch, tmp_path):
    """With more items than an index holds the texts are read once, and a long item of many blocks is whole."""
    monkeypatch.setattr(decontamination, "MAX_ITEMS", 2)
    long = " ".join(f"v{k}" for k in range(3000))
    items = [(k, " ".join(f"i{k}w{j}" for j in range(9))) for k in range(9)] + [(50, long)]
    docs([(k, f"before {items[k][1]} after") for k in range(9)] + [(20, f"x {long} y"), (21, "clean")], clashing=True).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    found = decontamination.find_leaks(df, bench(spark, items))
    assert "d" not in [f.rsplit("/", 2)[-2] for f in found.inputFiles()]
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {*((k, k) for k in range(9)), (20, 50)}
    kept = decontamination.without_leaks(df, bench(spark, items))
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [21]


def test_rows_are_the_same_with_several_indexes(docs, spark, monkeypatch):
    items = [(1, "The quick brown fox jumps over the lazy dog"), (1, "The quick brown fox jumps over the lazy dog"), (2, "one"), (3, "don't they'll")]
    df = docs(hard_rows(), clashing=True)
    once = [sorted(map(str, t.collect())) for t in (decontamination.find_leaks(df, bench(spark, items)), decontamination.without_leaks(df, bench(spark, items)))]
    monkeypatch.setattr(decontamination, "MAX_ITEMS", 1)
    assert [sorted(map(str, t.collect())) for t in (decontamination.find_leaks(df, bench(spark, items)), decontamination.without_leaks(df, bench(spark, items)))] == once
