import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import hard_rows
from pyspark.sql import functions as F

from fovea.llm import packing
from fovea.llm.tables import tokenizer_path


def expected(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def check(pieces, rows, window, tasks):
    whole = {}
    for i, ids in expected(rows):
        whole.setdefault((i, tuple(ids)), [0, ids])[0] += 1
    fills = {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        fills.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    short = [sum(n for _, n in parts) for parts in fills.values() if sum(n for _, n in parts) < window]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= tasks * window.bit_length()
    for i in {i for i, _ in whole}:
        tokens = sorted(t for p in pieces if p["doc_id"] == i for t in np.frombuffer(p["ids"], "<u4").tolist())
        assert tokens == sorted(t for (j, _), (n, ids) in whole.items() if j == i for _ in range(n) for t in ids)
    for (i, _), (n, ids) in whole.items():  # ids with one row: each id once, in place
        if sum(j == i for j, _ in whole) == 1 and n == 1:
            mine = sorted((p["start"], np.frombuffer(p["ids"], "<u4").tolist()) for p in pieces if p["doc_id"] == i)
            assert [t for _, part in mine for t in part] == ids and all(p["doc_tokens"] == len(ids) for p in pieces if p["doc_id"] == i)


def test_hard_rows(docs):
    df = docs(hard_rows(), clashing=True)
    check(packing.pack_documents(df).collect(), hard_rows(), 1024, df.rdd.getNumPartitions())


def test_small_windows_and_few_open(docs, spark):
    rows = [(k, "word " * (k * 7 % 23)) for k in range(200)]
    df = docs(rows).coalesce(1)
    check(packing.pack_documents(df, window=16, max_open=3).collect(), rows, 16, 1)


def test_empty(docs):
    assert packing.pack_documents(docs([])).count() == 0


def test_digest(docs):
    row = packing.pack_documents(docs([(1, "hello")])).withColumn("crc", F.crc32("ids")).first()
    assert row["crc"] == zlib.crc32(np.array(expected([(1, "hello")])[0][1], "<u4").tobytes())


def test_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(300):
        packer = packing.Packer(12, 0)
        packer.level[1:12] = rng.integers(0, 4, 11)
        s = int(rng.integers(1, 12))

        def after(h, level=packer.level, s=s):
            new = level.copy()
            if h:
                new[h] -= 1
            if h + s < 12:
                new[h + s] += 1
            return int((new[1:12] ** 2).sum())

        options = [0, *(h for h in range(1, 13 - s) if packer.level[h])]
        assert after(packer.choose(s)) == min(map(after, options))


TEXTS = ["", " ", "'s 'll we're", "a" * 3000, "é中 1½\n\n\n x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "x \u10940\ua7ce\u0558 y", "\u2019s it\u2019s \U0001f600 \u0661\u0662", "  \n\t  x \n", "don't'LL'd"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_library_s(text):
    for texts in ([text], [text, "and " + text, text + " b"]):
        got = packing.encoder(tokenizer_path("byte_bpe_50k.json"))(texts)
        assert [[*ids.tolist(), 0] for ids in got] == [ids for _, ids in expected([(1, t) for t in texts])]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdmtrevl19a!\xa0\u3000")), max_size=40))
def test_ids_of_any_text(text):
    test_ids_are_the_library_s(text)


def test_words_are_cut_where_the_library_cuts():
    """Between any character that is no white space and a single blank a pre-token begins."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    every = [chr(code) for code in [*range(0xD800), *range(0xE000, 0x20000)]]
    cuts = packing.cut(pa.array([f"a {c} b" for c in every], pa.large_string()))
    for c, parts in zip(every, cuts.to_pylist(), strict=True):
        code = ord(c)
        assert (len(parts) == 3) != c.isspace(), hex(code)
        if len(parts) == 3:
            starts = {a for _, (a, _) in library(f"a {c} 1{c} !{c} ")}
            assert {1, 3, 6, 9} <= starts, hex(code)


@pytest.mark.parametrize("text", [" " * 2_000_000, " " * 1_000_000 + "x", "\n \t" * 300_000, "a" * 1_000_000, "!" * 1_000_000])
def test_long_runs(docs, text):
    pieces = packing.pack_documents(docs([(1, text)])).collect()
    assert sum(p["length"] for p in pieces) == len(expected([(1, text)])[0][1])


def test_few_known_words(monkeypatch):
    monkeypatch.setattr(packing, "MAX_KNOWN", 3)
    rows = [(1, "a b c d e"), (2, "e f g " + "h" * 100), (3, "a b h" + " i" * 5)]
    encode = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    for _ in range(2):
        assert [[*ids.tolist(), 0] for ids in encode([t for _, t in rows])] == [ids for _, ids in expected(rows)]


def test_words_used_again_are_kept(monkeypatch):
    monkeypatch.setattr(packing, "MAX_KNOWN", 8)
    encode = packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    for text in ("x the cat a b c", "x the cat d e", "x f g h", "x the i j k l m", "x the cat n o p"):
        assert [[*ids.tolist(), 0] for ids in encode([text])] == [ids for _, ids in expected([(1, text)])]
        assert encode.once <= set(encode.known) and len(encode.known) <= 8
        if text == "x f g h":
            assert {"the", "cat", "f", "g", "h"} == set(encode.known)


def windows(rows, tasks):
    """(closed by placement, closed by a cut, ids, padding) of documents dealt to tasks."""
    placed = cut = ids = padding = 0
    for task in range(tasks):
        packer, fills = packing.Packer(1024, 0), {}
        for k, n in enumerate(rows[task::tasks]):
            for piece in packer.place((k, n), 0, np.zeros(n, "<u4")):
                fills[piece[5]] = fills.get(piece[5], 0) + piece[2]
        for piece in packer.finish():
            fills[piece[5]] = fills.get(piece[5], 0) + piece[2]
        placed, cut, ids = placed + packer.placed, cut + packer.cut, ids + sum(fills.values())
        padding += sum(1024 - n for n in fills.values() if n & (n - 1))
    return placed, cut, ids, padding


@pytest.mark.parametrize(("tasks", "share"), [(1, 0.9), (4, 0.8), (32, 0.4)])
def test_placement_closes_windows(tasks, share):
    """Where a task holds many documents, placement closes most windows; nothing is padded."""
    rows = np.minimum(np.random.default_rng(3).lognormal(5.3, 0.8, 40_000).astype(int) + 1, 1023).tolist()
    placed, cut, ids, padding = windows(rows, tasks)
    assert ids == sum(rows) and padding == 0
    assert placed / (placed + cut) >= share, (placed, cut)


def test_sizes_that_never_fit(docs):
    """Documents of 600 ids leave no window that placement could fill."""
    packer, ids = packing.Packer(1024, 0, max_open=50), 0
    for k in range(500):
        ids += sum(p[2] for p in packer.place((k, 600), 0, np.zeros(600, "<u4")))
        assert packer.count <= 51
    assert ids + sum(p[2] for p in packer.finish()) == 300_000


def test_small_tasks_are_joined(docs, spark, tmp_path):
    docs([(k, "some words here") for k in range(100)]).repartition(16).write.parquet(str(tmp_path / "d"))
    pieces = packing.pack_documents(spark.read.parquet(str(tmp_path / "d")))
    assert pieces.rdd.getNumPartitions() == 1 and pieces.count() >= 100
