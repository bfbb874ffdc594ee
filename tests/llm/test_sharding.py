import zlib

from helpers import DATA, oracle, same_rows
from llm.conftest import hard_rows

from fovea.llm import queries, sharding


def check(df, rows, shards=16):
    got = df.collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    bytes_of = dict.fromkeys(range(shards), 0)
    for shard in {r["shard"] for r in got}:
        mine = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        bytes_of[shard] = sum(r["size"] for r in mine)
    if got:
        target = sum(bytes_of.values()) / shards
        assert all(abs(n - target) <= max(r["size"] for r in got) + 1 for n in bytes_of.values())


def test_hard_rows(docs):
    check(sharding.shard_by_bytes(docs(hard_rows(), clashing=True)), hard_rows())


def test_many_repeated_rows(docs):
    rows = [(5, "same")] * 300 + [(k, "x" * (k % 50)) for k in range(600)]
    check(sharding.shard_by_bytes(docs(rows), 7), rows, 7)


def test_empty(docs):
    assert sharding.shard_by_bytes(docs([])).count() == 0


def test_contiguous(docs):
    got = sharding.shard_by_bytes(docs([(k, "y" * (k % 9)) for k in range(500)])).orderBy("doc_id").collect()
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)


def test_oracle(spark):
    name = "op5_byte_balanced_shards"
    same_rows(queries.QUERIES[name](spark, DATA), oracle(), queries.ORACLES[name])
