"""Centroid clustering against a loop in Python integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from fovea.llm import centroids

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, scale, d, seed="1"):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(p[2] for p in placed)
    of = lambda j: sum(p[2] for p in placed if p[1] == j)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted((i, j, d, of(j), total, digest[j]) for i, j, d in placed if i is not None), sum(i is None for i, _, _ in placed)


def found(df):
    rows = [tuple(r) for r in df.collect()]
    return sorted(r for r in rows if r[0] is not None), sum(r[0] is None for r in rows)


def test_like_the_loop(spark):
    """Repeated rows and ids, ties, nulls, other sizes, clashing names."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    rows += rows[:5] + [(7, [0.5] * 4), (200, None), (201, [1.0, None, 2.0, 3.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [1.0]), (205, []), (None, [0.25] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("cluster", "distance", "id", "v", "h", "k", "inertia"):
        df = df.withColumn(name, F.lit(1))
    assert found(centroids.cluster(df.repartition(5), 6, 3, 64, 4)) == plain(rows, 6, 3, 64, 4)


@pytest.mark.parametrize("size", [1e6, 1e9, 1e30])
def test_beyond_exact_floats(spark, size):
    """Products over 2**53 go through longs, those over 2**63 through Python integers; what no long holds is null."""
    rng = random.Random(5)
    rows = [(i, [float(int(rng.uniform(-1, 1) * size)) for _ in range(3)]) for i in range(40)] + [(90, [0.1, 0.2, -0.3])]
    want, _ = plain(rows, 4, 3, 64, 3)
    fit = lambda v: v if v < 2**63 else None
    got, _ = found(centroids.cluster(spark.createDataFrame(rows, SCHEMA), 4, 3, 64, 3))
    want = [(i, j, fit(d), of, total, digest) for i, j, d, of, total, digest in want]
    assert [(r[:3], r[5]) for r in got] == [(r[:3], r[5]) for r in want]
    whole = all(r[2] is not None for r in want)
    assert all(r[4] == (fit(w[4]) if whole else None) for r, w in zip(got, want, strict=True))


def test_few_and_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0])]
    assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA), 16, 3, 64, 2)) == plain(rows, 16, 3, 64, 2)
    for none in ([], [(1, None), (2, [1.0])], [(None, [1.0, 2.0])]):
        out = centroids.cluster(spark.createDataFrame(none, SCHEMA), 16, 3, 64, 2)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame(rows, SCHEMA), 1 << 20, dimension=1 << 10)


def test_block_size_does_not_matter(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(8)]) for i in range(100)]
    monkeypatch.setattr(centroids, "BLOCK", 24)
    assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA), 5, 2, 32, 8)) == plain(rows, 5, 2, 32, 8)
