"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, anchors, k=5, scale=256, share=80):
    sound = lambda r: None not in r and all(x is not None and math.isfinite(x) for x in r[2])
    whole = lambda r: (r[0], r[1], [math.floor(float(np.float32(x)) * scale) for x in r[2]])
    own = [whole(r) for r in rows if sound(r)]
    asked = {}
    for r in anchors:
        if sound(r) and (r[0] not in asked or (r[2], r[1]) < (asked[r[0]][2], asked[r[0]][1])):
            asked[r[0]] = r
    out = []
    for a in map(whole, asked.values()):
        near = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in own if r[0] != a[0] and len(r[2]) == len(a[2]))
        for score, positive, _ in [n for n in near if n[2] == a[1]][:k]:
            fine = [n for n in near if n[2] != a[1] and share * -score <= 100 * -n[0] <= 100 * -score][:k]
            out += [(a[0], positive, rank, n[1], -score, -n[0]) for rank, n in enumerate(fine, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n=300, d=6, spots=5, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(spots, d))
    x = centres[rng.integers(0, spots, n)] + spread * rng.normal(size=(n, d))
    return [(i, int(y), [float(v) for v in row.astype(np.float32)]) for i, (row, y) in enumerate(zip(x, rng.integers(0, 4, n), strict=True))]


HARD = [(900, None, [1.0] * 6), (901, 1, None), (902, 1, [1.0, None] * 3), (903, 1, [float("nan")] * 6), (904, 2, [float("inf")] * 6), (None, 1, [1.0] * 6), (905, 1, [1.0, 2.0]), (906, 2, [1.0, 2.0]), (907, 1, []), (908, 2, [])]


@pytest.mark.parametrize("seed", [1, 2])
def test_like_all_pairs(spark, seed):
    """Ties, repeated rows and ids, nulls, other sizes, clashing names."""
    rows = made(seed)
    rows += rows[:20] + [(400 + i, 1 + i % 2, rows[3][2]) for i in range(30)] + [(10, 3, rows[50][2])] + HARD
    anchors = [r for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] > 900)]
    df = [spark.createDataFrame(t, SCHEMA) for t in (rows, anchors)]
    for name in ("id", "v", "d", "score", "rank", "place", "part", "pivot", "salt", "low", "goals", "anchor_id"):
        df = [t.withColumn(name, F.lit("x")) for t in df]
    assert found(H.hard_negatives(df[0].repartition(3), df[1])) == plain(rows, anchors)


def test_cuts_do_not_matter(spark, monkeypatch):
    """Small blocks, many salts and little held at once give the same rows."""
    rows = made(4, 200)
    anchors = [r for r in rows if r[0] % 7 == 0]
    want = plain(rows, anchors)
    monkeypatch.setattr(H, "BLOCK", 7)
    monkeypatch.setattr(H, "SALT_ROWS", 30)
    monkeypatch.setattr(H, "HELD", 8 * 6 * 20)
    monkeypatch.setattr(H, "SAMPLE", 12)
    assert found(H.hard_negatives(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(anchors, SCHEMA))) == want


def test_one_vector_for_all(spark):
    """All rows alike: every score ties, every pivot is the same."""
    rows = [(i, i % 3, [0.5, 0.25]) for i in range(60)]
    anchors = rows[::6]
    assert found(H.hard_negatives(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(anchors, SCHEMA))) == plain(rows, anchors)


def test_none(spark):
    rows, none = spark.createDataFrame(made(1, 30), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(none, none).collect() == [] == H.hard_negatives(rows, none).collect() == H.hard_negatives(none, rows).collect()
    with pytest.raises(ValueError):
        H.hard_negatives(spark.createDataFrame([(1, 1, [1e20])], SCHEMA), spark.createDataFrame([(1, 1, [1e20])], SCHEMA))


def spaced(rows, pivots, top):
    return H.Space.of(rows[:pivots], top, 1)


def test_bounds_never_lose_and_spare_most_on_clustered_rows():
    """A candidate within an anchor's reach is always sent to its group; on tight clusters less than half of the others are."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16)) * 200
    x = np.floor(centres[rng.integers(0, 12, 2000)] + 8 * rng.normal(size=(2000, 16)))
    q = np.floor(centres[rng.integers(0, 12, 40)] + 8 * rng.normal(size=(40, 16)))
    top = int((x * x).sum(1).max())
    space, scores = spaced(x, 24, top), q @ x.T
    low = np.partition(scores, -5, axis=1)[:, -5]
    bounds = H.Bounds.none(24, 1)
    pivot = bounds.add(space, q, np.zeros(40, int), low, np.full(40, np.inf))
    sent = {g: set(at.tolist()) for g, _, at in bounds.serves(space, x, None)}
    for k in range(40):
        assert set(np.flatnonzero(scores[k] >= low[k]).tolist()) <= sent[pivot[k]]
    copies = sum(map(len, sent.values()))
    assert copies < 0.5 * len(x) * len(set(pivot.tolist()))
