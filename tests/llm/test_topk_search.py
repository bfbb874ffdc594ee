import numpy as np
import pytest
from helpers import DATA, oracle, same_rows

from fovea.llm import queries, topk_search

SCHEMA = "vec_id long, embedding array<float>, score int, d int"


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2) for i, x in rows], SCHEMA)


def brute(vectors, asked, k=10):
    sound = lambda x: x is not None and all(v is not None and np.isfinite(v) for v in x)
    q = {}
    for i, x in asked:
        if i is not None and sound(x):
            q[i] = min(q.get(i, x), x)
    out = []
    for i, x in q.items():
        a = np.floor(np.array(x, np.float32).astype(float) * 1024).astype(np.int64)
        found = []
        for j, y in vectors:
            if j is not None and j != i and sound(y) and len(y) == len(x):
                b = np.floor(np.array(y, np.float32).astype(float) * 1024).astype(np.int64)
                found.append((-int(a @ b), j))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_random_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk_search, "BATCH_BYTES", 200 if block == 64 else 16 << 20)  # several batches of queries
    rng = np.random.default_rng(1)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=8).round(1)]) for k in range(400)]  # many ties
    rows += [(k, rows[3][1]) for k in range(400, 460)]  # copies
    asked = rows[::20]
    got = sorted(tuple(r) for r in topk_search.top_k(table(spark, rows), table(spark, asked)).collect())
    assert got == brute(rows, asked)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [-3.25, 0.1]), (7, [-3.25, 0.1]), (None, [1.0, 1.0]), (8, []), (9, []), (6, [2.0]), (10, [4.0])]
    got = sorted(tuple(r) for r in topk_search.top_k(table(spark, rows), table(spark, rows)).collect())
    assert got == brute(rows, rows)


def test_empty(spark):
    none = table(spark, [])
    some = table(spark, [(1, [1.0])])
    assert topk_search.top_k(none, none).count() == 0
    assert topk_search.top_k(some, none).count() == 0
    assert topk_search.top_k(none, some).count() == 0


def test_bounds_hold_while_lists_are_read():
    """Lists are read from their fronts on, each entry once; at each depth bounds hold, and sums are those of the entries reached."""
    rng = np.random.default_rng(5)
    x, q = rng.integers(-50, 50, (301, 6)) + np.array([0, 40, 0, -90, 0, 0]), rng.integers(-50, 50, (4, 6))
    q[3, 2] = 0
    lists, true = topk_search.SortedLists(x), x @ q.T
    known, unread, width = np.tile(q @ lists.centre, (301, 1)), np.ones((301, 6), bool), np.inf
    reading = topk_search.Reading(q, lists)
    for turn, share in enumerate(topk_search.SHARES):
        reading.advance()
        for j, at, away in lists.entries(turn):
            assert unread[at, j].all() and (away == x[at, j] - lists.centre[j]).all()
            unread[at, j] = False
            known[at] += away[:, None] * q[:, j]
        far = np.abs(x - lists.centre)
        assert all(far[unread[:, j], j].max(initial=0) == lists.fronts[turn + 1, j] <= far[~unread[:, j], j].min(initial=999) for j in range(6))
        assert (~unread).mean() >= share - 0.01
        assert known == pytest.approx(reading.known) and (unread @ (q**2).T) == pytest.approx(reading.left)
        assert (unread * far**2).sum(axis=1) == pytest.approx(lists.left[turn + 1])
        lower, upper = reading.bounds()
        assert (lower <= true).all() and (true <= upper).all()
        assert (upper - lower).max() <= width + 0.01
        width = (upper - lower).max()
    assert not unread.any() and width < 0.01


def scaled(x):
    return np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)


def stops(x, q, k=10, block=4096):
    """(entries read, candidates left, entries, candidates) of each query and block; what is found is right."""
    best, out = topk_search.Best(len(q), k), []
    for a in range(0, len(x), block):
        part = x[a : a + block]
        at = topk_search.search_block(q, np.full(len(q), -1), topk_search.SortedLists(part), np.arange(a, a + len(part)), best)
        out += [(read, left, part.size, len(part)) for read, left in at.tolist()]
    true = q @ x.T
    for r, (scores, ids) in enumerate(best.found):
        want = np.lexsort((np.arange(len(x)), -true[r]))[:k]
        assert ids.tolist() == want.tolist() and scores.tolist() == true[r][want].tolist()
    return np.array(out)


def test_bounds_exclude_clustered_candidates():
    """On clustered vectors over nine in ten are excluded by bounds with under half of the entries read."""
    rng = np.random.default_rng(6)
    x = scaled(rng.normal(size=(20, 64))[rng.integers(0, 20, 12_000)] + 0.15 * rng.normal(size=(12_000, 64)))
    read, left, entries, candidates = stops(x, x[::200]).sum(axis=0)
    assert left <= 0.1 * candidates and read < 0.5 * entries


def test_bounds_exclude_random_candidates():
    """On vectors without any structure bounds exclude as many, with more of the entries read."""
    x = scaled(np.random.default_rng(7).normal(size=(20_000, 64)))
    read, left, entries, candidates = stops(x, x[::400]).sum(axis=0)
    assert left <= 0.1 * candidates and read < 0.8 * entries


def test_huge_components(spark):
    """Bounds hold where products are beyond the exact range of doubles."""
    rng = np.random.default_rng(8)
    x = rng.integers(-(1 << 28), 1 << 28, (500, 8))
    stops(x, x[::50], k=5, block=100)


def test_oracle(spark):
    name = "op1_no_random_access_top_k"
    same_rows(queries.QUERIES[name](spark, DATA), oracle(), queries.ORACLES[name])
