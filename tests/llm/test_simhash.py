import random

import pytest
import xxhash
from llm.conftest import hard_rows

from fovea.llm import simhash


def brute_print(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[a : a + k]) for a in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(prints))]


def check(df, rows):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_classes(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), f"{p:016x}", str(least.get(r))) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in df.collect()) == want


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def test_hard_rows(docs):
    check(simhash.near_duplicates(docs(hard_rows(), clashing=True)), hard_rows())


def test_copies_and_near_copies(docs):
    rng = random.Random(4)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows += [(len(rows) + k, edited(rng, base, k % 3)) for k in range(6)]
    check(simhash.near_duplicates(docs(rows)), rows)


def test_empty(docs):
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("salts", [1, 5])
def test_a_fingerprint_that_holds_most_rows(docs, monkeypatch, salts):
    """Empty texts and copies of one text in many rows, null and repeated ids among them, whatever the number of parts."""
    monkeypatch.setattr(simhash, "SALTS", salts)
    rows = [(k, None if k % 3 else " ") for k in range(40)] + [(k, "one text of six words here") for k in range(40, 90)] + [(None, ""), (7, ""), (7, ""), (95, "another text altogether")]
    check(simhash.near_duplicates(docs(rows)), rows)


@pytest.mark.parametrize("hot", [2, 2048])
def test_links_are_whole(spark, hot):
    """Chains of near prints, with and without dealing out the hot buckets."""
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            for _ in range(rng.randrange(1, 5)):
                v ^= 1 << rng.randrange(64)
    values = sorted(values)
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_links(table, hot=hot).collect()]
    at = {v: k for k, v in enumerate(values)}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 64
        parent[find(at[a])] = find(at[b])
    want = brute_classes(values)
    pairs = lambda roots: {(a, b) for a in range(len(values)) for b in range(a) if roots[a] == roots[b]}
    assert pairs([find(k) for k in range(len(values))]) == pairs(want)


def test_majority_bits_of_long_groups():
    import numpy as np

    rng = np.random.default_rng(0)
    sizes = np.array([1, 2, 255, 256, 1000, 3])
    hashes = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got, at = simhash.majority_bits(hashes, sizes), 0
    for size, value in zip(sizes.tolist(), got.tolist(), strict=True):
        mine = hashes[at : at + size].tolist()
        assert value == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mine) > size)
        at += size
