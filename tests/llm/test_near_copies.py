import random
from itertools import combinations

import pyarrow as pa
import pytest
from llm.conftest import hard_rows
from pyspark.sql import functions as F

from fovea.llm import near_copies


def kept(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


def test_copies_go_and_others_stay(docs):
    rng = random.Random(2)
    rows, alone = [], []
    for g in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((10 * g, " ".join(words)))
        if g % 3 == 0:
            rows.append((10 * g + 1, " ".join(words)))
            near = list(words)
            near[rng.randrange(120)] = "changed"  # similarity 111 / 121
            rows.append((10 * g + 2, " ".join(near)))
        alone.append(10 * g)
    assert [int(i) for i, _ in sorted(kept(near_copies.one_of_each(docs(rows))), key=lambda x: int(x[0]))] == alone


def test_hard_rows(docs):
    df = docs(hard_rows(), clashing=True)
    out = near_copies.one_of_each(df)
    assert out.columns == df.columns
    ids = [i for i, _ in kept(out)]
    # texts without words are copies of each other, one of null id among them; of repeated rows one stays
    assert sorted(ids) == sorted(["1", "4", "5", "6", "8", "9", "10", "11", "12", "None"])


def test_each_text_is_judged_by_itself(docs):
    """Rows of one id with different texts stay or go apart, and rows without an id take part."""
    same = "these are the words of a text that is here several times over"
    rows = [(1, "b text that is here once"), (1, "a text that is here once"), (2, "something else entirely now"), (5, same), (7, same), (7, "another text of the id that had a copy"), (None, same), (None, same + " "), (None, "no id and no copy anywhere"), (5, same)]
    want = [("1", "a text that is here once"), ("1", "b text that is here once"), ("2", "something else entirely now"), ("5", same), ("7", "another text of the id that had a copy"), ("None", "no id and no copy anywhere")]
    assert kept(near_copies.one_of_each(docs(rows, clashing=True))) == sorted(want)
    assert kept(near_copies.one_of_each(docs([(None, same), (None, same), (None, same.upper())]))) == [("None", min(same, same.upper(), key=lambda t: near_copies_key(docs, t)))]


def near_copies_key(docs, text):
    return docs([(None, text)]).select(F.xxhash64("text")).first()[0]


@pytest.mark.parametrize("salts", [1, 16])
def test_one_large_group(docs, monkeypatch, salts):
    """Exact copies and near copies of one text, half of all rows: the least id stays."""
    monkeypatch.setattr(near_copies, "SALTS", salts)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(words)) for k in range(200)] + [(200 + k, " ".join([*words[:k], "x", *words[k + 1 :]])) for k in range(100)] + [(1000 + k, f"text {k} by itself and like no other {k * k}") for k in range(300)]
    assert sorted(int(i) for i, _ in kept(near_copies.one_of_each(docs(rows)))) == [0, *range(1000, 1300)]


def test_empty(docs):
    assert near_copies.one_of_each(docs([])).count() == 0


def test_marks(docs, spark):
    df = docs([(k, "t") for k in range(300)] + [(None, "t")])
    keys = spark.range(0, 300, 7).select(F.xxhash64("id").alias("k"))
    marked = near_copies.with_mark(df, F.xxhash64("doc_id"), keys)
    got = {r["doc_id"] for r in marked.where("__may").collect()}
    assert set(range(0, 300, 7)) <= got and len(got) < 60
    assert near_copies.with_mark(df, F.xxhash64("doc_id"), keys.limit(0)).where("__may").count() == 0


def test_hot_shards(docs, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", 3)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*words[:k], "changed", *words[k + 1 :]])) for k in range(0, 200, 10)]
    assert near_copies.one_of_each(docs(rows)).count() == 1


def test_similarity_of_the_sets_decides(docs):
    """Pairs on both sides of 0.8: the prints of either may lie within some radius."""
    rng, rows, stay = random.Random(4), [], []
    for g in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        cut = 22 if g % 2 else 23  # 178 / 222 = 0.802 and 177 / 223 = 0.794
        near = [*words[:-cut], *(f"v{rng.randrange(10**6)}" for _ in range(cut))]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(near))]
        stay += [2 * g] if g % 2 else [2 * g, 2 * g + 1]
    assert sorted(int(i) for i, _ in kept(near_copies.one_of_each(docs(rows)))) == stay


def test_one_common_band_is_enough(docs, monkeypatch):
    """Pairs at 0.8 that meet in one shard only keep their link whatever the size of a shard is taken for."""
    rng, rows = random.Random(5), []
    while len(rows) < 6:
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        texts = [" ".join(words), " ".join([*words[:-22], *(f"v{k}" for k in range(22))])]  # 178 / 222
        keys = near_copies.wide_prints(pa.array(texts))[-1]
        if (keys[0] == keys[1]).sum() == 1:
            rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(near_copies, "HOT", 1)
    assert sorted(int(i) for i, _ in kept(near_copies.one_of_each(docs(rows)))) == [0, 2, 4]


def test_recall_by_similarity(docs):
    """Every pair of sf0.01 at 0.8 or more is in one group, none below is, by exact comparison of all pairs."""
    import pyarrow.parquet as pq
    from helpers import DATA

    table = pq.read_table(DATA.replace("0.001", "0.01") + "/documents.parquet", columns=["doc_id", "text"])
    rows = [(i, t) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)]
    sets = near_copies.wide_prints(table["text"].combine_chunks())[0]
    holders = {}
    for k, s in enumerate(sets):
        for h in s.tolist():
            holders.setdefault(h, []).append(k)
    common = {}
    for at in holders.values():
        for x in range(len(at)):
            for y in at[x + 1 :]:
                common[at[x], y] = common.get((at[x], y), 0) + 1
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [k for k, s in enumerate(sets) if not len(s)]
    pairs = [(a, b) for (a, b), n in common.items() if 9 * n >= 4 * (len(sets[a]) + len(sets[b]))] + [(empty[0], k) for k in empty[1:]]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)), key=lambda k: rows[k][0])
        root[b] = a
    want = sorted((str(i), str(t)) for k, (i, t) in enumerate(rows) if find(k) == k)
    assert len(pairs) > 10 and kept(near_copies.one_of_each(docs(rows))) == want


def test_shards_are_searched_by_trees(monkeypatch):
    """The groups of a shard are those of all pairs, each member is looked up in the BK-tree."""
    rng, prints, sizes = random.Random(6), [], []
    for g in range(12):
        base = rng.getrandbits(256)
        for _ in range(25):
            near = base
            for bit in rng.sample(range(256), rng.choice([0, 5, 30, 60, 90])):
                near ^= 1 << bit
            prints.append(near)
            sizes.append(rng.randrange(90, 140) if g % 2 else 100)
    kinds = sorted(set(prints))
    own = {p: [n for q, n in zip(prints, sizes, strict=True) if q == p] for p in kinds}
    root = {p: p for p in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(kinds, 2):
        fits = 4 * max(min(own[a]), min(own[b])) <= 5 * min(max(own[a]), max(own[b]))
        if (a ^ b).bit_count() <= near_copies.RADIUS and fits:
            root[find(a)] = find(b)
    want = {}
    for k, p in enumerate(prints):
        want.setdefault(find(p), []).append(k)
    searched, within = [], near_copies.BKTree.within

    def counted(tree, value):
        searched.append(value)
        return within(tree, value)

    monkeypatch.setattr(near_copies.BKTree, "within", counted)
    got = near_copies.tree_groups([p.to_bytes(32, "little") for p in prints], sizes)
    assert sorted(sorted(g) for g in got) == sorted(g for g in want.values() if len(g) > 1)
    assert len(searched) == len(kinds) - 1  # all but the root
