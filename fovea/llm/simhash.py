"""SimHash near-duplicates with BK-trees over shards that share fingerprint blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.operators.components import connected_components

from .tables import saved, slices

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Buckets with more fingerprints are dealt out by further blocks.
HOT = 2048
BATCH_BYTES = 4 << 20
#: Parts that the rows of one fingerprint or group are dealt to in joins.
SALTS = 4

#: Spreads the bits of a byte over the bytes of a word.
SPREAD = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of 64-bit hashes: the bits set in over half of each group's hashes."""
    parts = -(-sizes // 255)  # a byte counts up to 255
    first = np.cumsum(sizes) - sizes
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(first, parts) + 255 * inner
    groups = np.cumsum(parts) - parts
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(sizes), 8, 8), np.int64)
    for k in range(8):
        sums = np.add.reduceat(SPREAD[octets[:, k]], starts).view(np.uint8).reshape(-1, 8)
        counts[:, k] = np.add.reduceat(sums.astype(np.int64), groups)
    bits = 2 * counts.reshape(-1, 64) > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def text_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 of the word shingles of a text, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes both hold for ASCII only
    if not words:
        return []
    joined = b" ".join(words)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]


def fingerprint_texts(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints; a text without words has zero."""
    each = [text_hashes(t, shingle) for t in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    out = np.zeros(len(each), np.uint64)
    if sizes.any():
        hashes = np.fromiter((h for hs in each for h in hs), np.uint64, int(sizes.sum()))
        out[sizes > 0] = majority_bits(hashes, sizes[sizes > 0])
    return out


class BKTree:
    """Burkhard-Keller tree of a shard: children keyed by their Hamming distance to the parent.

    It also holds the groups of its values (union-find). A subtree whose values
    are all in the group of the value under search cannot add a link and is
    left out, so a large group of near copies costs few visits a value.
    ``linked`` is a further test that two values within the radius must pass.
    """

    def __init__(self, radius: int, linked: Callable[[int, int], bool] | None = None):
        self.radius, self.linked, self.root = radius, linked, None
        self.children: dict[int, dict[int, int]] = {}
        self.parent: dict[int, int] = {}
        self.mixed: set[int] = set()

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def within(self, value: int) -> Iterator[int]:
        """Values at the radius or nearer that may be of another group than ``value``.

        Only edges whose key differs from the distance by the radius at most
        can lead to them.
        """
        radius, todo = self.radius, [self.root]
        while todo:
            at = todo.pop()
            if at not in self.mixed and self.find(at) == self.find(value):
                continue
            distance = (at ^ value).bit_count()
            if distance <= radius:
                yield at
            for step, child in self.children[at].items():
                if -radius <= step - distance <= radius:
                    todo.append(child)

    def add(self, value: int) -> None:
        """Join the value with the groups near it and hang it into the tree."""
        if value in self.parent:
            return
        self.parent[value], self.children[value] = value, {}
        if self.root is None:
            self.root = value
            return
        for near in self.within(value):
            if self.linked is None or self.linked(near, value):
                a, b = self.find(near), self.find(value)
                self.parent[max(a, b)] = min(a, b)
        at = self.root
        while True:
            if self.find(at) != self.find(value):
                self.mixed.add(at)
            step = (at ^ value).bit_count()
            below = self.children[at].get(step)
            if below is None:
                self.children[at][step] = value
                return
            at = below


def bucket_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, least value of its group) that join the groups of a shard; fewer than its values."""
    tree = BKTree(radius)
    for value in values:
        tree.add(value)
    return [(v, tree.find(v)) for v in tree.parent if tree.find(v) != v]


def block_masks(bits: list[int], blocks: int) -> list[int]:
    """The given bit places cut into near-equal runs, as masks."""
    cuts = [len(bits) * k // blocks for k in range(blocks + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(fingerprints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links between distinct fingerprints (column fp, long) that join all within ``radius``.

    The 64 bits form ``radius + 2`` blocks; two fingerprints within the radius
    agree on two blocks at least, so each goes to the bucket of every pair of
    its blocks. Buckets are counted with map-side sums, lone members fall out
    in a join, and a bucket with over ``hot`` members is dealt out again by one
    of ``radius + 1`` blocks of its other bits, of which one must agree too.
    Each bucket is a shard with a BK-tree of its own, built and searched in the
    task that holds it. A shard sends fewer links than it has members.
    """
    masks = [a | b for a, b in combinations(block_masks(list(range(64)), radius + 2), 2)]
    keyed = fingerprints.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for k, m in enumerate(masks)))).alias("b")
    ).select("fp", "b.kind", "b.part")
    counts = keyed.groupBy("kind", "part").agg(F.count("*").alias("members")).where("members > 1")
    shared = keyed.join(counts, ["kind", "part"])

    def again(k: int, m: int) -> F.Column:
        free = block_masks([b for b in range(64) if not m >> b & 1], radius + 1)
        return F.when(
            F.col("kind") == k,
            F.array(*(F.struct(F.lit((k + 1) * 100 + i).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(m | f))).alias("part")) for i, f in enumerate(free))),
        )

    deeper = F.coalesce(*(again(k, m) for k, m in enumerate(masks)))
    plain = F.array(F.struct(F.col("kind"), F.col("part")))
    dealt = shared.select("fp", F.explode(F.when(F.col("members") <= hot, plain).otherwise(deeper)).alias("b")).select("b.kind", "b.part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values = None, []

        def links() -> pa.RecordBatch:
            pairs = bucket_links(values, radius)
            return pa.RecordBatch.from_arrays([pa.array(np.array([p[k] for p in pairs], np.uint64).view(np.int64)) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            kinds, parts, fps = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(parts) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(fps)]
            for a, z in zip(bounds, bounds[1:], strict=False):
                if a == z:
                    continue
                key = (kinds[a], parts[a])
                if key != held:
                    if len(values) > 1:
                        yield links()
                    held, values = key, []
                values += fps[a:z].view(np.uint64).tolist()
        if len(values) > 1:
            yield links()

    sorted_buckets = dealt.repartition("kind", "part").sortWithinPartitions("kind", "part", "fp")
    return sorted_buckets.mapInArrow(run, "a long, b long").distinct()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            fps = fingerprint_texts(batch.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Groups of documents whose fingerprints chain at ``radius`` or fewer bits.

    Returns one row per document: doc_id, fingerprint (16 hex digits),
    component_id (least doc_id of the group, itself included). Equal
    fingerprints are one node, so exact copies of any number cost one. Null and
    empty texts have the fingerprint zero and are grouped like any other; a
    null doc_id never names a group. Repeated rows are kept. The joins that name
    the groups are salted, as one fingerprint or group may hold much of the
    rows.
    """
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    firsts = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(near_links(firsts.select("fp"), radius))

    def salt(key: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    linked = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), salt("fp"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id")).select("root", "component_id", salts)
    classes = linked.join(least, ["root", "salt"]).select("fp", "component_id", salts)
    named = prints.select("doc_id", "fp", salt("doc_id")).join(classes, ["fp", "salt"])
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
