"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact verification."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import majority_bits
from .tables import keeps_names, saved, slices
from .words import batch_words, mixed, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Two texts at similarity 0.8 differ in 9.7 of 64 bits on average, with a
#: deviation of 2.9; the radius is 4.6 deviations above.
RADIUS = 23
BLOCKS = 8
#: Items and bytes of text of an index; a larger benchmark is searched in several.
MAX_ITEMS, MAX_BYTES = 4096, 16 << 20
#: Leading bits of the shingle hashes in the filter that the texts pass if there are more items.
FILTER_BITS = 26
BATCH_BYTES = 4 << 20
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"


def filter_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which leading ``bits`` of a hash occur."""
    out = np.zeros(1 << bits, bool)
    out[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def short_items(ids: list[int], hashes: np.ndarray, sizes: np.ndarray, shingle: int) -> dict[int, tuple[np.ndarray, dict[int, list[int]]]]:
    """Items of fewer words than a shingle, by their number of words: the hashes of the whole items, sorted, and the items of each."""
    out = {}
    ends = np.cumsum(sizes)
    for width in range(1, shingle):
        at = np.flatnonzero(sizes == width)
        if len(at):
            words = np.concatenate([hashes[ends[k] - width : ends[k]] for k in at.tolist()])
            whole = shingle_hashes(words, np.full(len(at), width), width)[0]
            items = defaultdict(list)
            for k, h in zip(at.tolist(), whole.tolist(), strict=True):
                items[h].append(ids[k])
            out[width] = (np.array(sorted(items), np.uint64), dict(items))
    return out


class ItemIndex:
    """Fingerprints of benchmark items in Hamming blocks.

    A fingerprint has eight blocks of eight bits; two fingerprints within
    radius 23 agree up to two bits in at least one block. ``near[b][v]`` marks
    the items whose block ``b`` is within two bits of ``v``, so the union over
    the blocks holds every item within the radius. Items of fewer words than a
    shingle are kept apart: their window is one shingle, its hash the print.
    """

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int):
        self.shingle, self.radius = shingle, radius
        hashes, sizes = batch_words(pa.array([t for _, t in items], pa.string()))
        shingles, counts = shingle_hashes(hashes, sizes, shingle)
        ends = np.cumsum(counts)
        full = [(i, shingles[e - c : e], n) for (i, _), e, c, n in zip(items, ends, counts, sizes, strict=True) if n >= shingle]
        self.short = short_items([i for i, _ in items], hashes, sizes, shingle)
        self.ids = [i for i, _, _ in full]
        self.weights = [Counter(s.tolist()) for _, s, _ in full]
        self.sizes = np.array([len(s) for _, s, _ in full], np.int64)
        self.prints = majority_bits(mixed(np.concatenate([s for _, s, _ in full])), self.sizes) if full else np.zeros(0, np.uint64)
        octets = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        values = np.arange(256, dtype=np.uint8)
        self.near = [np.bitwise_count(values[:, None] ^ octets[None, :, b]) <= radius // BLOCKS for b in range(BLOCKS)]
        lengths = defaultdict(set)
        for _, s, _ in full:
            for h in set(s.tolist()):
                lengths[h].add(len(s))
        self.known = np.array(sorted(lengths), np.uint64)
        self.lengths = [sorted(lengths[h]) for h in self.known.tolist()]
        self.filter = filter_of(self.known, 20)

    def candidates(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all within the radius with the item's size."""
        octets = prints.view(np.uint8).reshape(-1, BLOCKS)
        found = self.near[0][octets[:, 0]]
        for b in range(1, BLOCKS):
            found |= self.near[b][octets[:, b]]
        found &= sizes[:, None] == self.sizes[None, :]
        window, item = np.nonzero(found)
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        keep = distance <= self.radius
        return window[keep], item[keep], distance[keep]

    def search(self, shingles: np.ndarray, similarity: float) -> Iterator[tuple]:
        """(item_id, first shingle, shingles, distance, similarity): the best window of each item in one text.

        A window without a shingle of the item has similarity zero, so only
        windows that hold one are fingerprinted.
        """
        n = len(shingles)
        hits = np.flatnonzero(self.filter[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(hits):
            return
        at = np.searchsorted(self.known, shingles[hits])
        real = at < len(self.known)
        real[real] = self.known[at[real]] == shingles[hits][real]
        wanted = defaultdict(list)
        for p, k in zip(hits[real].tolist(), at[real].tolist(), strict=True):
            for size in self.lengths[k]:
                wanted[size].append(p)
        best: dict[int, tuple] = {}
        for size, places in wanted.items():
            width = min(size, n)
            marks = np.zeros(n + 1, np.int64)
            low = np.clip(np.array(places) - width + 1, 0, n - width)
            high = np.minimum(np.array(places), n - width)
            np.add.at(marks, low, 1)
            np.add.at(marks, high + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            for part in np.array_split(starts, -(-len(starts) // 2048)):
                grams = mixed(shingles[part[:, None] + np.arange(width)].ravel())
                prints = majority_bits(grams, np.full(len(part), width))
                for w, k, distance in zip(*self.candidates(prints, np.full(len(part), size)), strict=True):
                    start = int(part[w])
                    held, whole = Counter(shingles[start : start + width].tolist()), self.weights[k]
                    common = sum(min(c, whole[h]) for h, c in held.items() if h in whole)
                    score = common / (width + int(self.sizes[k]) - common)
                    if score >= similarity and (k not in best or (score, -start) > (best[k][3], -best[k][0])):
                        best[k] = (start, width, int(distance), score)
        for k, (start, width, distance, score) in best.items():
            yield self.ids[k], start, width, distance, score


def item_blocks(benchmark: DataFrame, max_items: int, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded count and size, streamed through the driver."""
    held, size = [], 0
    for row in benchmark.select(benchmark["item_id"].cast("long"), benchmark["text"]).where("text is not null").toLocalIterator():
        if held and (len(held) >= max_items or size + len(row[1]) > max_bytes):
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def word_leaks(index: ItemIndex, hashes: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple]:
    """(row, item_id, start_word, n_words, distance, similarity) of texts given as word hashes."""
    shingles, counts = shingle_hashes(hashes, sizes, index.shingle)
    maybe = np.flatnonzero(index.filter[(shingles >> np.uint64(44)).astype(np.int64)])
    ends = np.cumsum(counts)
    for k in np.unique(np.searchsorted(ends, maybe, side="right")).tolist():
        for item, start, width, distance, score in index.search(shingles[ends[k] - counts[k] : ends[k]], similarity):
            yield k, item, start, min(width + index.shingle - 1, int(sizes[k])), distance, score
    for width, (known, items) in index.short.items():
        shingles, counts = shingle_hashes(hashes, sizes, width)
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        hits = np.flatnonzero(known[at] == shingles)
        ends = np.cumsum(counts)
        found = set()
        for p, k in zip(hits.tolist(), np.searchsorted(ends, hits, side="right").tolist(), strict=True):
            if sizes[k] >= width and (k, at[p]) not in found:  # the first place of each
                found.add((k, at[p]))
                for item in items[int(shingles[p])]:
                    yield k, item, p - int(ends[k] - counts[k]), width, 0, 1.0


LEAK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
LEAK_NAMES = ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"]


def leak_rows(ids: list, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows = [(ids[k], *rest) for k, *rest in found]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), LEAK_TYPES, strict=True)], LEAK_NAMES)


def any_filter(benchmark: DataFrame, shingle: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Filters of the hashes of all items' shingles, and of the short items by width; of one size for any benchmark."""
    long, short = np.zeros(1 << FILTER_BITS, bool), {}
    for items in item_blocks(benchmark, MAX_ITEMS, MAX_BYTES):
        hashes, sizes = batch_words(pa.array([t for _, t in items], pa.string()))
        shingles, counts = shingle_hashes(hashes, sizes, shingle)
        long |= filter_of(shingles[np.repeat(sizes >= shingle, counts)], FILTER_BITS)
        for width, (known, _) in short_items([0] * len(items), hashes, sizes, shingle).items():
            short[width] = short.get(width, False) | filter_of(known, 20)
    return long, short


def suspects(docs: DataFrame, benchmark: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key_a, key_b, words): the documents that share a shingle with any item, as word hashes, from one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(any_filter(benchmark, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, short = shared.value
        for batch in slices(batches, "text", BATCH_BYTES):
            hashes, sizes = batch_words(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for width, marks in ((shingle, long), *short.items()):
                shingles, counts = shingle_hashes(hashes, sizes, width)
                hits = np.flatnonzero(marks[(shingles >> np.uint64(64 - (len(marks).bit_length() - 1))).astype(np.int64)])
                keep[np.searchsorted(np.cumsum(counts), hits, side="right")] = True
            ends = np.cumsum(sizes)
            words = [hashes[ends[k] - sizes[k] : ends[k]].tobytes() for k in np.flatnonzero(keep).tolist()]
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(words, pa.binary())], ["doc_id", "key_a", "key_b", "words"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), F.col("text").alias("text"))
    out = saved(out.mapInArrow(run, "doc_id long, key_a long, key_b long, words binary"), "suspects")
    shared.destroy()
    return out


def text_keys() -> list[F.Column]:
    """Two hashes that name a text."""
    return [F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b")]


def suspect_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, word hashes, words per text)."""
    for batch in slices(batches, "words", BATCH_BYTES):
        words = batch.column(batch.schema.get_field_index("words")).to_pylist()
        yield batch, np.frombuffer(b"".join(words), np.uint64), np.array([len(w) // 8 for w in words], np.int64)


def blocks_or_one(benchmark: DataFrame) -> tuple[list[tuple[int, str]], bool]:
    """The first block of items, and whether there are more."""
    blocks = item_blocks(benchmark, MAX_ITEMS, MAX_BYTES)
    return next(blocks, []), next(blocks, None) is not None


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Benchmark items that a window of a document repeats.

    Returns one row per (document row, item): doc_id, item_id, start_word,
    n_words, hamming, similarity of the most similar window of the item's size
    (the first one on ties). Texts are compared by words in lower case without
    punctuation; similarity is the sum of the lesser over the sum of the
    greater counts of five-word shingles, and ``similarity`` or more is kept.
    An item of fewer than five words is found wherever its words stand in a
    row. Null and empty texts and items match nothing; null ids and repeated
    documents or items are reported each; an empty table gives no rows.

    The texts are read once. If the items fit one index (``MAX_ITEMS`` items,
    ``MAX_BYTES``), that is all, without a shuffle. Else that pass writes the
    word hashes of the documents that share a shingle with any item, and only
    those are searched by one index after the other; each is dropped before
    the next is sent, and the rows are the same.
    """
    first, more = blocks_or_one(benchmark)
    context = docs.sparkSession.sparkContext
    if not more:
        shared = context.broadcast(ItemIndex(first, shingle, radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", BATCH_BYTES):
                yield from leak_rows(batch.column(0).to_pylist(), word_leaks(shared.value, *batch_words(batch.column(1)), similarity))

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, SCHEMA)
    some = suspects(docs, benchmark, shingle)
    out = None
    for items in item_blocks(benchmark, MAX_ITEMS, MAX_BYTES):
        shared = context.broadcast(ItemIndex(items, shingle, radius))

        def run_words(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, hashes, sizes in suspect_batches(batches):
                yield from leak_rows(batch.column(0).to_pylist(), word_leaks(shared.value, hashes, sizes, similarity))

        found = saved(some.select("doc_id", "words").mapInArrow(run_words, SCHEMA), "leaks")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


@keeps_names
def without_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The document rows in which no benchmark item is found, all columns kept.

    The rules are those of ``find_leaks``. With one index rows are judged where
    they are read; with more, the texts that leak are found first and then
    left out by their keys.
    """
    first, more = blocks_or_one(benchmark)
    context = docs.sparkSession.sparkContext
    if not more:
        shared = context.broadcast(ItemIndex(first, shingle, radius))
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", BATCH_BYTES):
                keep = np.ones(batch.num_rows, bool)
                keep[[k for k, *_ in word_leaks(shared.value, *batch_words(batch.column(at)), similarity)]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    left = suspects(docs, benchmark, shingle).dropDuplicates(["key_a", "key_b"]).select("key_a", "key_b", "words")
    gone = None
    for items in item_blocks(benchmark, MAX_ITEMS, MAX_BYTES):
        shared = context.broadcast(ItemIndex(items, shingle, radius))

        def run_words(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, hashes, sizes in suspect_batches(batches):
                leaks = np.zeros(batch.num_rows, bool)
                leaks[[k for k, *_ in word_leaks(shared.value, hashes, sizes, similarity)]] = True
                yield batch.select(["key_a", "key_b"]).filter(pa.array(leaks))

        found = saved(left.mapInArrow(run_words, "key_a long, key_b long"), "leaking-texts")
        shared.destroy()
        gone = found if gone is None else gone.unionByName(found)
    gone = gone.select(F.col("key_a").alias("__key_a"), F.col("key_b").alias("__key_b"))
    key_a, key_b = text_keys()
    return docs.join(gone, (key_a == F.col("__key_a")) & (key_b == F.col("__key_b")), "left_anti")
