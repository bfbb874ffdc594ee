"""Words of a batch of texts as arrays of hashes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_KNOWN = 200_000
_EDGES = re.compile(r"[\W_]+")
_known: dict[str, int] = {}

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    """Hash of a lower-case word without its punctuation; 0 if nothing is left."""
    import xxhash

    known = _known.get(word)
    if known is None:
        if len(_known) > MAX_KNOWN:
            _known.clear()
        core = _EDGES.sub("", word)
        known = (xxhash.xxh64_intdigest(core.encode()) or 1) if core else 0
        if len(word) <= 64:
            _known[word] = known
    return known


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words per text): lower case, split at white space, without punctuation."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    each = np.fromiter((word_hash(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    hashes = each[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    keep = hashes != 0
    return hashes[keep], np.bincount(owner[keep], minlength=len(texts))


def shingle_hashes(hashes: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the k-word shingles in order, shingles per text); a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    counts = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(sizes.dtype))
    ends = np.cumsum(sizes)
    first = ends - sizes
    starts = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    limit = np.repeat(ends, counts)
    if not n:
        return np.zeros(0, np.uint64), counts
    padded = np.append(hashes, np.zeros(k, np.uint64))
    short = np.repeat(np.maximum(k - sizes, 0), counts)
    out = padded[starts]
    for j in range(1, k):
        word = padded[starts + j]
        if short.any():
            word = np.where(starts + j < limit, word, np.uint64(0))
        out = out * MIX[0] + word
    return mixed(out), counts
