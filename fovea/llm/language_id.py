"""Languages of texts by a linear-chain conditional random field over words.

Words are labelled with languages by forward-backward, so a text that switches
between languages is labelled word by word; its language is the one with the
largest sum of marginals. A word's features are its character two- and
three-grams with word ends, its affixes, the word itself (all hashed into one
table) and its place in the lexicons learned from the sample; transitions are
learned with them.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slices

#: The model is fitted on at most this many labelled documents (those of least
#: hash), and on at most this many spans of words of each, spread over its text.
SAMPLE, SPANS, SPAN = 3000, 3, 30
#: Spans of different documents that make one training sequence.
SPLICED = 3
TABLE, LEXICON, ROUNDS, RATE, DECAY = 1 << 16, 300, 40, 0.2, 1e-4
CHUNK = 64
BATCH_BYTES = 6 << 20
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
LEFT, RIGHT = "\x02", "\x03"


def cores(words: list[str]) -> list[str]:
    """The letters of each (lower-case) word."""
    sub = _NOT_LETTERS.sub
    return [w if w.isalpha() else "".join(c for c in sub("", w) if c.isalpha()) for w in words]


def folded(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Feature numbers (from 1) of tuples of characters."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15 * (kind + 1) & (1 << 64) - 1, np.uint64)
    for part in parts:
        h = (h ^ part) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(TABLE - 1)).astype(np.int64) + 1


def word_features(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(per-word feature columns, gram features, starts of each word's grams, word hashes)."""
    joined = "".join(f"{LEFT}{w}{RIGHT}" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    place = np.arange(len(c)) - np.repeat(starts, sizes)
    left = np.repeat(ends, sizes) - np.arange(len(c))  # characters from here to the word's end
    tail = np.append(c, np.zeros(4, np.uint64))
    grams = np.empty((len(c), 2), np.int64)
    grams[:, 0] = np.where(left >= 2, folded(0, c, tail[1 : len(c) + 1]), 0)
    grams[:, 1] = np.where(left >= 3, folded(1, c, tail[1 : len(c) + 1], tail[2 : len(c) + 2]), 0)
    powers = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat((c + np.uint64(1)) * (c + np.uint64(0x51ED27)) * powers[place % 256] + (place // 256).astype(np.uint64), starts) if len(c) else np.zeros(0, np.uint64)
    head = [tail[np.minimum(starts + k, ends - 1)] for k in range(1, 5)]
    rear = [tail[np.maximum(ends - 1 - k, starts)] for k in range(1, 5)]
    single = [folded(2, *head[:3]), folded(3, *head), folded(4, *rear[:3]), folded(5, *rear), folded(6, whole)]
    return single, grams, starts, whole


def marginals(emission: np.ndarray, trans: np.ndarray, entry: np.ndarray | None, exit_: np.ndarray | None, live: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over (steps, lanes, labels) in lockstep.

    ``entry``: the forward vector before each lane, already moved by the
    transitions (None: flat); ``exit_``: the backward vector behind its last
    step (None: flat); ``live``: the steps that exist. Returns the marginals
    and the expected transitions.
    """
    steps, lanes, labels = emission.shape
    alpha = np.empty_like(emission)
    now = np.ones((lanes, labels), emission.dtype) if entry is None else entry
    for j in range(steps):
        new = (now if j == 0 else alpha[j - 1] @ trans) * emission[j]
        new /= new.sum(1, keepdims=True)
        alpha[j] = new if live is None or j == 0 else np.where(live[j][:, None], new, alpha[j - 1])
    beta = np.ones((lanes, labels), emission.dtype) if exit_ is None else exit_.copy()
    out = np.empty_like(emission)
    pairs = np.zeros((labels, labels))
    for j in range(steps - 1, -1, -1):
        gamma = alpha[j] * beta
        out[j] = gamma / gamma.sum(1, keepdims=True)
        if j:
            ahead = emission[j] * beta
            if entry is None:
                joint = alpha[j - 1][:, :, None] * trans * ahead[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            new = ahead @ trans.T
            new /= new.sum(1, keepdims=True)
            beta = new if live is None else np.where(live[j][:, None], new, beta)
    return out, pairs


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray
    trans: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    marks: np.ndarray  # (words of the lexicon, labels): in the lexicon of the label
    weights: np.ndarray  # of the lexicons, by (lexicon, label)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words by label."""
        single, grams, starts, whole = word_features(words)
        score = np.add.reduceat(self.table[grams[:, 0]] + self.table[grams[:, 1]], starts) if words else np.zeros((0, len(self.labels)), np.float32)
        for column in single:
            score += self.table[column]
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
            known = self.lexicon[at] == whole
            score[known] += self.marks[at[known]] @ self.weights
        return score

    def label_texts(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score (its mean marginal over the words) of whole texts."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        words = cores(coded.dictionary.to_pylist())
        real = np.array([bool(w) for w in words], bool)
        emission = np.zeros((len(words), len(self.labels)), np.float32)
        emission[real] = self.emissions([w for w in words if w])
        if len(words):
            emission = np.exp(np.maximum(emission - emission.max(1, keepdims=True), -40.0))
        codes = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        keep = real[codes] if len(codes) else np.zeros(0, bool)
        codes, owner = codes[keep], owner[keep]
        sizes = np.bincount(owner, minlength=len(texts))
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not len(codes):
            return names, scores
        sums = self.sums(emission, codes, sizes)
        best = sums.argmax(1)
        for k in np.flatnonzero(sizes).tolist():
            names[k] = self.labels[best[k]]
            scores[k] = min(1.0, sums[k, best[k]] / sizes[k])
        return names, scores

    def sums(self, emission: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of the marginals by text.

        The words are cut into chunks that run in lockstep. Each chunk's
        transfer matrix is formed first; the matrices of a text's chunks carry
        the forward and backward vectors from chunk to chunk, and the marginals
        inside the chunks follow.
        """
        labels = len(self.labels)
        parts = -(-sizes // CHUNK)
        lanes = int(parts.sum())
        first = np.cumsum(parts) - parts
        text_of = np.repeat(np.arange(len(sizes)), parts)
        nth = np.arange(lanes) - first[text_of]
        begin = (np.cumsum(sizes) - sizes)[text_of] + nth * CHUNK
        length = np.minimum(CHUNK, sizes[text_of] - nth * CHUNK)
        live = np.arange(CHUNK)[:, None] < length[None, :]
        at = np.where(live, begin[None, :] + np.arange(CHUNK)[:, None], 0)
        e = emission[codes[at]]
        trans = self.trans.astype(np.float32)
        most = int(parts.max())
        entry = np.ones((lanes, labels), np.float32)
        exit_ = np.ones((lanes, labels), np.float32)
        if most > 1:
            moves = np.broadcast_to(np.eye(labels, dtype=np.float32), (lanes, labels, labels)).copy()
            for j in range(CHUNK):
                moved = moves if j == 0 else (moves.reshape(-1, labels) @ trans).reshape(lanes, labels, labels)
                moved = moved * e[j][:, None, :]
                moved /= moved.sum((1, 2), keepdims=True)
                moves = moved if j == 0 else np.where(live[j][:, None, None], moved, moves)
            for k in range(1, most):  # a lane's entry: what leaves the lane before, moved on
                here = first[parts > k] + k
                v = (entry[here - 1][:, None, :] @ moves[here - 1])[:, 0] @ trans
                entry[here] = v / v.sum(1, keepdims=True)
            for k in range(most - 2, -1, -1):
                here = first[parts > k + 1] + k
                v = (moves[here + 1] @ exit_[here + 1][:, :, None])[:, :, 0] @ trans.T
                exit_[here] = v / v.sum(1, keepdims=True)
        post, _ = marginals(e, trans, entry, exit_, live)
        per_lane = (post * live[:, :, None]).sum(0, dtype=np.float64)
        out = np.zeros((len(sizes), labels))
        np.add.at(out, text_of, per_lane)
        return out


def fit(spans: list[tuple[str, list[str]]]) -> LanguageModel:
    """Learn from labelled spans of words by full-batch gradients of the sequence likelihood.

    Spans of different documents are spliced into sequences, so switches and
    their rarity are learned. The order of ``spans`` decides the splices.
    """
    labels = sorted({lang for lang, _ in spans})
    size = max(1, len(labels))
    number = {lang: k for k, lang in enumerate(labels)}
    vocabulary: dict[str, int] = {}
    tokens, gold = [], []
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, words in spans:
        for w in words:
            tokens.append(vocabulary.setdefault(w, len(vocabulary)))
            gold.append(number[lang])
            counts[w][number[lang]] += 1
    steps = SPAN * SPLICED
    words = list(vocabulary)
    single, grams, starts, whole = word_features(words)
    ranked: list[Counter] = [Counter() for _ in labels]
    for w, c in counts.items():
        k, n = c.most_common(1)[0]
        if n >= 3 and n >= 0.8 * sum(c.values()):
            ranked[k][w] = n
    chosen = {vocabulary[w]: k for k, c in enumerate(ranked) for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]}
    listed = np.array(sorted(chosen, key=lambda v: whole[v]), np.int64)
    model = LanguageModel(labels, np.zeros((TABLE, size), np.float32), np.full((size, size), 1 / size), whole[listed] if len(listed) else np.zeros(0, np.uint64), np.eye(size, dtype=np.float32)[[chosen[v] for v in listed.tolist()]] if len(listed) else np.zeros((0, size), np.float32), np.zeros((size, size), np.float32))
    n = len(tokens) // steps * steps
    if len(labels) < 2 or not n:
        return model
    codes = np.array(tokens[:n]).reshape(-1, steps).T
    truth = np.array(gold[:n]).reshape(-1, steps).T
    hot = np.eye(size, dtype=np.float32)[truth]
    seen = np.zeros((size, size))
    np.add.at(seen, (truth[:-1].ravel(), truth[1:].ravel()), 1)
    # word -> features
    owner = np.concatenate([np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(grams))))] * 2 + [np.arange(len(words))] * len(single))
    feats = np.concatenate([grams[:, 0], grams[:, 1], *single])
    keep = feats > 0
    owner, feats = owner[keep], feats[keep]
    lex_of = np.full(len(words), -1)
    lex_of[list(chosen)] = list(chosen.values())
    logits = np.log((seen + 1) / (seen + 1).sum(1, keepdims=True))  # the start of the learning: how often the splices switch
    squares = [np.full(x.shape, 1e-6) for x in (model.table, model.weights, logits)]
    for _ in range(ROUNDS):
        score = np.stack([np.bincount(owner, model.table[feats, k], len(words)) for k in range(size)], 1)
        score[lex_of >= 0] += model.weights[lex_of[lex_of >= 0]]
        score = np.exp(np.maximum(score - score.max(1, keepdims=True), -40.0)).astype(np.float32)
        trans = np.exp(logits)
        post, pairs = marginals(score[codes], trans.astype(np.float32), None, None, None)
        error = np.stack([np.bincount(codes.ravel(), (hot[..., k] - post[..., k]).ravel(), len(words)) for k in range(size)], 1)
        table_step = np.stack([np.bincount(feats, error[owner, k], TABLE) for k in range(size)], 1) - DECAY * model.table
        lex_step = np.stack([error[lex_of == k].sum(0) for k in range(size)])
        for value, step, square in zip((model.table, model.weights, logits), (table_step, lex_step, seen - pairs), squares, strict=True):
            square += step**2
            value += (RATE * step / np.sqrt(square)).astype(value.dtype)
    trans = np.exp(logits - logits.max())
    model.trans = trans / trans.sum()
    return model


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on spans of at most ``sample`` documents with a language that are not held out.

    Only text and language are used, and only the spans come to the driver. Of
    several rows of an id the least of their spans counts at each place, so
    repeated rows change nothing.
    """
    chosen = (
        docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"]))
        .select(docs["lang"], docs["text"], F.xxhash64(docs["doc_id"], F.lit(4)).alias("order"), docs["doc_id"].alias("id"))
    )
    ids = chosen.select("order", "id").distinct().orderBy("order", "id").limit(sample)
    rows = chosen.join(F.broadcast(ids.select(F.col("id").alias("chosen_id"))), F.col("id").eqNullSafe(F.col("chosen_id"))).select("order", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            out = []
            for order, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = [w for w in cores(text.lower().split()) if w]
                starts = sorted({int(k * max(0, len(words) - SPAN) / max(1, SPANS - 1)) for k in range(SPANS)})
                out += [(order, k, lang, words[a : a + SPAN]) for k, a in enumerate(starts) if words]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())), strict=True)], ["order", "nth", "lang", "words"])

    each = rows.mapInArrow(run, "order long, nth int, lang string, words array<string>").groupBy("order", "nth").agg(F.min(F.struct("lang", "words")).alias("span"))
    spans = each.select("nth", "order", "span.*").orderBy("nth", "order").toPandas()
    return fit([(lang, list(words)) for lang, words in zip(spans["lang"], spans["words"], strict=True)])


def label_documents(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of whole texts, in one narrow pass; ``und`` and 0 without a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            names, scores = model.label_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double")
