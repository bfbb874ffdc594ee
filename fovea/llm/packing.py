"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tables import slices, tokenizer_path

WINDOW = 1024
END_ID = 0
#: Open windows that a task holds; beyond it the fullest is filled by a cut.
MAX_OPEN = 16_384
#: Input of a task, at least, where the input is cut finer: the more documents a task packs, the more windows it fills by placement.
TASK_BYTES = 64 << 20
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
BATCH_BYTES = 1 << 20
#: Blanks that have no other white space beside them, and how RE2 finds the others.
_BLANK = re.compile(r"(?<!\s) (?!\s)")
_SPACE = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"
_MIXED = f"{_SPACE} | {_SPACE}"
#: Distinct words whose ids a worker keeps before it forgets those met in one batch only, and the longest one kept.
MAX_KNOWN, MAX_KEPT = 300_000, 64
#: Words that go to the library in one call.
RUN = 100
#: Signs that are a pre-token of their own behind letters.
TAILS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """What a byte-level vocabulary writes for a byte that has no printable Latin-1 letter: the next free character from 256 on."""
    kept = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in kept)}


_LETTERS = byte_letters()
_encoders: dict[str, Encoder] = {}


def cut(texts: pa.Array) -> pa.ListArray:
    """Texts cut at blanks that have no other white space beside them (the blanks left out)."""
    mixed = pc.match_substring_regex(texts, _MIXED)
    lists = pc.split_pattern(texts, " ")
    if not pc.any(mixed).as_py():
        return lists
    apart = pa.array([_BLANK.split(t) for t in texts.filter(mixed).to_pylist()], lists.type)
    place = mixed.to_numpy(zero_copy_only=False)
    order = np.where(place, len(texts) + np.cumsum(place) - 1, np.arange(len(texts)))
    return pa.concat_arrays([lists, apart]).take(pa.array(order))


class Encoder:
    """Texts to ids, as ``tokenizers`` gives them for a byte-level BPE file.

    Every id comes from the library. Its pre-tokens always begin at a blank
    that has no other white space beside it, and byte-level BPE works on each
    pre-token by itself, so texts are cut at such blanks and the words of a
    batch that are not known yet are encoded together, each with its blank in
    front; their ids are told apart by the bytes that each id stands for. A
    word of letters alone is one pre-token, so it goes to the library's model
    as it is, and a sign behind it is another. A text that holds a special string goes to the library whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        library = Tokenizer.from_file(vocabulary)
        self.many = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        self.width = np.zeros(library.get_vocab_size(), np.int64)
        for token, k in library.get_vocab().items():
            self.width[k] = len(token)  # one character a byte
        self.tokenize = library.model.tokenize
        self.known: dict[str, bytes] = {}
        # letters are one pre-token in every vocabulary of this kind; others take the longer way
        self.tail = {c: np.array(self.ids(c), "<u4").tobytes() for c in TAILS}
        probes = [w + c for w in ("the", "Naïveté", "übergroß", "中文") for c in ("", *TAILS)]
        self.by_model = all(self.by_letters(w) == np.array(self.ids(f" {w}"), "<u4").tobytes() for w in probes)
        self.once: set[str] = set()  # known words that no later batch has used since they were learned or kept

    def ids(self, text: str) -> list[int]:
        return self.many([text])[0]

    def forget(self, room: int) -> None:
        """Make room for new words: keep those used again since the last time, if they take half the space at most."""
        for word in self.once:
            del self.known[word]
        if len(self.known) > min(MAX_KNOWN // 2, MAX_KNOWN - room):
            self.known.clear()
        self.once = set(self.known)

    def by_letters(self, word: str) -> bytes | None:
        """Ids of a word of letters, or of letters and one sign behind them; None for any other."""
        if word.isalpha():
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            return array("I", [t.id for t in self.tokenize("Ġ" + letters)]).tobytes()
        tail = self.tail.get(word[-1:])
        if tail is None or not word[:-1].isalpha():
            return None
        return (self.known.get(word[:-1]) or self.by_letters(word[:-1])) + tail

    def learn(self, words: list[str]) -> None:
        if self.by_model:
            rest = []
            for word in words:
                ids = self.by_letters(word)
                if ids is None:
                    rest.append(word)
                else:
                    self.known[word] = ids
            words = rest
        for k in range(0, len(words), RUN):
            run = words[k : k + RUN]
            ids = np.array(self.ids("".join(f" {w}" for w in run)), "<u4")
            behind = np.cumsum(self.width[ids])
            ends = np.searchsorted(behind, np.cumsum([len(w.encode()) + 1 for w in run])) + 1
            data, start = ids.tobytes(), 0
            for word, end in zip(run, ends.tolist(), strict=True):
                self.known[word] = data[4 * start : 4 * end]
                start = end

    def __call__(self, texts: list[str], end: bytes = b"") -> list[np.ndarray]:
        """The ids of each text, and ``end`` behind them."""
        # large offsets: a batch may be one text of any length
        whole = pa.array(texts, pa.large_string())
        special = pc.match_substring(whole, SPECIAL).to_numpy(zero_copy_only=False)
        lists = cut(pc.if_else(pa.array(special), "", whole))
        flat = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        index = flat.indices.to_numpy()
        firsts = np.cumsum(sizes) - sizes
        heads = [text if alone else word for text, alone, word in zip(texts, special.tolist(), flat.dictionary.take(pa.array(index[firsts])).to_pylist(), strict=True)]
        behind = np.ones(len(index), bool)
        behind[firsts] = False  # a text's first word has no blank in front
        index = index[behind]
        words, used_at = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), np.zeros(len(flat.dictionary), bool)
        used_at[index] = True
        used = [w for w, there in zip(words, used_at.tolist(), strict=True) if there]
        new = [w for w in used if w not in self.known]
        self.once.difference_update(used)
        if len(self.known) + len(new) > MAX_KNOWN:
            self.forget(len(new))
            new = [w for w in used if w not in self.known]
        self.learn(new)
        each = [self.known[w] if there else b"" for w, there in zip(words, used_at.tolist(), strict=True)]
        width = np.fromiter(map(len, each), np.int64, len(each)) // 4
        start = np.cumsum(width) - width
        n = width[index]
        place = np.repeat(start[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids = np.frombuffer(b"".join(each), "<u4")[place]
        ends = np.cumsum(np.append(0, n))[np.cumsum(np.append(0, sizes - 1))]
        out = []
        for k, head in enumerate(self.many(heads)):
            rest = ids[ends[k] : ends[k + 1]]
            out.append(np.frombuffer(b"".join([array("I", head).tobytes(), rest.tobytes(), end]), "<u4"))
        for word in new:
            if len(word) > MAX_KEPT:
                del self.known[word]
            else:
                self.once.add(word)
        return out


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a file, one per worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


class Packer:
    """Windows under way in one task.

    ``level[h]`` counts the open windows filled up to ``h`` ids. A piece of
    ``s`` ids goes to the level that makes the sum of squared counts least: an
    open window at ``h`` moves from ``level[h]`` to ``level[h + s]`` (or leaves
    when full), a new one joins ``level[s]``. Ties go to the fullest window.
    """

    def __init__(self, window: int, first_id: int, max_open: int = MAX_OPEN):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.count = self.placed = self.cut = 0  # open windows; those closed by placement and by a cut

    def choose(self, s: int) -> int:
        """The level of the window that takes ``s`` ids (0: a new window)."""
        level, last = self.level, self.window - s
        # change of the sum of squares, less one
        change = np.where(level[: last + 1] > 0, 2 * (level[s:] - level[: last + 1]) + 1, np.iinfo(np.int64).max)
        change[0] = 2 * level[s]
        if level[last]:
            change[last] = -2 * level[last]
        return int(last - np.argmin(change[::-1]))

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, doc: tuple, start: int, ids: np.ndarray) -> Iterator[tuple]:
        s = len(ids)
        h = self.choose(s)
        if h:
            held = self.take(h)
        else:
            held = []
        held.append((doc, start, ids))
        if h + s == self.window:
            self.placed += 1
            yield from self.emit(held)
            return
        self.keep(held, h + s)
        if self.count > self.max_open:
            yield from self.fill_one()

    def keep(self, held: list, filled: int) -> None:
        self.level[filled] += 1
        self.open[filled].append(held)
        self.count += 1

    def take(self, filled: int) -> list:
        self.level[filled] -= 1
        self.count -= 1
        return self.open[filled].pop()

    def emit(self, held: list) -> Iterator[tuple]:
        sequence, offset = self.new(), 0
        for doc, start, ids in held:
            yield (*doc[:1], start, len(ids), ids.tobytes(), doc[1], sequence, offset)
            offset += len(ids)

    def fill_one(self) -> Iterator[tuple]:
        """Fill the fullest open window with ids cut from the emptiest ones (the only one left stays open)."""
        filled = int(np.flatnonzero(self.level)[-1])
        window = self.take(filled)
        while filled < self.window and self.count:
            low = int(np.flatnonzero(self.level)[0])
            giver = self.take(low)
            doc, start, ids = giver.pop()
            cut = max(0, len(ids) - (self.window - filled))
            window.append((doc, start + cut, ids[cut:]))
            filled += len(ids) - cut
            if cut:
                giver.append((doc, start, ids[:cut]))
            if giver:
                self.keep(giver, low - len(ids) + cut)
        if filled == self.window:
            self.cut += 1
            yield from self.emit(window)
        else:
            self.keep(window, filled)

    def finish(self) -> Iterator[tuple]:
        """Close all windows by cuts; the ids of the last one go to sequences whose lengths are powers of two, which need no padding."""
        while self.count > 1:
            yield from self.fill_one()
        if not self.count:
            return
        pieces = self.take(int(np.flatnonzero(self.level)[0]))
        left = sum(len(p[2]) for p in pieces)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            held = []
            while room:
                doc, start, ids = pieces.pop(0)
                held.append((doc, start, ids[:room]))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:]))
                room -= len(held[-1][2])
            yield from self.emit(held)


def pack_rows(rows: Iterator[tuple], window: int, first_id: int, max_open: int = MAX_OPEN) -> Iterator[tuple]:
    """Pack (doc_id, ids) rows: whole windows straight away, each rest by the sum of squares."""
    packer = Packer(window, first_id, max_open)
    for doc_id, ids in rows:
        doc, whole = (doc_id, len(ids)), len(ids) // window * window
        for start in range(0, whole, window):
            yield from packer.emit([(doc, start, ids[start : start + window])])
        if whole < len(ids):
            yield from packer.place(doc, whole, ids[whole:])
    yield from packer.finish()


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, max_open: int = MAX_OPEN, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Tokenise every document (an end id after each) and pack all ids into windows.

    One narrow pass: each task packs the documents that it reads, so nothing
    is shuffled and a lost task is simply run again. Input that Spark would cut
    finer is read in tasks of about ``task_bytes``, as a window that is still
    open at the end of a task must be filled by cuts. A task holds at most
    ``max_open`` open windows; beyond that, one at a time is filled by a cut.
    Sequences are full but for at most ten at the end of a task, whose lengths
    are powers of two. Sequence ids are ``task << 32`` upward.

    Returns one row per piece: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. Null or empty text: the
    end id alone. A document longer than a window fills windows of its own and
    its rest is packed; runs of blanks or letters of any length are tokenised
    whole. Repeated rows are packed each; null ids are kept; other columns are
    ignored; an empty table gives no rows.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        end = np.array([END_ID], "<u4").tobytes()

        def rows() -> Iterator[tuple]:
            for batch in slices(batches, "text", BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts, end), strict=True):
                    yield doc_id, ids

        held, n = [], 0
        for piece in pack_rows(rows(), window, TaskContext.get().partitionId() << 32, max_open):
            held.append(piece)
            n += piece[2]
            if n > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return texts.coalesce(min(max(1, -(-size // task_bytes)), 1 << 30)).mapInArrow(run, SCHEMA)
