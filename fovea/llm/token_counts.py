"""Token counts by finite-state transducers.

Two deterministic transducers, the second fed by the first:

* the *splitter* has twelve states over ten classes of characters and marks the
  starts of pre-tokens. A batch of texts is cut into chunks; each chunk gives
  its state map (exit state for every entry state), the maps compose through a
  parallel prefix scan, and a second run from the true entry states marks the
  boundaries;
* the *merger* reads the bytes of a pre-token. A state holds, for the longest
  suffix that may still become part of a later token, the last token and the
  count before each of its places; a transition carries the change in the
  number of emitted tokens. States are compiled when first reached.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slices, tokenizer_path

LIMIT = 512
CHUNK = 256
BATCH_BYTES = 4 << 20
#: States and counts of pre-tokens that a worker keeps before it starts anew.
MAX_STATES, MAX_KNOWN = 200_000, 400_000

# Classes of characters. LETTER is any letter without a class of its own.
LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE, STMD, RV, E, ELL, BREAK = range(11)
# States: in a run of letters, numbers or others; one or more white characters
# of which the last is a blank (…_B) or another (…_S); after an apostrophe that
# opens a pre-token, and inside or after a contraction.
BEGIN, IN_L, IN_N, IN_O, ONE_B, ONE_S, RUN_B, RUN_S, APOS, APOS_RV, APOS_L, CONTRACTED = range(12)
HERE, PREVIOUS = 1, 2  # outputs: a pre-token starts at this character, at the one before


def splitter_rules() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by (state, class).

    The pre-token pattern is: contraction (s t re ve m ll d after an
    apostrophe), or an optional blank and a run of letters, of numbers or of
    others, or white space less its last character before a non-white one, or
    white space.
    """
    to, out = np.zeros((12, 16), np.uint8), np.zeros((12, 16), np.uint8)
    letters = (LETTER, STMD, RV, E, ELL)

    def entered(c: int) -> int:
        return IN_L if c in letters else {NUMBER: IN_N, OTHER: IN_O, QUOTE: APOS, BLANK: ONE_B, SPACE: ONE_S}[c]

    for c in range(10):
        white, word = c in (BLANK, SPACE), c in letters
        for s in (BEGIN, CONTRACTED, IN_L, IN_N, IN_O, APOS):
            to[s, c], out[s, c] = entered(c), HERE
        for s, same in ((IN_L, word), (IN_N, c == NUMBER), (IN_O, c in (OTHER, QUOTE))):
            if same:
                to[s, c], out[s, c] = s, 0
        if c in (OTHER, QUOTE):
            to[APOS, c], out[APOS, c] = IN_O, 0
        for s in (ONE_B, ONE_S, RUN_B, RUN_S):
            if white:
                to[s, c], out[s, c] = RUN_B if c == BLANK else RUN_S, 0
                continue
            blank = s in (ONE_B, RUN_B)
            to[s, c] = IN_O if blank and c == QUOTE else entered(c)
            out[s, c] = (0 if blank else HERE) | (PREVIOUS if s in (RUN_B, RUN_S) else 0)
        for s in (APOS_RV, APOS_L):  # no contraction after all: a run of letters began before
            to[s, c], out[s, c] = to[IN_L, c], out[IN_L, c] | PREVIOUS
    for s, c, then in ((APOS, STMD, CONTRACTED), (APOS, RV, APOS_RV), (APOS, ELL, APOS_L), (APOS_RV, E, CONTRACTED), (APOS_L, ELL, CONTRACTED)):
        to[s, c], out[s, c] = then, 0
    to[:, BREAK], out[:, BREAK] = BEGIN, HERE
    out[[APOS_RV, APOS_L], BREAK] |= PREVIOUS
    return to, out


@cache
def class_table() -> np.ndarray:
    """Class by code point."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[np.frombuffer("".join(regex.findall(pattern, text)).encode("utf-32-le"), "<u4")] = kind
    for kind, chars in ((QUOTE, "'"), (BLANK, " "), (STMD, "stmd"), (RV, "rv"), (E, "e"), (ELL, "l")):
        table[[ord(c) for c in chars]] = kind
    return table


@cache
def flat_rules() -> tuple[np.ndarray, np.ndarray]:
    to, out = splitter_rules()
    return (to << 4).ravel(), out.ravel()  # indexed by state * 16 + class


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Prefix composition of state maps (chunks, states), by doubling."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


def boundaries(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Marks the characters at which a pre-token starts (a text break is one by itself)."""
    to, out = flat_rules()
    n = len(classes)
    lanes = n // chunk + 1  # at least one break behind the last character
    padded = np.full(lanes * chunk, BREAK, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    state = np.repeat((np.arange(12, dtype=np.uint8) << 4)[:, None], lanes, 1)
    for row in steps:
        state = to[state | row]
    reached = scan_maps((state >> 4).T.astype(np.int64))
    entry = np.zeros(lanes, np.uint8)  # BEGIN
    entry[1:] = reached[:-1, BEGIN] << 4
    marks = np.empty((chunk, lanes), np.uint8)
    for k, row in enumerate(steps):
        at = entry | row
        marks[k] = out[at]
        entry = to[at]
    marks = marks.T.ravel()
    starts = (marks & HERE) > 0
    starts[:-1] |= (marks[1:] & PREVIOUS) > 0
    return starts[:n]


class Merger:
    """The byte-pair transducer of a byte-level vocabulary, compiled as it is used."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model["added_tokens"]]
        # byte-level spelling: printable bytes stand for themselves, the rest from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        spelt = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        as_bytes = {word: bytes(spelt[c] for c in word) for word in model["model"]["vocab"]}
        self.ids = {as_bytes[word]: k for word, k in model["model"]["vocab"].items()}
        self.words = {k: word for word, k in self.ids.items()}
        self.merges, self.parts = {}, {}
        for rank, (left, right) in enumerate(model["model"]["merges"]):
            left, right = as_bytes[left], as_bytes[right]
            whole = self.ids[left + right]
            self.merges[self.ids[left], self.ids[right]] = (rank, whole)
            self.parts.setdefault(whole, (rank, self.ids[left], self.ids[right]))
        self.prefixes = {word[:k] for word in self.ids for k in range(len(word))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (b"", (-1,), (0,))
        self.states, self.numbers, self.moves = [start], {start: 0}, {}

    def merged(self, data: bytes) -> list[int]:
        """Byte-pair encoding by definition: the merge of least rank first, leftmost first."""
        ids = [self.ids[bytes([b])] for b in data]
        while len(ids) > 1:
            rank, k = min((self.merges.get(pair, (1 << 60,))[0], k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its outer parts on one side (1 left, 2 right), each with the rank of the merge that takes it up."""
        out, rank = [], 1 << 60
        while True:
            out.append((token, rank))
            if token not in self.parts:
                return out
            rank, token = self.parts[token][0], self.parts[token][side]

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their joint bytes.

        Merges are done by rank, and a merge's parts have lower ranks. So the
        two are kept apart unless a part at the end of the left one and a part
        at the start of the right one merge before either is taken up by its
        own token; of equal ranks the merge further left comes first.
        """
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2 * MAX_STATES:
                self.fits.clear()
            known = True
            starts = self.spine(right, 1)
            for a, taken in self.spine(left, 2):
                for b, before in starts:
                    merge = self.merges.get((a, b))
                    if merge is not None and merge[0] < taken and merge[0] <= before:
                        known = False
            self.fits[left, right] = known
        return known

    def compile(self, number: int, byte: int) -> int:
        """The transition from a state on a byte: next state and change of the count, packed."""
        held, lasts, counts = self.states[number]
        held += bytes([byte])
        for k in range(len(held)):  # the last token of the longer text is the one that fits what was before it
            token = self.ids.get(held[k:])
            if token is not None and (lasts[k] < 0 or self.fit(lasts[k], token)):
                break
        change = counts[k] + 1
        lasts, counts = (*lasts, token), (*(c - change for c in counts), 0)
        drop = next(k for k in range(len(held) + 1) if held[k:] in self.prefixes)
        state = (held[drop:], lasts[drop:], counts[drop:])
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        move = self.moves[number << 8 | byte] = to << 16 | (change + 32768)
        return move

    def count(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.states) > MAX_STATES:
            self.clear()
        at, n, moves = 0, 0, self.moves
        for byte in data:
            move = moves.get(at << 8 | byte)
            if move is None:
                move = self.compile(at, byte)
            at = move >> 16
            n += (move & 65535) - 32768
        return n


_mergers: dict[str, tuple[Merger, dict]] = {}


def merger(vocabulary: str) -> tuple[Merger, dict]:
    if vocabulary not in _mergers:
        _mergers[vocabulary] = (Merger(vocabulary), {})
    return _mergers[vocabulary]


def count_texts(texts: list[str | None], vocabulary: str) -> np.ndarray:
    """Tokens of each text; a special string counts as one token (none: 0)."""
    machine, known = merger(vocabulary)
    counts = np.zeros(len(texts), np.int64)
    owners, pieces = [], []
    for k, text in enumerate(texts):
        parts = [text or ""]
        for special in machine.special:
            if special in parts[0] or len(parts) > 1:
                split = [p.split(special) for p in parts]
                counts[k] += sum(len(p) - 1 for p in split)
                parts = [x for p in split for x in p]
        for part in parts:
            if part:
                owners.append(k)
                pieces.append(part)
    if not pieces:
        return counts
    joined = "\0".join(pieces)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    breaks = np.cumsum(lengths + 1)[:-1] - 1
    classes = class_table()[points]
    classes[breaks] = BREAK
    starts = np.flatnonzero(boundaries(classes))
    widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(widths)])
    offsets = at[np.append(starts, len(points))].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())]).dictionary_encode()
    each = np.empty(len(words.dictionary), np.int64)
    for k, word in enumerate(words.dictionary.to_pylist()):
        n = known.get(word)
        if n is None:
            n = machine.count(word)
            if len(known) > MAX_KNOWN:
                known.clear()
            if len(word) <= 64:
                known[word] = n
        each[k] = n
    per = each[words.indices.to_numpy()]
    per[np.searchsorted(starts, breaks)] = 0
    first = np.searchsorted(starts, np.concatenate([[0], breaks + 1]))
    np.add.at(counts, np.array(owners), np.add.reduceat(per, first))
    return counts


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """Token counts of whole texts, in one narrow pass without a shuffle.

    Returns doc_id, n_bytes, n_tokens, over_limit (``n_tokens > limit``). Null
    and empty texts have none of either. Long texts are cut into chunks inside
    the task, whatever their length. Repeated rows are counted each.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            counts = count_texts(batch.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", n_bytes.alias("n_bytes"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
