"""One document of each group of near copies: wide SimHash prints, BK-trees of shards by shared minima, exact sets.

At a similarity of 0.8 two 64-bit fingerprints differ in ten bits on average,
out of reach of exact blocks. Here a fingerprint has 256 bits and the shards
are made by minima of shingle hashes instead of blocks. Each shard is searched
by a BK-tree, that of operator 8. Prints only pass over what cannot be similar;
a link is made by the shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.operators.components import connected_components

from .simhash import BKTree, majority_bits
from .tables import keeps_names, saved, slices
from .words import MIX, batch_words, mixed, shingle_hashes, word_hash

SHINGLE = 5
#: Similarity of copies as a fraction: 4 / 5.
PART, WHOLE = 4, 5
#: At similarity 0.8, 38.8 of 256 bits differ on average with a deviation of
#: 5.7, and 48 with 6.2 for sets of four and five shingles, the worst case. The
#: radius is five deviations above that and six below unrelated texts (128).
LANES, RADIUS = 4, 80
#: Two texts at 0.8 share all minima of one of the bands with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9997.
BANDS, ROWS = 12, 3
#: Sets compared with one at a time; a larger group takes several rounds.
HOT = 4096
#: Parts into which the rows of one group are dealt in a join.
SALTS = 4
#: Bitmaps of the ids that go: bits of one, how many, bits for each id.
MAP_BITS, MIN_MAPS, MAX_MAPS, BITS_AN_ID = 32768, 32, 8192, 16
BATCH_BYTES = 4 << 20


def wide_prints(texts: pa.Array) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
    """(sets of five-word shingles, their fingerprints of 32 bytes, band keys by text and band)."""
    hashes, sizes = batch_words(texts)
    shingles, counts = shingle_hashes(hashes, sizes, SHINGLE)
    ends = np.cumsum(counts)
    sets = [np.unique(shingles[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    salts = np.array([word_hash(f"salt{k}") for k in range(LANES + BANDS * ROWS)], np.uint64)
    bits = np.zeros((len(sets), LANES), np.uint64)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat, sizes = np.concatenate([sets[k] for k in full.tolist()]), sizes[full]
        starts = np.cumsum(sizes) - sizes
        for lane in range(LANES):
            bits[full, lane] = majority_bits(mixed(flat ^ salts[lane]), sizes)
        for band in range(BANDS):
            key = np.zeros(len(full), np.uint64)
            for row in range(ROWS):
                salted = (flat ^ salts[LANES + band * ROWS + row]) * MIX[2]
                key = mixed(key + np.minimum.reduceat(salted ^ (salted >> np.uint64(31)), starts))
            keys[full, band] = key
    return sets, [b.tobytes() for b in bits], keys


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, form, print, bands, shingles) of whole texts; texts of one shingle set share a form, its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "text", BATCH_BYTES):
            sets, wide, keys = wide_prints(batch.column(2))
            held = [s.tobytes() for s in sets]
            forms = pa.array([xxhash.xxh3_128_digest(h) for h in held], pa.binary())
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
            columns = [batch.column(0), batch.column(1), forms, pa.array(wide, pa.binary()), bands, pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "form", "print", "bands", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("text"))
    return texts.mapInArrow(run, "doc_id long, text_key long, form binary, print binary, bands array<long>, shingles binary")


def groups(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Connected components of 0 .. n - 1, those of one member left out.

    ``near(x, others)`` tells which of the others are linked to x. Members
    already reached are not asked for again, so a group of near copies costs
    few comparisons a member.
    """
    out, free = [], np.arange(n)
    while len(free) > 1:
        todo, reached = [int(free[0])], [int(free[0])]
        free = free[1:]
        while todo and len(free):
            hits = near(todo.pop(), free)
            todo += free[hits].tolist()
            reached += free[hits].tolist()
            free = free[~hits]
        if len(reached) > 1:
            out.append(np.array(reached))
    return out


def maybe_near(wide: np.ndarray, sizes: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Test for ``groups``: prints within the radius, of sets whose sizes allow the similarity."""

    def near(x: int, others: np.ndarray) -> np.ndarray:
        size = sizes[others]
        fits = PART * np.maximum(size, sizes[x]) <= WHOLE * np.minimum(size, sizes[x])
        return fits & (np.bitwise_count(wide[others] ^ wide[x]).sum(axis=1, dtype=np.int64) <= RADIUS)

    return near


def tree_groups(wide: list[bytes], sizes: list[int]) -> list[list[int]]:
    """Groups of a shard by its BK-tree: members that chain by prints within the radius, of sets whose sizes allow the similarity.

    Members of equal prints are one node, known by the least and the greatest
    size of their sets; groups of one member are left out.
    """
    members: dict[int, list[int]] = {}
    for k, own in enumerate(wide):
        members.setdefault(int.from_bytes(own, "little"), []).append(k)
    spans = {value: (min(sizes[k] for k in at), max(sizes[k] for k in at)) for value, at in members.items()}

    def fits(a: int, b: int) -> bool:
        (least, most), (low, high) = spans[a], spans[b]
        return PART * max(least, low) <= WHOLE * min(most, high)

    tree = BKTree(RADIUS, fits)
    for value in members:
        tree.add(value)
    out: dict[int, list[int]] = {}
    for value, at in members.items():
        out.setdefault(tree.find(value), []).extend(at)
    return [group for group in out.values() if len(group) > 1]


def exact_groups(wide: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """The members whose shingle sets chain at the similarity or more: common over all shingles, in integers."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    flat, mark, maybe = flat.astype(np.int32), np.zeros(len(known), bool), maybe_near(wide, sizes)
    ids = [flat[e - c : e] for e, c in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def near(x: int, others: np.ndarray) -> np.ndarray:
        hits = maybe(x, others)
        at = np.flatnonzero(hits)
        mark[ids[x]] = True
        for part in np.array_split(at, -(-len(at) // HOT)) if len(at) else []:
            size = sizes[others[part]]
            common = np.add.reduceat(mark[np.concatenate([ids[k] for k in others[part].tolist()])], np.cumsum(size) - size, dtype=np.int64)
            hits[part] = (PART + WHOLE) * common >= PART * (size + sizes[x])
        mark[ids[x]] = False
        return hits

    return groups(len(sets), near)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns after the first ``keys`` of each run of rows of equal keys."""
    held, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != held:
                if len(rows) > 1:
                    yield [list(c) for c in zip(*rows, strict=True)]
                held, rows = row[:keys], []
            rows.append(row[keys:])
    if len(rows) > 1:
        yield [list(c) for c in zip(*rows, strict=True)]


def lanes(wide: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(wide), np.uint64).reshape(-1, LANES)


def form_links(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) that join all forms which share a shard and have the similarity or more.

    Shards are counted with map-side sums and lone members fall out. Each shard
    is a BK-tree, built and searched in the task that holds it, which finds the
    groups that may be similar; a group found in several bands is kept once.
    Only the members of groups fetch their shingle sets, by which the second
    pass makes the links, fewer than members per group. A shard of any size is
    searched whole.
    """
    banded = distinct.select("form", "print", "size", F.posexplode("bands").alias("band", "key"))
    counts = banded.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    shards = banded.join(counts, ["band", "key"]).select("band", "key", "form", "print", "size")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for forms, wide, sizes in runs(batches, 2):
            for group in tree_groups(wide, sizes):
                members = sorted(forms[k] for k in group)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b"".join(members))], pa.binary()), pa.array([members], pa.list_(pa.binary()))], ["group", "forms"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forms, wide, held in runs(batches, 1):
            pairs = [(forms[k], forms[g[0]]) for g in exact_groups(lanes(wide), [np.frombuffer(h, np.uint64) for h in held]) for k in g[1:].tolist()]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    dealt = shards.repartition("band", "key").sortWithinPartitions("band", "key", "form")
    gathered = dealt.mapInArrow(gather, "group binary, forms array<binary>").dropDuplicates(["group"])
    members = saved(gathered.select("group", F.explode("forms").alias("form")), "maybe-copies").join(distinct.select("form", "print", "row"), "form")
    members = saved(members, "maybe-rows")
    wanted = with_mark(found.select("row", "shingles"), F.col("row"), members.select("row").distinct()).where("__may").select("row", "shingles")
    whole = members.join(wanted, "row").select("group", "form", "print", "shingles")
    return whole.repartition("group").sortWithinPartitions("group", "form").mapInArrow(link, "a binary, b binary").distinct()


def salted(table: DataFrame) -> DataFrame:
    """Each row once for each of the ``SALTS``; the other side of a join picks one, so that no key is one task."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, goes): the texts that go as near copies, and of those that stay the ones in several rows.

    A text is named by its doc_id and the hash of the text. Of each group the
    text of least name stays, null ids last.
    """
    found = saved(prints(docs).withColumn("row", F.monotonically_increasing_id()), "wide-prints")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    firsts = found.groupBy("form").agg(
        F.min(name).alias("first"), F.count("*").alias("rows"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("print", "bands")), (F.first(F.length("shingles")) / 8).cast("long").alias("size")
    )
    firsts = saved(firsts, "distinct-forms")
    roots = saved(connected_components(form_links(firsts, found)), "form-roots")
    nodes = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = firsts.join(nodes, F.col("form") == F.col("node")).select("form", "first", "root", F.pmod(F.xxhash64("form"), F.lit(SALTS)).cast("int").alias("salt"))
    linked = saved(linked, "linked-forms")
    least = salted(linked.groupBy("root").agg(F.min("first").alias("best")))
    classes = linked.join(least, ["root", "salt"]).select("form", "best")
    alone = firsts.join(classes.select("form"), "form", "left_anti").where("rows > 1").select("form", F.col("first").alias("best"))
    named = found.groupBy("doc_id", "text_key").agg(F.first("form").alias("form"), F.count("*").alias("times"))
    named = named.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    judged = named.join(salted(classes.unionByName(alone)), ["form", "salt"]).select("doc_id", "text_key", (name != F.col("best")).alias("goes"), "times")
    return judged.where("goes OR times > 1").drop("times")


def with_mark(rows: DataFrame, key: F.Column, keys: DataFrame) -> DataFrame:
    """``rows`` with __may, false only where ``key`` (a long) is not among ``keys`` (one column).

    The keys are hashed into bitmaps of ``MAP_BITS`` bits, at most
    ``MAX_MAPS`` of them (32 MB), which are broadcast. With more keys than the
    bitmaps can tell apart, more rows are marked.
    """
    maps = MIN_MAPS
    wanted = keys.count() * BITS_AN_ID
    while maps < MAX_MAPS and maps * MAP_BITS < wanted:
        maps *= 2

    def place(c: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(c), F.lit(maps * MAP_BITS))

    at = keys.select(place(F.col(keys.columns[0])).alias("at"))
    bits = at.groupBy(F.expr(f"at div {MAP_BITS}").alias("__map")).agg(F.expr(f"bitmap_construct_agg(at % {MAP_BITS})").alias("__bits"))
    marked = rows.withColumn("__at", place(key))
    marked = marked.join(F.broadcast(bits), F.expr(f"__at div {MAP_BITS} = __map"), "left")
    octet = F.conv(F.hex(F.expr(f"substring(__bits, CAST(__at % {MAP_BITS} div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(F.expr("__at % 8").cast("int"), F.lit(0))
    return marked.withColumn("__may", F.coalesce(octet.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), may + 1)) != 0, F.lit(False)))


@keeps_names
def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one (that of least doc_id, null ids last) of each group of near copies.

    Texts are compared by sets of five-word shingles, words in lower case
    without punctuation; groups are chains of copies at a similarity of 0.8 or
    more. Texts without words, null and empty ones among them, are copies of
    each other. Each text is judged by itself, whatever its id: of rows of one
    id and text the least row stays, and rows of one id with different texts
    stay or go apart. All columns are kept, whatever their names; an empty
    table gives none.

    Only documents that ``with_mark`` marks, those that go or repeat and a few
    more, are joined; the texts of all others stay where they are.
    """
    names = docs.columns
    changed = saved(copies(docs), "copies").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("goes").alias("__goes"))
    own_id, own_key = F.col("doc_id").cast("long"), F.xxhash64("text")
    marked = with_mark(docs, F.xxhash64(own_id, own_key), changed.select(F.xxhash64("__id", "__key")))
    rest = marked.where("__may").select(names)
    same = own_id.eqNullSafe(F.col("__id")) & (own_key == F.col("__key"))
    out = marked.where("NOT __may").select(names).unionByName(rest.join(changed, same, "left_anti"))
    several = changed.where("NOT __goes")
    if several.isEmpty():
        return out
    whole = F.struct(*names)
    # maps have no order, so rows that hold one are compared as JSON
    first = F.min_by(whole, F.to_json(whole)) if any("map<" in kind for _, kind in docs.dtypes) else F.min(whole)
    least = rest.join(several, same, "left_semi").groupBy(own_id.alias("__id"), own_key.alias("__key")).agg(first.alias("__r"))
    return out.unionByName(least.select("__r.*"))
