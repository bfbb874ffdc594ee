"""Products of movies, footprints and traces, as joins and grouped sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.functions.lineage import saved


def project_traces(rows: DataFrame, footprints: DataFrame) -> DataFrame:
    """A Y: (video_id, frame, cell, r). Sums are formed before the shuffle; a frame's rows are read together."""
    joined = rows.join(footprints.select("cell", "px", "w"), "px")
    return joined.groupBy("video_id", "frame", "cell").agg(F.sum(F.col("w") * F.col("value")).alias("r"))


def project_footprints(rows: DataFrame, traces: DataFrame, name: str = "c") -> DataFrame:
    """Y C: (px, cell, yc)."""
    joined = rows.join(traces.select("frame", "cell", F.col(name).alias("c")), "frame")
    return joined.groupBy("px", "cell").agg(F.sum(F.col("value") * F.col("c")).alias("yc"))


#: Pixels of a tile; entries of a mask, and pixels from the first to the last, that go to the tasks at a time; values of a matrix of frames.
TILE, STRIP_ENTRIES, STRIP_PIXELS, BLOCK = 1024, 1 << 21, 1 << 22, 1 << 21


class MaskStrip:
    """The places (cell, px) of one strip of the frame, sorted by tile, and sums for them.

    A tile knows its pixels, the cells that reach into it and which pairs of
    these are places; a product of matrices a tile is added to these only.
    """

    def __init__(self, px: np.ndarray, cell: np.ndarray):
        order = np.lexsort((cell, px // TILE))
        self.px, self.cell = px[order], cell[order]
        self.pixels, at = np.unique(self.px, return_inverse=True)
        self.cells, who = np.unique(self.cell, return_inverse=True)
        self.first = int(self.pixels[0])
        self.place = np.full(int(self.pixels[-1]) - self.first + 1, -1, np.int32)
        self.place[self.pixels - self.first] = np.arange(len(self.pixels))
        self.tiles = []
        cuts = np.flatnonzero(np.diff(self.px // TILE, prepend=-1))
        for a, z in zip(cuts, np.append(cuts[1:], len(self.px)), strict=True):
            columns, column = np.unique(at[a:z], return_inverse=True)
            rows, row = np.unique(who[a:z], return_inverse=True)
            self.tiles.append((a, z, columns, rows, row * len(columns) + column))

    def frames(self, frame: np.ndarray, px: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Matrix of ``n`` frames by the strip's pixels."""
        out = np.zeros((n, len(self.pixels)))
        inside = (px >= self.first) & (px < self.first + len(self.place))
        at = self.place[px[inside] - self.first]
        out[frame[inside][at >= 0], at[at >= 0]] = value[inside][at >= 0]
        return out

    def add(self, total: np.ndarray, y: np.ndarray, c: np.ndarray) -> None:
        for a, z, columns, rows, places in self.tiles:
            total[a:z] += (c[:, rows].T @ y[:, columns]).ravel()[places]


def mask_strips(mask: DataFrame) -> Iterator[MaskStrip]:
    """The mask, a bounded number of places and pixels at a time; a tile with more than that is cut by cells."""
    tile = F.floor(F.col("px") / TILE)
    counts = mask.groupBy(tile.alias("tile")).agg(F.count("*").alias("n")).orderBy("tile").collect()  # a row for each 1024 pixels
    strips, held = [], 0
    for r in counts:
        if r["n"] > STRIP_ENTRIES:
            parts = -(-r["n"] // STRIP_ENTRIES)
            strips += [(r["tile"], r["tile"], parts, k) for k in range(parts)]
            held = 0
        elif held and held + r["n"] <= STRIP_ENTRIES and (r["tile"] - strips[-1][0] + 1) * TILE <= STRIP_PIXELS:
            strips[-1] = (strips[-1][0], r["tile"], 1, 0)
            held += r["n"]
        else:
            strips.append((r["tile"], r["tile"], 1, 0))
            held = r["n"]
    for lo, hi, parts, k in strips:
        places = mask.where(tile.between(lo, hi) & (F.pmod(F.xxhash64("cell"), F.lit(parts)) == k)).select("px", "cell").toArrow()
        if len(places):
            yield MaskStrip(*(c.to_numpy().astype(np.int64) for c in places.columns))


def project_footprints_masked(frames: DataFrame, traces: DataFrame, mask: DataFrame, name: str = "c") -> DataFrame:
    """Y C at the places of ``mask`` (cell, px) only: (px, cell, yc), a product of matrices a tile and batch of frames, then one sum.

    ``frames``: (frame, px, value) with arrays, see ``frame_arrays``; dealt by
    frame before, they are not moved. Each frame carries its cells' values as
    one array. A task holds one batch of frames and one sum a place, and gives
    no more rows than the mask has places. A mask of over ``STRIP_ENTRIES``
    places goes strip by strip, a scan each.
    """
    mask = saved(mask.select("px", "cell").distinct(), "places")
    values = traces.join(mask.select("cell").distinct(), "cell", "left_semi").groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("cell", F.col(name).alias("c")))).alias("cs"))
    rows = frames.join(values, "frame").select("px", "value", F.col("cs.cell").alias("cell"), F.col("cs.c").alias("c"))
    out = None
    for strip in mask_strips(mask):
        shared = mask.sparkSession.sparkContext.broadcast(strip)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            strip = shared.value
            total, seen = np.zeros(len(strip.px)), False
            step = max(1, BLOCK // (len(strip.pixels) + len(strip.cells)))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    y, c = matrices_of(batch.slice(start, step), strip)
                    strip.add(total, y, c)
                    seen = True
            if seen:
                for k in range(0, len(total), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(strip.px[part].astype(np.int32)), pa.array(strip.cell[part].astype(np.int32)), pa.array(total[part])], ["px", "cell", "yc"])

        part = rows.mapInArrow(run, "px int, cell int, yc double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return mask.select("px", "cell", F.lit(0.0).alias("yc"))
    return out.groupBy("px", "cell").agg(F.sum("yc").alias("yc"))


def matrices_of(batch: pa.RecordBatch, strip: MaskStrip) -> tuple[np.ndarray, np.ndarray]:
    """(frames by pixels of the strip, frames by its cells)."""
    n = batch.num_rows
    px, value, cell, c = (batch.column(k) for k in range(4))
    sizes = pc.list_value_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = value.flatten()
    flat = (pc.fill_null(flat, 0.0) if flat.null_count else flat).to_numpy(zero_copy_only=False)
    if px.null_count == n and len(set(sizes.tolist())) == 1 and sizes[0] > strip.pixels[-1]:  # whole frames of one size
        y = flat.reshape(n, -1)[:, strip.pixels]
    else:
        if px.null_count == n:
            numbers = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        else:
            numbers = px.flatten().to_numpy(zero_copy_only=False)
        y = strip.frames(np.repeat(np.arange(n), sizes), numbers, flat, n)
    who, size = cell.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(cell).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(strip.cells, who), len(strip.cells) - 1)
    own = strip.cells[at] == who
    traces = np.zeros((n, len(strip.cells)))
    traces[np.repeat(np.arange(n), size)[own], at[own]] = c.flatten().to_numpy(zero_copy_only=False)[own]
    return y, traces


def gram(table: DataFrame, key: str, value: str, *also: str) -> DataFrame:
    """Sums of products of all pairs of cells that meet on ``key``: (…, i, j, g)."""
    left = table.select(key, *also, F.col("cell").alias("i"), F.col(value).alias("vi"))
    right = table.select(key, *also, F.col("cell").alias("j"), F.col(value).alias("vj"))
    return left.join(right, [key, *also]).groupBy(*also, "i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("g"))


def footprint_gram(footprints: DataFrame) -> DataFrame:
    return gram(footprints, "px", "w")


def trace_gram(traces: DataFrame, name: str = "c") -> DataFrame:
    return gram(traces, "frame", name)


#: Frames of a trace that travel as one row to the pairs it is in.
RUN = 4096


def pair_products(traces: DataFrame, pairs: DataFrame, name: str = "c", others: DataFrame | None = None, other: str = "c") -> DataFrame:
    """(i, j, g): sums of products of the traces of the given pairs only, run by run of frames; j's traces come from ``others`` if given."""

    def packed(table: DataFrame, value: str, k: str) -> DataFrame:
        run_of = F.floor((F.col("frame") - 1) / RUN).alias("run")
        grouped = table.groupBy(F.col("cell").alias(k), run_of).agg(F.sort_array(F.collect_list(F.struct("frame", F.col(value).alias("c")))).alias("t"))
        return grouped.select(k, "run", F.col("t.frame").alias(f"frames_{k}"), F.col("t.c").alias(f"c_{k}"))

    left, right = packed(traces, name, "i"), packed(traces if others is None else others, name if others is None else other, "j")
    met = pairs.select("i", "j").distinct().join(left, "i").join(right, ["j", "run"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for a, x, b, y in zip(batch["frames_i"], batch["c_i"], batch["frames_j"], batch["c_j"], strict=True):
                if len(a) != len(b) or (a != b).any():
                    _, at, of = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                    x, y = x[at], y[of]
                sums.append(float(np.dot(x, y)))
            yield pd.DataFrame({"i": batch["i"], "j": batch["j"], "g": sums})

    kind = dict(pairs.dtypes)["i"]
    return met.mapInPandas(run, f"i {kind}, j {kind}, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def residual_norm(rows: DataFrame, footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """Frobenius norm of Y - A C from sums of squares and Gram tables; the residual is never formed."""
    yy = rows.agg(F.sum(F.col("value") * F.col("value")).alias("yy"))
    ay = project_traces(rows, footprints).join(traces.select("frame", "cell", "c"), ["frame", "cell"]).agg(F.sum(F.col("r") * F.col("c")).alias("ayc"))
    aa, cc = footprint_gram(footprints), trace_gram(traces).withColumnRenamed("g", "h")
    both = aa.join(cc, ["i", "j"]).agg(F.sum(F.col("g") * F.col("h")).alias("aacc"))
    total = F.coalesce("yy", F.lit(0.0)) - 2 * F.coalesce("ayc", F.lit(0.0)) + F.coalesce("aacc", F.lit(0.0))
    one = F.lit(1).alias("k")
    joined = yy.select(one, "yy").join(ay.select(one, "ayc"), "k").join(both.select(one, "aacc"), "k")
    return joined.select(F.sqrt(F.greatest(total, F.lit(0.0))).alias("norm"))


def trace_correlation(traces: DataFrame, name: str = "c", pairs: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of all ordered pairs i < j, or of the given ones, from sums; null for constant traces."""
    each = traces.groupBy("cell").agg(F.sum(name).alias("s"), F.sum(F.col(name) * F.col(name)).alias("ss"), F.count("*").alias("n"))
    pairs = trace_gram(traces, name).where("i < j") if pairs is None else pair_products(traces, pairs, name)
    a = each.select(F.col("cell").alias("i"), F.col("s").alias("si"), F.col("ss").alias("qi"), "n")
    b = each.select(F.col("cell").alias("j"), F.col("s").alias("sj"), F.col("ss").alias("qj"))
    x = pairs.join(a, "i").join(b, "j")
    vi, vj = F.col("n") * F.col("qi") - F.col("si") ** 2, F.col("n") * F.col("qj") - F.col("sj") ** 2
    spread = F.when((vi > 1e-12) & (vj > 1e-12), F.sqrt(vi) * F.sqrt(vj))
    return x.select("i", "j", F.try_divide(F.col("n") * F.col("g") - F.col("si") * F.col("sj"), spread).alias("corr"))


def merge_loss(rows: DataFrame, footprints: DataFrame, traces: DataFrame) -> DataFrame:
    """Change of the quadratic loss if trace j is replaced by trace i, for overlapping i and j, from Gram tables.

    Products of traces are formed for cells that overlap, or that overlap one
    and the same cell, and no others.
    """
    aa = saved(footprint_gram(footprints).where("g != 0"), "gram")
    pairs = saved(aa.where("i != j").select("i", "j"), "overlaps")
    near = pairs.select(F.col("i").alias("j"), F.col("j").alias("k"))
    ay = project_traces(rows, footprints).select("frame", "cell", "r")
    own_pairs = aa.where("i = j").select("i", "j")
    ayc = saved(pair_products(traces, pairs.unionByName(own_pairs), "c", ay, "r").withColumnRenamed("g", "p"), "products")
    own = ayc.where("i = j").select("j", F.col("p").alias("pj"))
    wanted = pairs.join(near, "j").select("i", F.col("k").alias("j")).unionByName(pairs).unionByName(own_pairs)
    cc = saved(pair_products(traces, wanted), "trace-products")
    cross = (
        aa.where("i != j").select(F.col("i").alias("j"), F.col("j").alias("k"), "g")
        .join(pairs, "j")
        .join(cc.select("i", F.col("j").alias("k"), F.col("g").alias("cik")), ["i", "k"])
        .join(cc.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("g").alias("cjk")), ["j", "k"])
        .groupBy("i", "j").agg(F.sum(F.col("g") * (F.col("cik") - F.col("cjk"))).alias("x"))
    )
    diagonal = lambda t, k, v: t.where("i = j").select(F.col("i").alias(k), F.col("g").alias(v))
    out = pairs.join(ayc, ["i", "j"]).join(own, "j").join(cross, ["i", "j"]).join(diagonal(aa, "j", "ajj"), "j").join(diagonal(cc, "i", "cii"), "i").join(diagonal(cc, "j", "cjj"), "j")
    loss = -2 * (F.col("p") - F.col("pj")) + 2 * F.col("x") + F.col("ajj") * (F.col("cii") - F.col("cjj"))
    return out.select("i", "j", loss.alias("loss"))
