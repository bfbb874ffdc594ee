"""Alternating updates of traces and footprints, cell after cell in order.

A cell reads the new values of the cells before it that it overlaps, and the
old values of those after it. So the cells are dealt to levels: a cell's level
is one more than the greatest of the cells before it that it overlaps. Cells of
a level do not read each other and are updated together, in as many tasks as
there are; the result is that of one pass over all cells in order. Cells that
do not overlap at all do not wait for each other either: a connected part of
few values (``TOGETHER``) is updated in order in one task, and only larger
parts go by levels, each a job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions import deconvolution
from fovea.functions.lineage import own_folder, saved
from fovea.operators.components import dependency_levels, with_component
from fovea.operators.folds import shifted
from fovea.operators.products import footprint_gram, pair_products

TRACE_ROWS = "cell int, frames array<long>, r array<double>, c array<double>, s array<double>, gamma double, lambda double"
Deconvolve = Callable[[np.ndarray, float, float], tuple[np.ndarray, np.ndarray, float, float]]
#: Values (cells times frames) of one task of a clamp, at most.
CLAMP_VALUES = 1 << 22
#: Values (cells times frames, or cells times pixels) of a connected part that one task updates, at most.
TOGETHER = 1 << 22


def zero_clamp(r: np.ndarray, gamma: float, lam: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    return np.where(r > 0, r, 0.0), np.zeros(len(r)), gamma, lam


def oasis_fixed(r: np.ndarray, gamma: float, lam: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    return (*deconvolution.oasis(r, gamma, lam), gamma, lam)


def oasis_fitted(r: np.ndarray, gamma: float, lam: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    return deconvolution.fitted(r, gamma, lam)


class Levels:
    """Results of one pass, a level a folder; later levels read those of the levels they need."""

    def __init__(self, cells: DataFrame, links: DataFrame, schema: str):
        self.spark, self.schema = cells.sparkSession, schema
        self.table = saved(dependency_levels(cells, links), "levels")
        self.path = f"{own_folder(self.spark)}/sweep-{uuid.uuid4().hex}"
        self.depth = (self.table.agg(F.max("level").alias("d")).first()["d"] or 0) + 1
        at = lambda c: self.table.select(F.col("cell").alias(c), F.col("level").alias(f"l{c}"))
        pairs = links.join(at("i"), "i").join(at("j"), "j").select("lj", "li").distinct().collect()
        self.needs: dict[int, list[int]] = {}
        for r in pairs:
            self.needs.setdefault(r["lj"], []).append(r["li"])

    def write(self, level: int, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/level={level}")

    def before(self, level: int) -> DataFrame | None:
        """Results of the levels that this one reads."""
        needed = [f"{self.path}/level={k}" for k in sorted(self.needs.get(level, []))]
        return self.spark.read.schema(self.schema).parquet(*needed) if needed else None

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema + ", level int").option("basePath", self.path).parquet(self.path).drop("level")


def less_others(rows: DataFrame, others: DataFrame | None, finish: Callable, schema: str) -> DataFrame:
    """``rows`` (cell, frames, r, gamma, lambda) less the traces of ``others`` (cell, g, frames, c), then ``finish`` on each.

    A cell's own row comes first and the others' one after another, so a task
    holds one trace and one batch of others, whatever the number of these.
    Frames that the other trace lacks count as zero.
    """
    spark = rows.sparkSession
    own = rows.select("cell", F.lit(0).alias("kind"), F.lit(0.0).alias("g"), "frames", F.col("r").alias("v"), "gamma", "lambda")
    if others is not None:
        own = own.unionByName(others.select("cell", F.lit(1).alias("kind"), "g", "frames", F.col("c").alias("v"), F.lit(0.0).alias("gamma"), F.lit(0.0).alias("lambda")))
    # much work a byte, so the number of parts is not left to sizes
    dealt = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.kind == 0:
                    if held is not None:
                        yield finish(*held)
                    held = [row.cell, np.asarray(row.frames), np.array(row.v, float), row.gamma, row[6]]
                    continue
                frames, c = np.asarray(row.frames), np.asarray(row.v, float)
                if len(frames) == len(held[1]) and (frames == held[1]).all():
                    held[2] -= row.g * c
                else:
                    _, a, b = np.intersect1d(held[1], frames, assume_unique=True, return_indices=True)
                    held[2][a] -= row.g * c[b]
        if held is not None:
            yield finish(*held)

    return dealt.mapInPandas(run, schema)


def apart(frames: np.ndarray, r: np.ndarray, gamma: float, lam: float, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(c, s) of a trace deconvolved part by part; parts begin at the given frames."""
    cuts = np.searchsorted(frames, sorted(starts))
    parts = [deconvolution.oasis(p, gamma, lam) for p in np.split(r, cuts) if len(p)]
    return np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts])


def wavefront(packed: DataFrame, aa: DataFrame, deconvolve: Deconvolve, starts: list[int] | None = None) -> DataFrame:
    """Whole traces (cell, frames, x, c, gamma, lambda) updated level by level."""
    links = aa.where("i < j AND g != 0").select("i", "j")
    levels = Levels(packed.select("cell"), links, TRACE_ROWS)

    def unchanged(cell, frames, r, gamma, lam) -> pd.DataFrame:
        return pd.DataFrame({"cell": [cell], "frames": [frames], "r": [r], "gamma": [gamma], "lambda": [lam]})

    def updated(cell, frames, r, gamma, lam) -> pd.DataFrame:
        c, s, gamma, lam = deconvolve(r, gamma, lam)
        if starts is not None:
            c, s = apart(frames, r, gamma, lam, starts)
        return pd.DataFrame({"cell": [cell], "frames": [frames], "r": [r], "c": [c], "s": [s], "gamma": [gamma], "lambda": [lam]})

    start = packed.select("cell", "frames", F.zip_with("x", "c", lambda x, c: x + c).alias("r"), "gamma", "lambda")
    mine = packed.select(F.col("cell").alias("other"), "frames", "c")
    old = aa.where("j >= i AND g != 0").select(F.col("i").alias("cell"), F.col("j").alias("other"), "g").join(mine, "other")
    base = less_others(start, old, unchanged, "cell int, frames array<long>, r array<double>, gamma double, lambda double")
    base = saved(base.join(levels.table, "cell"), "sweep-base", "level")
    for level in range(levels.depth):
        before, new = levels.before(level), None
        if before is not None:
            mine = before.select(F.col("cell").alias("other"), "frames", "c")
            own = levels.table.where(F.col("level") == level).select("cell")
            new = aa.where("j < i AND g != 0").select(F.col("i").alias("cell"), F.col("j").alias("other"), "g").join(own, "cell", "left_semi").join(mine, "other")
        levels.write(level, less_others(base.where(F.col("level") == level), new, updated, TRACE_ROWS))
    return levels.all()


def in_order(deconvolve: Deconvolve, starts: list[int] | None = None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The pass over the cells of one group of rows (cell, frames, x, c, near, gamma, lambda)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell", ignore_index=True)
        at = {cell: k for k, cell in enumerate(rows["cell"])}
        frames = np.unique(np.concatenate(rows["frames"].to_list()))
        where = [np.searchsorted(frames, f) for f in rows["frames"]]
        c = np.zeros((len(rows), len(frames)))
        for k, old in enumerate(rows["c"]):
            c[k, where[k]] = old
        out = []
        for k, row in rows.iterrows():
            r = row["x"] + c[k, where[k]]
            for n in row["near"]:
                if n["j"] in at:
                    r = r - n["g"] * c[at[n["j"]], where[k]]
            new, s, gamma, lam = deconvolve(r, row["gamma"], row["lambda"])
            if starts is not None:
                new, s = apart(row["frames"], r, gamma, lam, starts)
            c[k, where[k]] = new
            out.append((row["cell"], row["frames"], r, new, s, gamma, lam))
        return pd.DataFrame(out, columns=["cell", "frames", "r", "c", "s", "gamma", "lambda"])

    return run


def neighbours(aa: DataFrame) -> DataFrame:
    return aa.groupBy(F.col("i").alias("cell")).agg(F.collect_list(F.struct("j", "g")).alias("near"))


def clamp_by_frames(packed: DataFrame, aa: DataFrame) -> DataFrame:
    """The same pass for a clamp, which works frame by frame: a run of frames of all cells is one task."""
    return packed.join(neighbours(aa), "cell").groupBy("part").applyInPandas(in_order(zero_clamp), TRACE_ROWS)


def by_parts(packed: DataFrame, aa: DataFrame, deconvolve: Deconvolve, starts: list[int] | None = None) -> DataFrame:
    """Whole traces updated by connected parts: those of few values in a task each, the others by levels."""
    packed = saved(with_component(packed, aa.where("i < j AND g != 0").select("i", "j")), "packed-values")
    sizes = packed.groupBy("component").agg(F.sum(F.size("frames")).alias("values"))
    small = saved(sizes.where(F.col("values") <= TOGETHER).select("component"), "small-parts")
    out = packed.join(small, "component", "left_semi").join(neighbours(aa), "cell").groupBy("component").applyInPandas(in_order(deconvolve, starts), TRACE_ROWS)
    large = packed.join(small, "component", "left_anti").drop("component")
    if large.isEmpty():
        return out
    found = wavefront(saved(large, "packed-values"), aa, deconvolve, starts)
    return found if small.isEmpty() else out.unionByName(found)


def trace_sweep(values: DataFrame, footprints: DataFrame, deconvolve: Deconvolve = zero_clamp, cells: DataFrame | None = None, frames_per_task: int | None = 256, starts: list[int] | None = None) -> DataFrame:
    """One pass over the cells.

    ``values``: (frame, cell, x, c), the projections less the background's part
    and the traces so far. ``cells``: (cell, gamma, lambda), default 0.8 and
    50. A clamp works frame by frame, so it is cut into runs of
    ``frames_per_task`` (fewer where there are many cells); a deconvolution
    needs whole traces and goes by connected parts and levels. With ``starts``, the first frames of
    videos (one number a video), no pool of a deconvolution crosses from one to
    the next; its parameters still are those of the whole trace.

    Returns packed rows: cell, frames, r, c, s, gamma, lambda; see ``unpacked``.
    """
    aa = saved(footprint_gram(footprints), "gram")
    by_frames = deconvolve is zero_clamp and frames_per_task is not None
    if by_frames:
        n = footprints.select("cell").distinct().count()
        part = F.floor((F.col("frame") - 1) / max(1, min(frames_per_task, CLAMP_VALUES // max(1, n))))
    else:
        part = F.lit(0)
    packed = values.join(footprints.select("cell").distinct(), "cell", "left_semi")
    packed = packed.groupBy("cell", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("frame", "x", "c"))).alias("t"))
    packed = packed.select("cell", "part", F.col("t.frame").alias("frames"), F.col("t.x").alias("x"), F.col("t.c").alias("c"))
    if cells is None:
        packed = packed.withColumns({"gamma": F.lit(0.8), "lambda": F.lit(50.0)})
    else:
        packed = packed.join(cells.select("cell", "gamma", "lambda"), "cell")
    return clamp_by_frames(packed, aa) if by_frames else by_parts(packed, aa, deconvolve, starts)


def unpacked(packed: DataFrame) -> DataFrame:
    """(frame, cell, r, c, s)."""
    zipped = F.explode(F.arrays_zip("frames", "r", "c", "s")).alias("t")
    return packed.select("cell", zipped).select(F.col("t.frames").alias("frame"), "cell", "t.r", "t.c", "t.s")


def dilated(footprints: DataFrame, height: int, width: int, reach: int = 1) -> DataFrame:
    """(cell, px): each footprint's pixels and the square around them, inside the frame."""
    grown = shifted(footprints.where("w > 0").select("cell", "px"), reach, height, width)
    return grown.select("cell", F.col("at").alias("px")).distinct()


def less_overlap(rows: DataFrame, weights: DataFrame, cc: DataFrame) -> DataFrame:
    """``rows`` (cell, px, v) less, at each pixel, the weights of others times the product of traces (cell, other, g)."""
    there = weights.select(F.col("cell").alias("other"), "px", "w")
    taken = rows.select("cell", "px").join(there, "px").join(cc, ["cell", "other"])
    taken = taken.groupBy("cell", "px").agg(F.sum(F.col("g") * F.col("w")).alias("taken"))
    return rows.join(taken, ["cell", "px"], "left").withColumn("v", F.col("v") - F.coalesce("taken", F.lit(0.0))).drop("taken")


def footprint_sweep(sums: DataFrame, footprints: DataFrame, traces: DataFrame, height: int, width: int, reach: int = 1) -> DataFrame:
    """One pass over the cells: new footprints (cell, px, w), positive and of unit norm; empty cells have no rows.

    ``sums``: (px, cell, v), the pixel sums with the traces less the
    background's part. Masks come from the footprints before the pass. Parts of
    few values are a task each, the others go by levels.
    """
    mask = saved(dilated(footprints, height, width, reach), "mask")
    meet = mask.select("px", F.col("cell").alias("i")).join(mask.select("px", F.col("cell").alias("j")), "px").where("i < j")
    links = saved(meet.select("i", "j").distinct(), "mask-links")
    cc = pair_products(traces, links)
    cc = saved(cc.select(F.col("i").alias("cell"), F.col("j").alias("other"), "g").unionByName(cc.select(F.col("j").alias("cell"), F.col("i").alias("other"), "g")), "pair-gram")
    base = mask.join(sums, ["cell", "px"], "left").select("cell", "px", F.coalesce("v", F.lit(0.0)).alias("v"))
    parts = with_component(mask.select("cell").distinct(), links)
    base = saved(base.join(parts, "cell"), "sweep-sums")
    sizes = base.groupBy("component").agg((F.count_distinct("cell") * F.count_distinct("px")).alias("values"))
    small = saved(sizes.where(F.col("values") <= TOGETHER).select("component"), "small-parts")
    out = small_footprints(base.join(small, "component", "left_semi"), footprints, cc)
    large = base.join(small, "component", "left_anti").drop("component")
    if large.isEmpty():
        return out
    found = footprint_levels(saved(large, "sweep-sums"), footprints, links, cc)
    return found if small.isEmpty() else out.unionByName(found)


def small_footprints(base: DataFrame, footprints: DataFrame, cc: DataFrame) -> DataFrame:
    """The pass over connected parts, a task each: ``base`` (component, cell, px, v)."""
    near = cc.groupBy("cell").agg(F.collect_list(F.struct("other", "g")).alias("near"))
    cells = base.join(footprints.select("cell", "px", "w"), ["cell", "px"], "left")
    cells = cells.groupBy("component", "cell").agg(F.sort_array(F.collect_list(F.struct("px", "v", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("p"))
    cells = cells.select("component", "cell", F.col("p.px").alias("px"), F.col("p.v").alias("v"), F.col("p.w").alias("w")).join(near, "cell", "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell", ignore_index=True)
        at, pixels = {cell: k for k, cell in enumerate(rows["cell"])}, np.unique(np.concatenate(rows["px"].to_list()))
        where = [np.searchsorted(pixels, p) for p in rows["px"]]
        a = np.zeros((len(rows), len(pixels)))
        for k, w in enumerate(rows["w"]):
            a[k, where[k]] = w
        out = []
        for k, row in rows.iterrows():
            new = np.array(row["v"], float)
            for n in row["near"] if row["near"] is not None else ():
                new -= n["g"] * a[at[n["other"]], where[k]]
            new = np.maximum(new, 0.0)
            new /= np.sqrt((new * new).sum()) + 1e-10
            a[k, where[k]] = new
            out.append(pd.DataFrame({"cell": row["cell"], "px": row["px"], "w": new}))
        return pd.concat(out).query("w > 0")

    return cells.groupBy("component").applyInPandas(run, "cell int, px int, w double")


def footprint_levels(base: DataFrame, footprints: DataFrame, links: DataFrame, cc: DataFrame) -> DataFrame:
    """The pass by levels: ``base`` (cell, px, v). A level is a join on pixels and a sum by pixel and cell; no cell or part is held as an array."""
    levels = Levels(base.select("cell").distinct(), links, "cell int, px int, w double")
    base = less_overlap(base, footprints, cc.where("other > cell"))
    base = saved(base.join(levels.table, "cell"), "sweep-base", "level")
    whole = Window.partitionBy("cell")
    for level in range(levels.depth):
        rows, before = base.where(F.col("level") == level).drop("level"), levels.before(level)
        if before is not None:
            rows = less_overlap(rows, before, cc.where("other < cell"))
        rows = rows.where("v > 0").withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(whole)) + 1e-10)
        levels.write(level, rows.select("cell", "px", (F.col("v") / F.col("norm")).alias("w")).where("w > 0"))
    return levels.all()


def drop_empty(table: DataFrame, footprints: DataFrame) -> DataFrame:
    """Rows of the cells that still have a footprint."""
    return table.join(footprints.where("w != 0").select("cell").distinct(), "cell", "left_semi")
