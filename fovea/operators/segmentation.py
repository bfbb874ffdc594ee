"""Regions of interest of summary images; one group per image, so images run in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions import regions
from fovea.functions.lineage import saved

Finder = Callable[[np.ndarray, int, int], list[dict[int, float]]]


def segment(images: DataFrame, height: int, width: int, find: Finder) -> DataFrame:
    """(image, cell, px, w) of images given as (image, px, v); a pixel without a value is left out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        flat = np.full(height * width, np.nan)
        flat[rows["px"]] = rows["v"].astype(float)
        found = [(k, px, w) for k, cell in enumerate(find(flat, height, width), 1) for px, w in sorted(cell.items())]
        out = pd.DataFrame(found, columns=["cell", "px", "w"])
        out.insert(0, "image", rows["image"].iloc[0])
        return out

    return images.groupBy("image").applyInPandas(run, "image int, cell int, px int, w double")


#: Side of the tiles that a larger image is cut into.
TILE = 1024


def unionfind(images: DataFrame, height: int, width: int, min_size: int = 20, sens: float = 50.0, min_n: int = 1000, nan_first: bool = False, tile: int = TILE) -> DataFrame:
    """Regions by a descending flood; frames larger than a tile are flooded by tiles (``nan_first`` takes a whole image a task)."""
    if nan_first or max(height, width) <= tile:
        return segment(images, height, width, lambda i, h, w: regions.unionfind_regions(i, h, w, min_size, sens, min_n, nan_first))
    return regions_of_clusters(flood_by_tiles(images, height, width, min_size, tile), sens, min_n)


#: Rows of a flood by tiles: pixels to come, settled pixels beside them, their clusters (px and label its name, n its size), pixels around a tile, settled pixels, clusters (label) that are another now (part).
OPEN, BESIDE, CLUSTER, RING, SETTLED, ABSORBED = range(6)
FLOOD = "image int, kind int, px int, v double, label int, part int, n int"


def around_tiles(images: DataFrame, height: int, width: int, side: int) -> DataFrame:
    """(image, px, v, a, b): the pixels beside tile (a, b), which are of other tiles."""
    x, y = F.col("px") % height, F.expr(f"px div {height}")
    tile = lambda x, y: F.struct(F.floor(x / side).cast("int").alias("a"), F.floor(y / side).cast("int").alias("b"))
    beside = [F.when((x + i).between(0, height - 1) & (y + j).between(0, width - 1), tile(x + i, y + j)) for j, i in regions.STEPS]
    others = F.filter(F.array_distinct(F.array(*beside)), lambda t: t.isNotNull() & (t != tile(x, y)))
    return images.select("image", "px", "v", F.explode(others).alias("t")).select("image", "px", "v", "t.a", "t.b")


def flood_by_tiles(images: DataFrame, height: int, width: int, min_size: int, tile: int) -> DataFrame:
    """(image, px, v, label): clusters of the descending flood, named by their first pixel (-1: smaller than ``min_size``).

    The flood of a pixel depends on what is connected to it through pixels
    before it alone. Tiles settle all pixels for which that lies inside; what
    is left, with the settled pixels beside it, goes to tiles of twice the
    side, up to the whole image. So bright parts are flooded tile by tile, and
    the last task holds the pixels under the level at which parts meet across
    the image. The result is that of one pass.
    """
    images = saved(images.where("v IS NOT NULL AND NOT isnan(v)").select(F.col("image").cast("int").alias("image"), F.col("px").cast("int").alias("px"), F.col("v").cast("double").alias("v")), "tile-images")
    none = F.lit(None).cast("int")
    state = images.select("image", F.lit(OPEN).alias("kind"), "px", "v", none.alias("label"), none.alias("part"), none.alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of = dict(iter(rows.groupby("kind")))
        columns = lambda kind, *names: zip(*(of[kind][c].tolist() for c in names), strict=True) if kind in of else ()
        pixels, ring, size = dict(columns(OPEN, "px", "v")), dict(columns(RING, "px", "v")), {int(k): int(n) for k, n in columns(CLUSTER, "label", "n")}
        known = {p: (int(k), int(c)) for p, k, c in columns(BESIDE, "px", "label", "part")}
        label, part, left, sizes, now = regions.flood_tile(pixels, known, size, ring, height, width, min_size)
        waiting = ring.keys() | set(left)
        beside = [p for p in label if not waiting.isdisjoint(regions.neighbours(p, height, width))]
        out = [(OPEN, p, pixels[p], None, None, None) for p in left]
        out += [(BESIDE, p, None, label[p], part[p], None) for p in beside]
        out += [(CLUSTER, k, None, k, None, sizes[k]) for k in {label[p] for p in beside}]
        out += [(SETTLED, p, pixels[p], label[p], None, None) for p in label if p in pixels]
        out += [(ABSORBED, k, None, k, r, None) for k, r in now.items() if k != r]
        found = pd.DataFrame(out, columns=["kind", "px", "v", "label", "part", "n"]).astype({c: "Int32" for c in ("kind", "px", "label", "part", "n")})
        found.insert(0, "image", rows["image"].iloc[0])
        return found

    side, settled = tile, None
    while True:
        tiled = state.withColumn("a", F.expr(f"CAST((px % {height}) div {side} AS INT)")).withColumn("b", F.expr(f"CAST((px div {height}) div {side} AS INT)"))
        ring = around_tiles(images, height, width, side).withColumn("kind", F.lit(RING))
        found = saved(tiled.unionByName(ring, allowMissingColumns=True).groupBy("image", "a", "b").applyInPandas(run, FLOOD), "tiles")
        if settled is not None:
            absorbed = found.where(F.col("kind") == ABSORBED).select("image", "label", F.col("part").alias("now"))
            settled = settled.join(absorbed, ["image", "label"], "left").select("image", "px", "v", F.coalesce("now", "label").alias("label"))
        here = found.where(F.col("kind") == SETTLED).select("image", "px", "v", "label")
        settled = here if settled is None else settled.unionByName(here)
        if side >= max(height, width):
            break
        state, side = found.where(F.col("kind") <= CLUSTER), 2 * side
    large = settled.groupBy("image", "label").count().where(F.col("count") >= min_size).select("image", "label", F.lit(True).alias("large"))
    labels = settled.join(large, ["image", "label"], "left").select("image", "px", "v", F.when(F.col("large"), F.col("label")).otherwise(-1).alias("label"))
    return saved(labels, "flood")


def regions_of_clusters(labels: DataFrame, sens: float, min_n: int) -> DataFrame:
    """(image, cell, px, w): the clusters that stand out of the pooled noise of those below them; a task ranks the clusters of an image by their sums."""
    first = F.max(F.when(F.col("px") == F.col("label"), F.col("v"))).alias("first")
    sums = labels.groupBy("image", "label").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") ** 2).alias("ss"), first)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # ties of energy: the pixels of no cluster, then clusters as they began
        rows = rows.assign(energy=rows["ss"] / rows["n"], order=np.where(rows["label"] < 0, -np.inf, -rows["first"])).sort_values(["energy", "order", "label"])
        kept = rows.iloc[regions.standing_out(list(zip(rows["n"], rows["s"], rows["ss"], strict=True)), sens, min_n)]
        return pd.DataFrame({"image": kept["image"], "label": kept["label"], "cell": range(1, len(kept) + 1)})

    cells = sums.groupBy("image").applyInPandas(run, "image int, label int, cell int")
    weights = labels.where("v > 0").join(cells, ["image", "label"])
    norm = weights.groupBy("image", "cell").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    return weights.join(norm, ["image", "cell"]).select("image", "cell", "px", (F.col("v") / F.col("norm")).alias("w"))


def peaks(images: DataFrame, height: int, width: int, threshold: float) -> DataFrame:
    return segment(images, height, width, lambda i, h, w: regions.peak_regions(i, h, w, threshold))


def peaks_tolerance(images: DataFrame, height: int, width: int, tol: float = 0.5) -> DataFrame:
    return segment(images, height, width, lambda i, h, w: regions.tolerance_regions(i, h, w, tol))


def init_footprints(image: DataFrame, height: int, width: int, **limits: float) -> DataFrame:
    """(cell, px, w) from one summary image (px, v)."""
    return unionfind(image.withColumn("image", F.lit(1)), height, width, **limits).drop("image")


UNITS = "unit string, px int, z double, hot boolean, pnr double"


def growth_units(ratio: DataFrame, peaks_of: DataFrame, rows: DataFrame, height: int, width: int) -> DataFrame:
    """(unit, px, z, hot, pnr): of each frame in which some pixel peaks, the pixels over its threshold and the seeds that peak in it, by connected part.

    A frame is one group; z is the z-score, hot says that it is over the
    threshold, pnr is set for seeds. The threshold is minus the frame's least
    z-score; pixels without a value count as zero.
    """
    stats = rows.groupBy("px").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    seeds = ratio.join(peaks_of, "px").where(F.col("pnr").isNotNull() & ~F.isnan("pnr")).select("px", "pnr", "frame")
    local = rows.join(seeds.select("frame").distinct(), "frame").join(stats, "px")
    local = local.select("frame", "px", F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("sd")), F.lit(0.0)).alias("z"))
    least = local.groupBy("frame").agg(F.min("z").alias("z"), F.count_distinct("px").alias("n"))
    least = least.select("frame", (-F.when(F.col("n") < height * width, F.least("z", F.lit(0.0))).otherwise(F.col("z"))).alias("threshold"))
    found = local.join(least, "frame").join(seeds, ["frame", "px"], "left").withColumn("hot", F.col("z") > F.col("threshold"))
    found = found.where(F.col("hot") | F.col("pnr").isNotNull()).select("frame", "px", "z", "hot", "pnr")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = regions.connected_parts(rows["px"].tolist(), height, width)
        out = rows[["px", "z", "hot", "pnr"]].copy()
        out.insert(0, "unit", [f"{rows['frame'].iloc[0]}:{part[p]}" for p in rows["px"]])
        return out

    return found.groupBy("frame").applyInPandas(run, UNITS)


def grow_from_peaks(ratio: DataFrame, peaks_of: DataFrame, rows: DataFrame, height: int, width: int, least: int = 50) -> DataFrame:
    """Regions grown on the z-scored frame in which their seed peaks, seed after seed by falling ratio, over pixels not taken before.

    Connected parts of a frame (units) only meet where they hold one pixel. In
    a round every unit grows its seeds in order, as far as no other unit that
    shares a pixel with it has a better seed left; then what was taken leaves
    all units. So rounds follow the longest chain of units that wait for each
    other, and the regions are those of one pass over all seeds. A unit, a
    frame at most, is one group.
    """
    units = saved(growth_units(ratio, peaks_of, rows, height, width), "units")
    key = F.struct((-F.col("pnr")).alias("order"), "px")
    out, first = None, Window.partitionBy("px").orderBy("head", "unit")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bar = (rows["bar_order"].iloc[0], rows["bar_px"].iloc[0])
        found = regions.grown_in_order(rows["px"].tolist(), rows["z"].tolist(), rows["hot"].tolist(), rows["pnr"].tolist(), None if np.isnan(bar[0]) else bar, height, width)
        return pd.DataFrame(found, columns=["seed", "pnr", "px", "z"])

    while True:
        heads = units.where("pnr IS NOT NULL").groupBy("unit").agg(F.min(key).alias("head"))
        pending = saved(units.join(heads, "unit"), "pending")
        if pending.isEmpty():
            break
        # the best two units of each pixel tell each unit the best of the others
        two = pending.select("px", "unit", "head").withColumn("k", F.row_number().over(first)).where("k <= 2")
        two = two.groupBy("px").agg(F.max(F.when(F.col("k") == 1, F.col("unit"))).alias("of"), F.min(F.when(F.col("k") == 1, F.col("head"))).alias("one"), F.min(F.when(F.col("k") == 2, F.col("head"))).alias("two"))
        bars = pending.select("unit", "px").join(two, "px").groupBy("unit").agg(F.min(F.when(F.col("of") == F.col("unit"), F.col("two")).otherwise(F.col("one"))).alias("bar"))
        free = pending.join(bars, "unit").where(F.col("bar").isNull() | (F.col("head") < F.col("bar")))
        free = free.select("unit", "px", "z", "hot", "pnr", F.col("bar.order").alias("bar_order"), F.col("bar.px").cast("double").alias("bar_px"))
        taken = saved(free.groupBy("unit").applyInPandas(run, "seed int, pnr double, px int, z double"), "taken")
        out = taken if out is None else out.unionByName(taken)
        units = saved(pending.select("unit", "px", "z", "hot", "pnr").join(taken.select("px").distinct(), "px", "left_anti"), "units")
    if out is None:
        return units.select(F.lit(0).alias("cell"), "px", F.col("z").alias("w"))
    weighted = out.where("z != 0").withColumn("n", F.count("*").over(Window.partitionBy("seed"))).where(F.col("n") > least)
    # a row a cell is ordered
    names = weighted.groupBy("seed").agg(F.max("pnr").alias("pnr")).withColumn("cell", F.row_number().over(Window.orderBy(F.desc("pnr"), "seed")))
    return weighted.join(names.select("seed", "cell"), "seed").select("cell", "px", F.col("z").alias("w"))
