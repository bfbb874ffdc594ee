"""Per-pixel folds over all frames: sums, extremes, moments, summary images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fovea.functions.columns import image_negentropy, raw_negentropy


def fold(rows: DataFrame, value: Callable[[Column], Column], combine: Callable[[Column], Column], name: str) -> DataFrame:
    """Map each value and combine the results by pixel with an aggregate (partial sums before the shuffle)."""
    return rows.groupBy("px").agg(combine(value(F.col("value"))).alias(name))


def pixel_min(rows: DataFrame) -> DataFrame:
    return fold(rows, lambda v: v, F.min, "minv")


def subtract_min(rows: DataFrame, minima: DataFrame | None = None) -> DataFrame:
    """Every value less its pixel's minimum over all frames."""
    minima = pixel_min(rows) if minima is None else minima
    return rows.join(minima, "px").withColumn("value", F.col("value") - F.col("minv")).drop("minv")


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean of the first four powers by group, in one pass."""
    v = F.col("value")
    return rows.groupBy(*keys).agg(*(F.avg(F.lit(1.0) * v if k == 1 else v**k).alias(f"x{k}") for k in range(1, 5)))


def _x(*k: int) -> list[Column]:
    return [F.col(f"x{i}") for i in k]


def negentropy(rows: DataFrame) -> DataFrame:
    """Summary image (px, v); constant pixels give null."""
    return moments(rows, "px").select("px", image_negentropy(*_x(1, 2, 3, 4)).alias("v"))


def negentropy_no_mean(rows: DataFrame) -> DataFrame:
    return moments(rows, "px").select("px", raw_negentropy(*_x(2, 3, 4)).alias("v"))


def negentropy_per_video(rows: DataFrame) -> DataFrame:
    """Each video by its own length, then the plain mean over the videos."""
    each = moments(rows, "video_id", "px").withColumn("v", image_negentropy(*_x(1, 2, 3, 4)))
    return each.groupBy("px").agg(F.avg("v").alias("v"))


def mean_by_video(rows: DataFrame) -> DataFrame:
    return rows.groupBy("video_id", "px").agg(F.avg("value").alias("m"))


def mean_over_frames(rows: DataFrame, frames: int) -> DataFrame:
    """Mean with absent cells as zero."""
    return rows.groupBy("px").agg((F.sum("value") / frames).alias("m"))


def peak_noise_ratio(rows: DataFrame, frames: int) -> DataFrame:
    """(max - mean) / population deviation by pixel, absent cells as zero; null where constant."""
    v = F.col("value")
    sums = rows.groupBy("px").agg(F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.max(v).alias("top"), F.count("*").alias("n"))
    mean = F.col("s") / frames
    top = F.when(F.col("n") < frames, F.greatest("top", F.lit(0.0))).otherwise(F.col("top"))
    deviation = F.sqrt(F.greatest(F.col("ss") / frames - mean * mean, F.lit(0.0)))
    return sums.select("px", F.try_divide(top - mean, deviation).alias("pnr"))


def peak_frame(rows: DataFrame) -> DataFrame:
    """The frame of each pixel's greatest value, the first one on ties."""
    best = F.max_by(F.struct("frame", "value"), F.struct(F.col("value"), -F.col("frame")))
    return rows.groupBy("px").agg(best.alias("b")).select("px", F.col("b.frame").alias("frame"), F.col("b.value").alias("peak"))


def pixel_rank(image: DataFrame) -> DataFrame:
    """Pixels by falling value, ties by pixel; one image is ordered, as its readers need it."""
    return image.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("v"), "px")))


def cluster_energy_rank(clusters: DataFrame) -> DataFrame:
    """Clusters (seg, px, v) by rising mean square."""
    energy = clusters.groupBy("seg").agg(F.avg(F.col("v") * F.col("v")).alias("energy"))
    return energy.withColumn("rank", F.row_number().over(Window.orderBy("energy", "seg")))


def shifted(rows: DataFrame, reach: int, height: int, width: int, edge: str = "drop") -> DataFrame:
    """Each pixel at every place of the square around it: by offsets and an equi-key, not a range join.

    Places outside the frame are dropped, or (``replicate``) moved to its edge
    by the reader: see ``median_filter``.
    """
    side = F.sequence(F.lit(-reach), F.lit(reach))
    out = rows.withColumn("a", F.explode(side)).withColumn("b", F.explode(side))
    d1, d2 = F.col("px") % height + F.col("a"), F.floor(F.col("px") / height) + F.col("b")
    out = out.withColumn("d1", d1).withColumn("d2", d2).drop("a", "b")
    if edge == "drop":
        out = out.where(F.col("d1").between(0, height - 1) & F.col("d2").between(0, width - 1))
    else:
        out = out.withColumn("d1", F.greatest(F.least("d1", F.lit(height - 1)), F.lit(0))).withColumn("d2", F.greatest(F.least("d2", F.lit(width - 1)), F.lit(0)))
    return out.withColumn("at", (F.col("d1") + F.col("d2") * height).cast("int")).drop("d1", "d2")


def median_filter(image: DataFrame, window: int, height: int, width: int) -> DataFrame:
    """Median of the window around each pixel; edge pixels stand for places outside."""
    centres = shifted(image.select("px"), window // 2, height, width, "replicate")
    return centres.join(image.select(F.col("px").alias("at"), "v"), "at").groupBy("px").agg(F.median("v").alias("v"))


def grid_neighbours(image: DataFrame, height: int, width: int) -> DataFrame:
    """(px, neighbour, v) for the four neighbours inside the frame."""
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    near = image.select("px", F.explode(offsets).alias("o"))
    d1, d2 = F.col("px") % height + F.col("o.a"), F.floor(F.col("px") / height) + F.col("o.b")
    near = near.where(d1.between(0, height - 1) & d2.between(0, width - 1)).select("px", (d1 + d2 * height).cast("int").alias("neighbour"))
    return near.join(image.select(F.col("px").alias("neighbour"), "v"), "neighbour").select("px", "neighbour", "v")
