"""What a viewer asks for: frames, overlays, traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.operators.backgrounds import Background


def reconstruct(pixels: DataFrame, frames: DataFrame, footprints: DataFrame, traces: DataFrame, backgrounds: list[Background]) -> DataFrame:
    """(frame, px, value): traces times footprints plus the backgrounds, for the given frames (video_id, frame)."""
    shown = traces.join(frames.select("frame"), "frame", "left_semi").join(footprints, "cell")
    parts = [shown.select("frame", "px", (F.col("c") * F.col("w")).alias("x"))]
    parts += [image for b in backgrounds if (image := b.image(frames)) is not None]
    sums = reduce(DataFrame.unionByName, parts).groupBy("frame", "px").agg(F.sum("x").alias("x"))
    every = frames.select("frame", F.lit(1).alias("k")).join(pixels.select("px", F.lit(1).alias("k")), "k").drop("k")
    return every.join(sums, ["frame", "px"], "left").select("frame", "px", F.coalesce("x", F.lit(0.0)).alias("value"))


def residual(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Movie less model (frame, px, value)."""
    y = rows.select("frame", "px", F.col("value").alias("y"))
    return model.join(y, ["frame", "px"], "left").select("frame", "px", (F.coalesce("y", F.lit(0.0)) - F.col("value")).alias("value"))


def bg_subtracted(pixels: DataFrame, rows: DataFrame, frames: DataFrame, backgrounds: list[Background]) -> DataFrame:
    empty = frames.sparkSession.createDataFrame([], "frame long, cell int, c double")
    none = frames.sparkSession.createDataFrame([], "cell int, px int, w double")
    return residual(rows, reconstruct(pixels, frames, none, empty, backgrounds))


def roi_peaks(footprints: DataFrame) -> DataFrame:
    """(cell, px, w): the greatest pixel of each cell that has unit norm."""
    whole = footprints.groupBy("cell").agg(F.sum(F.col("w") * F.col("w")).alias("norm2"), F.max(F.struct("w", (-F.col("px")).alias("p"))).alias("top"))
    return whole.where("norm2 >= 0.99").select("cell", (-F.col("top.p")).alias("px"), F.col("top.w").alias("w"))


def distinct_colours(cells: DataFrame) -> DataFrame:
    """``cells`` with red, green, blue and color (RRGGBB): hues a golden angle apart by cell number."""
    hue = F.pmod(F.col("cell") * 0.6180339887498949, F.lit(1.0)) * 6

    def channel(shift: float) -> Column:
        at = F.abs(F.pmod(hue + shift, F.lit(6.0)) - 3)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - 1))

    mixed = cells.withColumns({"red": channel(0.0), "green": channel(4.0), "blue": channel(2.0)})
    octets = [F.lpad(F.hex(F.round(F.col(c) * 255).cast("long")), 2, "0") for c in ("red", "green", "blue")]
    return mixed.withColumn("color", F.concat(*octets))


def random_colours(cells: DataFrame, seed: int = 1) -> DataFrame:
    """``cells`` with red, green, blue: random by cell and seed, brought to a sum of two and clamped to one."""
    parts = [(F.pmod(F.xxhash64(F.col("cell"), F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 1) / float(1 << 30) for k in range(3)]
    total = parts[0] + parts[1] + parts[2]
    return cells.withColumns({n: F.least(F.lit(1.0), p * 2 / total) for n, p in zip(("red", "green", "blue"), parts, strict=True)})


def image_rows(image: DataFrame, height: int, width: int, name: str = "v") -> DataFrame:
    """(d1, row): an image as one array a line, absent pixels null; for a heat map of one frame's size."""
    cells = image.select((F.col("px") % height).alias("d1"), F.floor(F.col("px") / height).cast("int").alias("d2"), F.col(name).alias("v"))
    lines = cells.groupBy("d1").agg(F.map_from_entries(F.collect_list(F.struct("d2", "v"))).alias("m"))
    return lines.select("d1", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.try_element_at("m", k)).alias("row"))


def roi_composite(footprints: DataFrame, colours: DataFrame, pixels: DataFrame) -> DataFrame:
    """(px, red, green, blue): cells painted over each other in order, as opaque as their share of the cell's maximum."""
    stats = footprints.groupBy("cell").agg(F.sum(F.col("w") * F.col("w")).alias("norm2"), F.max("w").alias("top")).where("norm2 >= 0.99")
    layers = footprints.join(stats, "cell").join(colours, "cell").select("px", F.struct("cell", (F.col("w") / F.col("top")).alias("alpha"), "red", "green", "blue").alias("layer"))
    stacked = layers.groupBy("px").agg(F.sort_array(F.collect_list("layer")).alias("layers"))

    def over(channel: str) -> Column:
        return F.aggregate("layers", F.lit(0.0), lambda below, layer: below * (1 - layer["alpha"]) + layer[channel] * layer["alpha"])

    painted = stacked.select("px", *(over(c).alias(c) for c in ("red", "green", "blue")))
    return pixels.join(painted, "px", "left").select("px", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("red", "green", "blue")))


def roi_labels(footprints: DataFrame, pixels: DataFrame) -> DataFrame:
    """(px, cell): the cell of greatest weight (the first on ties), null where there is none."""
    best = footprints.where("w > 0").groupBy("px").agg(F.max(F.struct("w", (-F.col("cell")).alias("c"))).alias("b"))
    return pixels.join(best, "px", "left").select("px", (-F.col("b.c")).cast("int").alias("cell"))


def trace_zoom(traces: DataFrame, cell: int, rate: float = 20.0, reach: float = 10.0, name: str = "c") -> DataFrame:
    """The trace within ``reach`` seconds of its peak (the first one)."""
    one = traces.where(F.col("cell") == cell)
    peak = one.agg(F.max_by("frame", F.struct(F.col(name), -F.col("frame"))).alias("peak"))
    near = F.abs(F.col("frame") / rate - F.col("peak") / rate) <= reach
    return one.withColumn("k", F.lit(1)).join(peak.withColumn("k", F.lit(1)), "k").where(near).select("frame", F.col(name).alias("value"))


def log_image(image: DataFrame) -> DataFrame:
    """Decimal logarithm; null where there is none."""
    return image.select("px", F.when(F.col("v") > 0, F.log10("v")).alias("log_v"))


def stacked_traces(traces: DataFrame, step: float = 200.0, name: str = "r") -> DataFrame:
    """Traces drawn below each other."""
    return traces.select("cell", "frame", (F.col(name) - step * F.col("cell")).alias("y"))


def stepped(frame: Column, by: Column | int, frames: int) -> Column:
    """The frame ``by`` steps on, around the end (frames count from 1)."""
    return F.pmod(frame - 1 + by, F.lit(frames)) + 1
