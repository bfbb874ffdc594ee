"""Parts of a movie with known cells: spots, and traces that decay after spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ar1(spikes: Column, gamma: float) -> Column:
    """The decaying sum c_t = gamma c_(t-1) + s_t of an array, as an array."""
    start = F.array().cast("array<double>")
    return F.aggregate(spikes, start, lambda c, s: F.concat(c, F.array(F.coalesce(F.element_at(F.when(F.size(c) > 0, c), -1), F.lit(0.0)) * gamma + s)))


def ar1_closed(spikes: DataFrame, gamma: float, reach: int) -> DataFrame:
    """The same by rows (cell, frame, s): each spike is spread over the ``reach`` frames that it decays in."""
    spread = spikes.where("s != 0").withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    sums = spread.groupBy("cell", (F.col("frame") + F.col("age")).alias("frame")).agg(F.sum(F.col("s") * F.pow(F.lit(gamma), F.col("age"))).alias("c"))
    return spikes.select("cell", "frame").join(sums, ["cell", "frame"], "left").select("cell", "frame", F.coalesce("c", F.lit(0.0)).alias("c"))


def footprints(spark: SparkSession, cells: int, height: int, width: int, radius: float = 2.0) -> DataFrame:
    """Gaussian spots of unit norm on a square lattice: (cell, px, w)."""
    side = max(1, int(cells**0.5 + 0.999))
    base = spark.range(cells * height * width).select((F.floor(F.col("id") / (height * width)) + 1).cast("int").alias("cell"), (F.col("id") % (height * width)).cast("int").alias("px"))
    k = F.col("cell") - 1
    c1, c2 = (k % side + 0.5) * (height / side), (F.floor(k / side) + 0.5) * (width / side)
    dist = F.pow(F.col("px") % height - c1, 2) + F.pow(F.floor(F.col("px") / height) - c2, 2)
    spots = base.select("cell", "px", F.exp(-dist / (2 * radius * radius)).alias("w")).where("w > 0.05")
    norms = spots.groupBy("cell").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return spots.join(norms, "cell").select("cell", "px", (F.col("w") / F.col("norm")).alias("w"))
