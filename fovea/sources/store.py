"""Saved solutions: a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.operators.backgrounds import Background, PerVideo, RankOne, Static

KEY = "animal[0-9].*day[0-9]+"
TABLES = ("footprints", "image", "traces", "cells", "meta")
#: Backgrounds by type name: what they are written as, and how they are made again.
KINDS: dict[str, tuple[Callable, Callable]] = {
    "static": (lambda b: {"b": b.table}, lambda t: Static(t["b"])),
    "per_video": (lambda b: {"b": b.table}, lambda t: PerVideo(t["b"])),
    "rank_one": (lambda b: {"b": b.table, "f": b.trace}, lambda t: RankOne(t["b"], t["f"])),
}
NAMES = {Static: "static", PerVideo: "per_video", RankOne: "rank_one"}


def video_key(filename: Column) -> Column:
    """The recording's name inside a file name; the whole name if it has none."""
    key = F.regexp_extract(filename, KEY, 0)
    return F.when(key == "", filename).otherwise(key)


def keyed_traces(traces: DataFrame, videos: DataFrame) -> DataFrame:
    """Traces with the key of their video (videos: video_id, filename)."""
    return traces.join(videos.select("video_id", video_key(F.col("filename")).alias("video_key")), "video_id")


def save(path: str, tables: dict[str, DataFrame], backgrounds: list[Background], videos: DataFrame | None = None) -> None:
    """Write the tables and backgrounds; with ``videos``, traces are partitioned by video key."""
    for name, table in tables.items():
        writer = table.write
        if name == "traces" and videos is not None:
            writer = keyed_traces(table, videos).write.partitionBy("video_key")
        writer.mode("overwrite").parquet(f"{path}/{name}")
    kinds = []
    for k, background in enumerate(backgrounds):
        kind = NAMES[type(background)]
        kinds.append((k, kind))
        for part, table in KINDS[kind][0](background).items():
            table.write.mode("overwrite").parquet(f"{path}/background{k}_{part}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(kinds, "k int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/backgrounds")


def load(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> tuple[dict[str, DataFrame], list[Background]]:
    """Read a saved solution back, single-video or not."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in names}
    backgrounds = []
    for row in spark.read.parquet(f"{path}/backgrounds").orderBy("k").toLocalIterator():
        parts = {"b": spark.read.parquet(f"{path}/background{row['k']}_b")}
        if row["kind"] == "rank_one":
            parts["f"] = spark.read.parquet(f"{path}/background{row['k']}_f")
        backgrounds.append(KINDS[row["kind"]][1](parts))
    return tables, backgrounds


def normalised_truth(footprints: DataFrame, traces: DataFrame, height: int, lo: int, hi: tuple[int, int], least: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Known footprints cropped to [lo, hi] along both axes and brought to unit norm, traces scaled by the norms."""
    d1, d2 = F.col("px") % height, F.floor(F.col("px") / height)
    inside = footprints.where(d1.between(lo, hi[0]) & d2.between(lo, hi[1]))
    new = (d1 - lo + (d2 - lo) * (hi[0] - lo + 1)).cast("int")
    norms = inside.groupBy("cell").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = inside.join(norms, "cell").select("cell", new.alias("px"), F.try_divide("w", "norm").alias("w")).where(F.col("w") >= least)
    return unit, traces.join(norms, "cell").withColumn("c", F.col("c") * F.col("norm")).drop("norm")
