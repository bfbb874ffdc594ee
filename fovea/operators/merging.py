"""Merging of cells that overlap and whose traces agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.functions.lineage import saved
from fovea.operators.components import with_component
from fovea.operators.products import footprint_gram, trace_correlation

THRESHOLD = 0.8


def candidates(footprints: DataFrame, traces: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(i, j, overlap, corr) with i < j, overlapping and correlated above the threshold; only traces of cells that overlap are joined."""
    overlap = saved(footprint_gram(footprints).where("i < j AND g > 0").withColumnRenamed("g", "overlap"), "overlaps")
    return overlap.join(trace_correlation(traces, pairs=overlap), ["i", "j"]).where(F.col("corr").isNotNull() & (F.col("corr") > threshold))


def assign(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell, head): in order, a free cell takes all its free later candidates; a star, not a chain."""
    grouped = with_component(pairs.select(F.col("i").alias("cell")).distinct(), pairs.select("i", "j"))
    edges = pairs.select("i", "j").join(grouped.withColumnRenamed("cell", "i"), "i")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head: dict[int, int] = {}
        for i, j in sorted(zip(rows["i"], rows["j"], strict=True)):
            if head.get(i, i) == i and j not in head:
                head[i], head[j] = i, i
        return pd.DataFrame({"cell": list(head), "head": list(head.values())}, dtype="int32")

    heads = edges.groupBy("component").applyInPandas(run, "cell int, head int")
    return cells.select("cell").distinct().join(heads, "cell", "left").select("cell", F.coalesce("head", "cell").alias("head"))


def merged_footprints(footprints: DataFrame, heads: DataFrame) -> DataFrame:
    """Footprints added in order of cells, brought to unit norm after each addition."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pixels = np.unique(rows["px"])
        total = np.zeros(len(pixels))
        for k, (_, one) in enumerate(rows.sort_values("cell").groupby("cell")):
            total[np.searchsorted(pixels, one["px"])] += one["w"].to_numpy()
            if k:
                total /= np.sqrt((total * total).sum()) + 1e-10
        return pd.DataFrame({"cell": rows["head"].iloc[0], "px": pixels, "w": total})

    return footprints.join(heads, "cell").groupBy("head").applyInPandas(run, "cell int, px int, w double")


def merged_traces(traces: DataFrame, heads: DataFrame, *names: str) -> DataFrame:
    keys = [c for c in ("video_id", "frame") if c in traces.columns]
    return traces.join(heads, "cell").groupBy(*keys, F.col("head").alias("cell")).agg(*(F.sum(n).alias(n) for n in names))


def merge(footprints: DataFrame, traces: DataFrame, names: tuple[str, ...] = ("c",), threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(footprints, traces, heads) after one pass; overlaps and correlations are not refreshed within it."""
    heads = saved(assign(footprints, candidates(footprints, traces, threshold)), "heads")
    return merged_footprints(footprints, heads), merged_traces(traces, heads, *names), heads
