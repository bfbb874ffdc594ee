"""Sums of frames times traces at the places of a mask."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.functions.lineage import saved_in_buckets
from fovea.operators import products
from fovea.sources import movies


def made(spark, dense, frames=11, side=8, cells=5):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(frames, side * side)).astype(np.float32).astype(float)
    c = rng.random((frames, cells))
    mask = rng.random((cells, side * side)) < 0.2
    if not dense:
        y[rng.random(y.shape) < 0.5] = 0
    if dense:
        packed = spark.createDataFrame([(1, t + 1, [float(v) for v in y[t]]) for t in range(frames)], movies.PACKED)
        movie = movies.Movie(movies.exploded(packed), side, side, packed)
    else:
        movie = movies.Movie(spark.createDataFrame([(1, t + 1, p, float(y[t, p])) for t in range(frames) for p in np.flatnonzero(y[t]).tolist()], movies.LONG), side, side)
    traces = spark.createDataFrame([(t + 1, k + 1, float(c[t, k])) for t in range(frames) for k in range(cells)], "frame long, cell int, c double")
    places = spark.createDataFrame([(int(k) + 1, int(p)) for k, p in np.argwhere(mask)], "cell int, px int")
    return movie, traces, places, {(int(p), int(k) + 1): float(y[:, p] @ c[:, k]) for k, p in np.argwhere(mask)}


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("limits", [(1024, 1 << 21, 1 << 22, 1 << 21), (4, 6, 16, 30), (64, 3, 64, 1)])
def test_masked_sums(spark, monkeypatch, dense, limits):
    """Whole and sparse movies; tiles, strips and blocks of any size, also a tile that is cut by cells."""
    for name, value in zip(("TILE", "STRIP_ENTRIES", "STRIP_PIXELS", "BLOCK"), limits, strict=True):
        monkeypatch.setattr(products, name, value)
    movie, traces, places, want = made(spark, dense)
    got = products.project_footprints_masked(movies.frame_arrays(movie), traces, places.union(places)).collect()
    assert len(got) == len(want) and all(r["yc"] == pytest.approx(want[r["px"], r["cell"]], abs=1e-9) for r in got)


def test_without_places_or_frames(spark):
    movie, traces, places, want = made(spark, True)
    assert products.project_footprints_masked(movies.frame_arrays(movie), traces, places.limit(0)).collect() == []
    assert products.project_footprints_masked(movies.frame_arrays(movie).limit(0), traces, places).collect() == []


def test_a_movie_in_buckets_is_not_moved(spark, monkeypatch):
    """The join with the traces deals the traces only; and a task gives no more rows than the mask has."""
    movie, traces, places, want = made(spark, True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = saved_in_buckets(movies.frame_arrays(movie), "movie", "frame")
        assert sorted((r["frame"], r["px"], round(r["value"], 6)) for r in movies.long_rows(frames).collect()) == sorted((r["frame"], r["px"], round(r["value"], 6)) for r in movie.rows.collect())
        met = frames.join(traces.groupBy("frame").agg(F.collect_list("c").alias("cs")), "frame")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(frame") == 1
        got = products.project_footprints_masked(frames, traces, places).collect()
        assert {(r["px"], r["cell"]): r["yc"] for r in got} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
