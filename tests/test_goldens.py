"""Values worked out by hand, and properties of the numeric helpers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fovea.functions import deconvolution, regions
from fovea.operators import folds, merging, products, sweeps, views
from fovea.sources import movies


def long(spark, frames, video=1):
    rows = [(video, t, p, float(v)) for t, frame in enumerate(frames, 1) for p, v in enumerate(frame)]
    return spark.createDataFrame(rows, movies.LONG)


def test_split(spark):
    ranges = movies.segment_ranges(spark.createDataFrame([(6,)], "n long"), 4).orderBy("seg").collect()
    assert [(r["lo"], r["hi"]) for r in ranges] == [(1, 2), (3, 4), (5, 6), (7, 6)]


def test_negentropy_forms(spark):
    rows = long(spark, [[0], [0], [0], [4]])
    assert folds.negentropy(rows).first()["v"] == pytest.approx(0.0972222, abs=1e-6)
    assert folds.negentropy_no_mean(rows).first()["v"] == pytest.approx(0.4166667, abs=1e-6)
    assert deconvolution.negentropy(np.array([0, 0, 0, 4.0])) == pytest.approx(0.1203704, abs=1e-6)
    assert folds.negentropy(long(spark, [[2], [2]])).first()["v"] is None


@pytest.mark.parametrize(
    ("y", "lam", "rule", "c", "s"),
    [
        ([4, 1, 2], 0, "undamped", [3.6, 1.8, 2], [0, 0, 1.1]),
        ([4, 1, 2], 0, "published", [3.6, 1.8, 2], [0, 0, 1.1]),
        ([4, 1, 2], 1, "undamped", [3, 1.5, 1], [0, 0, 0.25]),
        ([4, 1, 0], 0, "undamped", [3.502703, 1.751351, 0.875676], [0, 0, 0]),
        ([4, 1, 0], 0, "published", [3.428571, 1.714286, 0.857143], [0, 0, 0]),
    ],
)
def test_oasis(y, lam, rule, c, s):
    got = deconvolution.oasis(np.array(y, float), 0.5, lam, rule)
    assert np.allclose(got[0], c, atol=1e-6) and np.allclose(got[1], s, atol=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=40), st.floats(0.3, 0.99), st.floats(0, 3), st.sampled_from(["undamped", "published"]))
def test_oasis_properties(y, gamma, lam, rule):
    c, _ = deconvolution.oasis(np.array(y), gamma, lam, rule)
    assert (c >= 0).all() and (c[1:] >= gamma * c[:-1] - 1e-9).all()


def test_oasis_empty_and_fit():
    assert len(deconvolution.oasis(np.zeros(0), 0.9, 1.0)[0]) == 0
    rng = np.random.default_rng(0)
    y = deconvolution.oasis(rng.normal(size=300) + 3 * (rng.random(300) < 0.05), 0.8, 0.2)[0] + rng.normal(size=300)
    before = deconvolution.negentropy(deconvolution.oasis(y, 0.8, 2.0)[0] - y)
    c, _, gamma, lam = deconvolution.fitted(y, 0.8, 2.0)
    assert 0.3 <= gamma <= 0.9999 and lam >= 0
    assert deconvolution.negentropy(c - y) <= before + 1e-9
    assert deconvolution.noise_sigma(rng.normal(size=20000)) == pytest.approx(1.0, abs=0.05)


def test_chi2_tail():
    assert regions.log_chi2_tail(3.841459, 1) == pytest.approx(math.log(0.05), abs=1e-5)
    assert regions.log_chi2_tail(18.307038, 10) == pytest.approx(math.log(0.05), abs=1e-5)
    assert regions.log_chi2_tail(2 * 60, 2) == pytest.approx(-60, abs=1e-9)
    assert regions.log_chi2_tail(0, 4) == 0


def test_regions():
    image = np.full(100, 0.1)
    image[[44, 45, 54, 55, 56]] = [5, 4, 4, 3, 2]
    label = regions.flood_labels(image, 10, 10, 3)
    assert len(set(label[[44, 45, 54, 55, 56]])) == 1
    cells = regions.peak_regions(image, 10, 10, 1.0)
    assert len(cells) == 1 and {44, 45, 54, 55, 56} <= set(cells[0])
    assert sum(w * w for w in cells[0].values()) == pytest.approx(1)
    assert regions.flood_labels(np.full(9, np.nan), 3, 3, 2).tolist() == [0] * 9


def test_trace_sweep_golden(spark):
    feet = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.6), (2, 1, 0.8)], "cell int, px int, w double")
    rows = long(spark, [[2, 1]])
    ay = products.project_traces(rows, feet)
    first = ay.select("frame", "cell", F.col("r").alias("x"), F.lit(0.0).alias("c"))
    got = {r["cell"]: r["c"] for r in sweeps.unpacked(sweeps.trace_sweep(first, feet)).collect()}
    assert got == {1: pytest.approx(2), 2: pytest.approx(0.8)}
    again = ay.join(spark.createDataFrame(list(got.items()), "cell int, c double"), "cell").select("frame", "cell", F.col("r").alias("x"), "c")
    got = {r["cell"]: r["c"] for r in sweeps.unpacked(sweeps.trace_sweep(again, feet)).collect()}
    assert got == {1: pytest.approx(1.52), 2: pytest.approx(1.088)}


def test_footprint_sweep_golden(spark):
    feet = spark.createDataFrame([(1, 1, 1.0)], "cell int, px int, w double")
    traces = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0)], "frame long, cell int, c double")
    rows = long(spark, [[1, 2, 0], [1, 4, -2]])
    sums = products.project_footprints(rows, traces).withColumnRenamed("yc", "v")
    got = {r["px"]: r["w"] for r in sweeps.footprint_sweep(sums, feet, traces, 3, 1).collect()}
    assert got == {0: pytest.approx(0.316228, abs=1e-6), 1: pytest.approx(0.948683, abs=1e-6)}


def test_mask_stays_inside(spark):
    feet = spark.createDataFrame([(1, 0, 1.0)], "cell int, px int, w double")
    assert {r["px"] for r in sweeps.dilated(feet, 3, 3).collect()} == {0, 1, 3, 4}


def test_merge_is_a_star(spark):
    feet = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.6), (2, 1, 0.8), (3, 1, 1.0)], "cell int, px int, w double")
    traces = spark.createDataFrame([(t, k, float(k * t)) for k in (1, 2, 3) for t in (1, 2, 3)], "frame long, cell int, c double")
    new, joint, _ = merging.merge(feet, traces, ("c",), 0.6)
    got = {(r["cell"], r["px"]): r["w"] for r in new.collect()}
    assert got == {(1, 0): pytest.approx(0.894427, abs=1e-6), (1, 1): pytest.approx(0.447214, abs=1e-6), (3, 1): pytest.approx(1)}
    assert sorted((r["cell"], r["frame"], r["c"]) for r in joint.collect())[:3] == [(1, 1, 3), (1, 2, 6), (1, 3, 9)]


def test_groups_equal_one_ordered_pass(spark):
    """The sweep by groups of overlapping cells is that over all cells in order."""
    rng = np.random.default_rng(3)
    n, pixels, frames = 12, 40, 6
    a = np.zeros((n, pixels))
    for k in range(n):
        at = rng.integers(0, pixels - 4)
        a[k, at : at + 4] = rng.random(4) + 0.1
        a[k] /= np.linalg.norm(a[k])
    y = rng.normal(size=(pixels, frames)) * 3
    c = np.zeros((n, frames))
    for k in range(n):
        c[k] = np.maximum(a[k] @ y - (a @ a[k]) @ c + c[k], 0)
    feet = spark.createDataFrame([(k + 1, int(p), float(a[k, p])) for k in range(n) for p in np.flatnonzero(a[k])], "cell int, px int, w double")
    rows = long(spark, y.T.tolist())
    values = products.project_traces(rows, feet).select("frame", "cell", F.col("r").alias("x"), F.lit(0.0).alias("c"))
    got = sweeps.unpacked(sweeps.trace_sweep(values, feet, frames_per_task=2)).collect()
    assert len(got) == n * frames
    assert all(r["c"] == pytest.approx(c[r["cell"] - 1, r["frame"] - 1], abs=1e-9) for r in got)


def test_different_frame_sizes_fail(spark):
    boxes = spark.createDataFrame([("a", 1, 2, 1, 2), ("b", 1, 3, 1, 2)], movies.ALIGNMENT)
    rows = long(spark, [[1, 2, 3, 4]]).withColumn("filename", F.lit("a"))
    with pytest.raises(Exception, match="frame sizes differ"):
        movies.aligned(rows, boxes, 2).collect()


def test_colours_and_rows(spark):
    cells = spark.range(1, 8).select(F.col("id").cast("int").alias("cell"))
    named = views.distinct_colours(cells).collect()
    assert len({r["color"] for r in named}) == 7 and all(len(r["color"]) == 6 for r in named)
    mixed = views.random_colours(cells).collect()
    assert all(r["red"] + r["green"] + r["blue"] <= 2 + 1e-9 and max(r["red"], r["green"], r["blue"]) <= 1 for r in mixed)
    image = spark.createDataFrame([(0, 1.0), (1, 2.0), (5, 3.0)], "px int, v double")
    assert {r["d1"]: list(r["row"]) for r in views.image_rows(image, 2, 3).collect()} == {0: [1.0, None, None], 1: [2.0, None, 3.0]}


def test_two_keys_fail(spark):
    with pytest.raises(Exception, match="expected one dataset"):
        movies.single_key(spark.createDataFrame([("a",), ("b",)], "key string")).collect()


def test_open_movie(spark, tmp_path):
    frames = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [3.0, 4.0])], movies.PACKED)
    frames.write.parquet(str(tmp_path / "m.parquet"))
    movie = movies.open_movie(spark, str(tmp_path / "m.parquet"), 2, 1)
    assert movie.rows.agg(F.sum("value")).first()[0] == 10
    assert movies.open_movie(spark, "movie.tif", 2, 1).rows.isEmpty()
    with pytest.raises(FileNotFoundError):
        movies.open_movie(spark, "missing.parquet", 2, 1)
    with pytest.raises((RuntimeError, FileNotFoundError)):
        movies.open_movie(spark, "missing.nwb", 2, 1)
