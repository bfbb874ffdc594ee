"""Passes over cells by levels against plain passes over all cells in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.functions import deconvolution
from fovea.operators import components, products, sweeps


def field(rng, n, side, size=3):
    """Square footprints of unit norm at random places of a small frame: one component."""
    a = np.zeros((n, side * side))
    for k in range(n):
        y, x = rng.integers(0, side - size + 1, 2)
        for i in range(size):
            for j in range(size):
                a[k, (y + i) + (x + j) * side] = rng.random() + 0.1
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def table(spark, a, name="w"):
    rows = [(int(k) + 1, int(p), float(a[k, p])) for k, p in np.argwhere(a != 0)]
    return spark.createDataFrame(rows, f"cell int, px int, {name} double")


def stand_in():
    """For a deconvolution: reads the whole trace (a closure, so that workers need not import the tests)."""

    def halved(r, gamma, lam):
        return np.maximum(r, 0) / 2 + r.mean(), r - 1, gamma, lam

    return halved


def plain_traces(a, y, c, deconvolve):
    c, r = c.copy(), np.zeros_like(c)
    for k in range(len(a)):
        r[k] = a[k] @ y - (a @ a[k]) @ c + c[k]
        c[k] = deconvolve(r[k], 0.8, 50.0)[0]
    return r, c


@pytest.mark.parametrize(("deconvolve", "together"), [(stand_in(), 0), (stand_in(), 1 << 22), (sweeps.zero_clamp, 0)])
def test_traces_of_one_component(spark, monkeypatch, deconvolve, together):
    monkeypatch.setattr(sweeps, "TOGETHER", together)
    rng = np.random.default_rng(1)
    a, frames = field(rng, 14, 6), 9
    y, old = rng.normal(size=(36, frames)), rng.random((14, frames))
    feet = table(spark, a)
    assert components.connected_components(products.footprint_gram(feet).where("i != j AND g != 0").select("i", "j")).select("root").distinct().count() == 1
    values = spark.createDataFrame([(t + 1, k + 1, float(a[k] @ y[:, t]), float(old[k, t])) for k in range(14) for t in range(frames)], "frame long, cell int, x double, c double")
    packed = sweeps.trace_sweep(values, feet, deconvolve, frames_per_task=4)
    r, c = plain_traces(a, y, old, deconvolve)
    got = sweeps.unpacked(packed).collect()
    assert len(got) == c.size
    for row in got:
        assert row["c"] == pytest.approx(c[row["cell"] - 1, row["frame"] - 1], abs=1e-9) and row["r"] == pytest.approx(r[row["cell"] - 1, row["frame"] - 1], abs=1e-9)


def test_a_level_is_many_tasks(spark, monkeypatch):
    """A comb: one long cell overlaps all teeth, so there is one component; the teeth are updated side by side."""
    monkeypatch.setattr(sweeps, "TOGETHER", 0)
    a = np.zeros((9, 16))
    a[0, :] = 0.25
    for k in range(8):
        a[k + 1, 2 * k] = 1.0
    feet = table(spark, a)
    values = spark.createDataFrame([(t, k, float(k + t), 0.0) for k in range(1, 10) for t in (1, 2)], "frame long, cell int, x double, c double")
    tasks = sweeps.trace_sweep(values, feet, stand_in(), frames_per_task=None).where("cell > 1").select(F.input_file_name().alias("f")).distinct()
    assert tasks.count() > 1


def test_frames_that_others_lack_count_as_zero(spark):
    rows = spark.createDataFrame([(1, [1, 2, 4], [1.0, 2.0, 4.0], 0.8, 50.0), (2, [3], [3.0], 0.8, 50.0)], "cell int, frames array<long>, r array<double>, gamma double, `lambda` double")
    others = spark.createDataFrame([(1, 0.5, [2, 3, 4], [10.0, 20.0, 30.0])] + [(1, 1.0, [1], [0.01])] * 50, "cell int, g double, frames array<long>, c array<double>")
    import pandas as pd

    out = sweeps.less_others(rows, others, lambda cell, f, r, g, x: pd.DataFrame({"cell": [cell], "r": [r]}), "cell int, r array<double>").collect()
    got = {r["cell"]: r["r"] for r in out}
    assert got[1] == pytest.approx([0.5, -3.0, -11.0]) and got[2] == [3.0]


@pytest.mark.parametrize(("together", "side"), [(0, 7), (1 << 22, 7), (150, 16)])
def test_footprints_in_order(spark, monkeypatch, together, side):
    """One component by levels and in a task; several, of which the smaller ones are a task each and the others go by levels."""
    monkeypatch.setattr(sweeps, "TOGETHER", together)
    rng = np.random.default_rng(2)
    n, frames = 10, 12
    a, y, c = field(rng, n, side), rng.normal(size=(side * side, frames)) + 1, rng.random((n, frames))
    mask = np.zeros_like(a, bool)
    for k, p in np.argwhere(a > 0):
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if 0 <= p % side + i < side and 0 <= p // side + j < side:
                    mask[k, p + i + j * side] = True
    want, cc, yc = a.copy(), c @ c.T, y @ c.T
    for k in range(n):
        new = np.maximum(yc[:, k] - cc[k] @ want + want[k] * cc[k, k], 0) * mask[k]
        want[k] = new / (np.linalg.norm(new) + 1e-10)
    sums = spark.createDataFrame([(p, k + 1, float(yc[p, k])) for p in range(side * side) for k in range(n)], "px int, cell int, v double")
    traces = spark.createDataFrame([(t + 1, k + 1, float(c[k, t])) for k in range(n) for t in range(frames)], "frame long, cell int, c double")
    got = np.zeros_like(a)
    for r in sweeps.footprint_sweep(sums, table(spark, a), traces, side, side).collect():
        got[r["cell"] - 1, r["px"]] = r["w"]
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("few", [0, 1000])
def test_levels(spark, monkeypatch, few):
    """By rounds and at once: the longest way from a cell without predecessors."""
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = np.random.default_rng(5)
    links = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(1, 15, (25, 2)) if a != b})
    want = {k: 0 for k in range(1, 18)}
    for j in range(1, 18):
        want[j] = max((want[i] + 1 for i, k in links if k == j), default=0)
    cells = spark.createDataFrame([(k,) for k in range(1, 18)], "cell int")
    got = components.dependency_levels(cells, spark.createDataFrame(links, "i int, j int")).collect()
    assert {r["cell"]: r["level"] for r in got} == want and len(got) == 17
    none = components.dependency_levels(cells, spark.createDataFrame([], "i int, j int")).collect()
    assert {r["level"] for r in none} == {0} and len(none) == 17


def test_products_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(products, "RUN", 3)
    rng = np.random.default_rng(6)
    traces = spark.createDataFrame([(t, k, float(rng.normal())) for k in range(1, 6) for t in range(1, 11) if (t + k) % 4], "frame long, cell int, c double")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 5), (3, 4), (1, 9)], "i int, j int")
    every = {(r["i"], r["j"]): r["g"] for r in products.trace_gram(traces).collect()}
    got = {(r["i"], r["j"]): r["g"] for r in products.pair_products(traces, pairs).collect()}
    assert set(got) == {(1, 2), (2, 5), (3, 4)} and all(g == pytest.approx(every[k], abs=1e-12) for k, g in got.items())


def test_pools_stay_within_videos(spark):
    """With the videos' first frames each part is deconvolved by itself; without, pools may cross."""
    rng = np.random.default_rng(8)
    y = np.concatenate([np.abs(rng.normal(size=6)) + 5, rng.normal(size=5) - 4, np.abs(rng.normal(size=7)) + 3])
    feet = spark.createDataFrame([(1, 0, 1.0)], "cell int, px int, w double")
    values = spark.createDataFrame([(k + 1, 1, float(v), 0.0) for k, v in enumerate(y)], "frame long, cell int, x double, c double")
    cells = spark.createDataFrame([(1, 0.9, 0.5)], "cell int, gamma double, `lambda` double")

    def run(starts):
        rows = sweeps.unpacked(sweeps.trace_sweep(values, feet, sweeps.oasis_fixed, cells, None, starts)).orderBy("frame").collect()
        return np.array([r["c"] for r in rows]), np.array([r["s"] for r in rows])

    whole = deconvolution.oasis(y, 0.9, 0.5)
    parts = [deconvolution.oasis(p, 0.9, 0.5) for p in (y[:6], y[6:11], y[11:])]
    assert run(None)[0] == pytest.approx(whole[0])
    c, s = run([7, 1, 12])
    assert c == pytest.approx(np.concatenate([p[0] for p in parts])) and s == pytest.approx(np.concatenate([p[1] for p in parts]))
    assert not np.allclose(c, whole[0])
