"""Every query of the movie engine: with an oracle, its rows; without, its values against plain loops or what must hold."""

import numpy as np
import pytest
from helpers import DATA, oracle, same_rows
from test_motion import plain_pyramid

from fovea.operators import motion
from fovea.plans import catalog
from fovea.plans.analysis_queries import noisy_traces
from fovea.plans.model_queries import event_model, trace_inputs
from fovea.sources import movies

@pytest.fixture(scope="module")
def con():
    return oracle()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    same_rows(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLES[name])


def rows_of(spark, name):
    return catalog.QUERIES[name](spark, DATA).collect()


def plain_pools(y, gamma, lam):
    """Deconvolution written out: pools [value, weight, length], joined from the right."""
    pools = []
    for t in range(len(y)):
        pools.append([y[t] - (lam if t == len(y) - 1 else lam * (1 - gamma)), 1.0, 1])
        while len(pools) > 1 and pools[-1][0] < gamma ** pools[-2][2] * pools[-2][0]:
            (v0, w0, n0), (v1, w1, n1) = pools[-2:]
            d = gamma**n0
            pools[-2:] = [[(w0 * v0 + d * w1 * v1) / (w0 + d * d * w1), w0 + d * d + w1, n0 + n1]]
    c = [max(v, 0) * gamma**k for v, _, n in pools for k in range(n)]
    s, at = [0.0] * len(c), 0
    for _, _, n in pools:
        if at:
            s[at] = c[at] - gamma * c[at - 1]
        at += n
    return np.array(c), np.array(s)


def test_grid_of_parameters(spark):
    """Each row of both sweeps from a plain loop over the traces."""
    traces = {r["cell"]: r for r in noisy_traces(spark, DATA).collect()}
    for name in ("lambda_sweep", "gamma_lambda_grid"):
        rows = rows_of(spark, name)
        assert len(rows) == 4 * {"lambda_sweep": 21, "gamma_lambda_grid": 28}[name]
        for r in rows[::7]:
            y, c0, s0 = (np.array(traces[r["cell"]][k]) for k in ("y", "c", "s"))
            c, s = plain_pools(y.tolist(), r["gamma"], r["lambda"])
            d = c - y
            assert r["sse"] == pytest.approx(sum(x * x for x in d), abs=1e-3) and r["error"] == pytest.approx(sum((c - c0) ** 2), abs=1e-3)
            z = d - d.mean()
            assert r["kurtosis"] == pytest.approx((z**4).mean() / (z**2).mean() ** 2, abs=1e-3)
            if c.std() and s.std():
                assert r["corr_c"] == pytest.approx(np.corrcoef(c, c0)[0, 1], abs=1e-3) and r["corr_s"] == pytest.approx(np.corrcoef(s, s0)[0, 1], abs=1e-3)


def test_ordered_sweep_with_deconvolution(spark):
    """One pass over all cells in order, from the projections and overlaps."""
    m = event_model(spark, DATA)
    x = {(r["cell"], r["frame"]): r["x"] for r in trace_inputs(m).collect()}
    feet = {}
    for r in m.footprints.collect():
        feet.setdefault(r["cell"], {})[r["px"]] = r["w"]
    done = {}
    for j in sorted(feet):
        y = np.array([x[j, t] for t in range(1, 721)])
        for k, (c, _) in done.items():
            y = y - sum(w * feet[j].get(p, 0) for p, w in feet[k].items()) * c
        done[j] = plain_pools(y.tolist(), 0.8, 2.0)
    for r in rows_of(spark, "hals_traces_oasis"):
        c, s = done[r["cell"]]
        assert r["c"] == pytest.approx(c[r["frame"] - 1], abs=1e-5) and r["s"] == pytest.approx(s[r["frame"] - 1], abs=1e-5)


def test_fitted_parameters(spark):
    rows = rows_of(spark, "oasis_opt")
    assert len(rows) == 9 and all(0.3 <= r["gamma"] <= 0.9999 and r["lambda"] >= 0 for r in rows)
    assert all(r["after"] <= r["before"] + 1e-6 for r in rows)


@pytest.mark.parametrize("name", ["segment_unionfind", "init_footprints"])
def test_regions_are_disjoint_connected_and_of_unit_norm(spark, name):
    cells = {}
    for r in rows_of(spark, name):
        row = r.asDict()
        cells.setdefault((row.get("image", 1), row["cell"]), {})[row["px"]] = row["w"]
    assert cells
    for (image, cell), w in cells.items():
        assert sum(v * v for v in w.values()) == pytest.approx(1, abs=1e-4) and all(v > 0 for v in w.values())
        assert all(not set(w) & set(other) for (i, k), other in cells.items() if i == image and k != cell)
        assert name == "segment_unionfind" or len(w) >= 3


def plain_displacement(image, target):
    """Best circular shift by trying all; the greatest absolute sum, first in column-major order."""
    best = None
    for b in range(image.shape[1]):
        for a in range(image.shape[0]):
            value = abs(float((image * np.roll(target, (a, b), (0, 1))).sum()))
            if best is None or value > best[0] * (1 + 1e-9):
                best = (value, a, b)
    return best[1:]


def test_displacements():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.normal(size=(8, 8)), rng.normal(size=(8, 8))
        d1, d2, _ = motion.displacement(a, b)
        assert (d1 % 8, d2 % 8) == plain_displacement(a, b)


@pytest.mark.parametrize(("name", "keys"), [("register_pyramid", ("video_id", "seg")), ("register_video", ("video_id",))])
def test_pyramid_queries(spark, name, keys):
    """Every shift of both queries from rounds over all frames of a group at once."""
    frames = {r["frame"]: np.array(r["pixels"], float).reshape(8, 8, order="F") for r in movies.embedding_movie(spark, DATA).packed.collect()}
    rows, groups = rows_of(spark, name), {}
    assert sorted(r["frame"] for r in rows) == sorted(frames)
    for r in sorted(rows, key=lambda r: r["frame"]):
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    for own in groups.values():
        for r, want in zip(own, plain_pyramid([frames[r["frame"]] for r in own]), strict=True):
            assert (r["s1"], r["s2"]) == want[:2] and abs(r["phase"]) == pytest.approx(abs(want[2]), abs=1e-3)


def test_every_query_is_tested():
    tested = {"oasis_opt", "register_pyramid", "register_video"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == tested | {"pipeline_e2e"}  # the last one in test_session
