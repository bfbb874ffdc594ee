"""Regions against plain passes over all seeds or all pixels."""

from collections import deque

import numpy as np
import pytest

from fovea.functions import regions
from fovea.operators import folds, segmentation
from fovea.sources import movies


def beside(p, h, w):
    return [p + a + b * h for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)) if 0 <= p % h + a < h and 0 <= p // h + b < w]


def plain_growth(y, h, w, least):
    """One pass over all pixels by falling peak-to-noise ratio, on frames by pixels; NaN is no value."""
    mean, sd = np.nanmean(y, axis=0), np.nanstd(y, axis=0)
    ratio, peak = (np.nanmax(y, axis=0) - mean) / sd, np.nanargmax(y, axis=0)
    taken, out = np.zeros(h * w, bool), []
    for seed in sorted(range(h * w), key=lambda p: (-ratio[p], p)):
        if taken[seed]:
            continue
        z = np.nan_to_num((y[peak[seed]] - mean) / sd)
        taken[seed], todo, region = True, deque([seed]), [seed]
        while todo:
            for q in beside(todo.popleft(), h, w):
                if not taken[q] and z[q] > -z.min():
                    taken[q] = True
                    region.append(q)
                    todo.append(q)
        weights = {p: z[p] for p in region if z[p] != 0}
        if len(weights) > least:
            out.append(weights)
    return out


@pytest.mark.parametrize("case", ["spots", "noise", "sparse", "flash"])
def test_growth_is_one_pass_over_all_seeds(spark, case):
    """Spots that overlap and flicker, plain noise, missing pixels, and a frame in which most pixels peak."""
    rng = np.random.default_rng(11)
    h, w, t, least = 9, 8, 30, 0 if case == "noise" else 1
    y = 0.3 * rng.normal(size=(t, h * w))
    if case != "noise":
        for _ in range(7):
            a, b = rng.integers(0, h), rng.integers(0, w)
            d = (np.arange(h * w) % h - a) ** 2 + (np.arange(h * w) // h - b) ** 2
            y += np.outer(3 * rng.random(t) ** 4, np.exp(-d / 4))
    if case == "sparse":
        y[rng.random(y.shape) < 0.2] = np.nan
    if case == "flash":
        y[4] += 5 * (rng.random(h * w) < 0.8)
    rows = spark.createDataFrame([(1, k + 1, p, float(y[k, p])) for k in range(t) for p in range(h * w) if not np.isnan(y[k, p])], movies.LONG)
    stats = [(p, float((np.nanmax(y[:, p]) - np.nanmean(y[:, p])) / np.nanstd(y[:, p]))) for p in range(h * w)]
    got = {}
    for r in segmentation.grow_from_peaks(spark.createDataFrame(stats, "px int, pnr double"), folds.peak_frame(rows), rows, h, w, least).collect():
        got.setdefault(r["cell"], {})[r["px"]] = r["w"]
    want = plain_growth(y, h, w, least)
    assert len(got) == len(want) and len(want) > 1
    for k, cell in enumerate(want, 1):
        assert got[k].keys() == cell.keys() and all(got[k][p] == pytest.approx(v, abs=1e-9) for p, v in cell.items())


def test_growth_of_nothing(spark):
    none = spark.createDataFrame([], movies.LONG)
    assert segmentation.grow_from_peaks(spark.createDataFrame([], "px int, pnr double"), folds.peak_frame(none), none, 4, 4).collect() == []


def plain_flood(image, h, w, min_size):
    """Cluster of each pixel as sets that are joined, by falling value."""
    of, members = {}, {}
    for p in sorted((p for p in range(h * w) if not np.isnan(image[p])), key=lambda p: (-image[p], p)):
        near = [of[q] for q in beside(p, h, w) if q in of]
        if not near:
            of[p], members[p] = p, {p}
            continue
        best = max(near, key=lambda k: len(members[k]))  # the first of the largest
        of[p] = best
        members[best].add(p)
        for k in dict.fromkeys(near):
            if k != best and len(members[k]) < min_size:
                for q in members[k]:
                    of[q] = best
                members[best] |= members.pop(k)
    return {p: k for p, k in of.items() if len(members[k]) >= min_size}


def plain_unionfind(image, h, w, min_size, sens, min_n):
    of = plain_flood(image, h, w, min_size)
    groups = {}
    for p in range(h * w):
        if not np.isnan(image[p]):
            groups.setdefault(of.get(p), []).append(p)
    pool, out = [], []
    # the pixels of no cluster are one group too
    for _, own in sorted(groups.items(), key=lambda g: np.mean(image[g[1]] ** 2)):
        v = image[own]
        if len(pool) > min_n:
            x = (((v - np.mean(pool)) / np.std(pool)) ** 2).sum()
            if regions.log_chi2_tail(float(x), len(own)) < -sens:
                w_ = np.maximum(v, 0)
                out.append({p: a / np.linalg.norm(w_) for p, a in zip(own, w_, strict=True) if a > 0})
                continue
        pool += v.tolist()
    return out


@pytest.mark.parametrize(("seed", "tile"), [*((k, segmentation.TILE) for k in range(6)), (0, 4), (1, 3), (2, 9), (3, 1)])
def test_unionfind_is_the_plain_pass(spark, seed, tile):
    """With ties and missing pixels, as a whole and by tiles."""
    rng = np.random.default_rng(seed)
    h, w = 17, 13
    image = np.round(rng.normal(size=h * w), 1 + seed % 2)  # with ties
    for _ in range(5):
        a, b = rng.integers(0, h), rng.integers(0, w)
        image += 4 * np.exp(-((np.arange(h * w) % h - a) ** 2 + (np.arange(h * w) // h - b) ** 2) / 5)
    if seed % 3 == 0:
        image[rng.random(h * w) < 0.1] = np.nan
    want = plain_unionfind(image, h, w, 4, 3.0, 30)
    frame = spark.createDataFrame([(7, p, float(v)) for p, v in enumerate(image) if not np.isnan(v)], "image int, px int, v double")
    got = {}
    for r in segmentation.unionfind(frame, h, w, 4, 3.0, 30, tile=tile).collect():
        got.setdefault(r["cell"], {})[r["px"]] = r["w"]
    assert len(want) > 0 and len(got) == len(want)
    for k, cell in enumerate(want, 1):
        assert got[k].keys() == cell.keys() and all(got[k][p] == pytest.approx(v, abs=1e-9) for p, v in cell.items())


@pytest.mark.parametrize("case", range(8))
def test_tiles_settle_what_one_pass_does(case):
    """A flood cut into two rounds of tiles: clusters, sizes and parts go on from the first to the second."""
    rng = np.random.default_rng(case)
    h, w, least = 12, 10, 1 + case % 4
    image = np.round(rng.normal(size=h * w), 1)
    values = dict(enumerate(image.tolist()))
    half = lambda p: p // h < w // 2
    known, size, pixels, first, now = {}, {}, {}, {}, {}
    for side in (True, False):
        own = {p: v for p, v in values.items() if half(p) == side}
        ring = {p: v for p, v in values.items() if half(p) != side and any(half(q) == side for q in regions.neighbours(p, h, w))}
        label, part, left, sizes, _ = regions.flood_tile(own, {}, {}, ring, h, w, least)
        assert len(label) + len(left) == len(own) and label and left
        first |= label
        known |= {p: (label[p], part[p]) for p in label}
        size |= {k: sizes[k] for k in set(label.values())}
        pixels |= {p: values[p] for p in left}
    label, _, left, _, now = regions.flood_tile(pixels, known, size, {}, h, w, least)
    assert not left and all(label[p] == now[k] for p, k in first.items())
    want = regions.flood_labels(image, h, w, least)
    pairs = {(a, b) for a, b in zip(want.tolist(), (label[p] for p in range(h * w)), strict=True) if a}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1


def test_tiles_of_nothing(spark):
    none = spark.createDataFrame([], "image int, px int, v double")
    assert segmentation.unionfind(none, 9, 9, 2, 1.0, 5, tile=4).collect() == []


def test_pixels_without_a_value_first():
    """They make clusters that grow over their neighbours, and these are never cells; left out, they don't."""
    rng = np.random.default_rng(4)
    h = w = 15
    image = rng.normal(size=h * w)
    image += 6 * np.exp(-((np.arange(h * w) % h - 4) ** 2 + (np.arange(h * w) // h - 4) ** 2) / 6)
    image[[9 + 9 * h, 10 + 9 * h]] = np.nan
    label = regions.flood_labels(image, h, w, 3, nan_first=True)
    assert label[9 + 9 * h] == label[10 + 9 * h] > 0
    cells = regions.unionfind_regions(image, h, w, 3, 3.0, 30, nan_first=True)
    assert cells and all(not np.isnan(image[p]) and label[p] != label[9 + 9 * h] for c in cells for p in c)
    assert (regions.flood_labels(image, h, w, 3)[[9 + 9 * h, 10 + 9 * h]] == 0).all()
