"""Shifts against plain Fourier sums, pyramids across runs of frames, and a movie that is shaken and brought back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fovea.operators import motion
from fovea.sources import movies


def plain_shift(image, s1, s2, phase):
    """The discrete Fourier transform written out; the frequencies of n places are 0, 1, …, -1."""
    n1, n2 = image.shape
    whole = lambda n: [k if 2 * k < n else k - n for k in range(n)]
    out = np.zeros(image.shape)
    for a in range(n1):
        for b in range(n2):
            total = 0
            for k in whole(n1):
                for m in whole(n2):
                    wave = sum(image[i, j] * np.exp(-2j * np.pi * (k * i / n1 + m * j / n2)) for i in range(n1) for j in range(n2))
                    total += wave * np.exp(-2j * np.pi * (k * s1 / n1 + m * s2 / n2) + 1j * phase) * np.exp(2j * np.pi * (k * a / n1 + m * b / n2))
            out[a, b] = (total / (n1 * n2)).real
    return out


def packed(spark, frames, video=None):
    rows = [(1 if video is None else video[k], k + 1, [float(v) for v in f.ravel(order="F")]) for k, f in enumerate(frames)]
    p = spark.createDataFrame(rows, "video_id int, frame long, pixels array<double>")
    h, w = frames[0].shape
    return movies.Movie(movies.exploded(p), h, w, p)


def images(df, h, w):
    out = {}
    for r in df.collect():
        out.setdefault(r["frame"], np.zeros((h, w)))[r["px"] % h, r["px"] // h] = r["value"]
    return out


def test_shifts_by_parts_of_a_pixel(spark):
    rng = np.random.default_rng(1)
    frames = [rng.normal(size=(4, 5)) for _ in range(4)]
    moves = [(1, 0.5, -1.25, 0.7), (2, 2.0, 1.0, 0.0), (4, 0.0, 0.0, 0.0)]
    shifts = spark.createDataFrame(moves, "frame long, s1 double, s2 double, phase double")
    got = images(motion.MotionCorrecter(shifts).corrected(packed(spark, frames)).rows, 4, 5)
    assert got[1] == pytest.approx(plain_shift(frames[0], 0.5, -1.25, 0.7), abs=1e-9)
    assert got[2] == pytest.approx(np.roll(frames[1], (2, 1), (0, 1)), abs=1e-9)
    assert (got[3] == frames[2]).all() and (got[4] == frames[3]).all()  # no shift, or one of nothing


def test_sparse_frames_are_whole_afterwards(spark):
    rows = spark.createDataFrame([(1, 1, 0, 2.0), (1, 2, 5, 3.0)], movies.LONG)
    shifts = spark.createDataFrame([(1, 1, 1, 0.0)], motion.SHIFTS)
    got = images(motion.MotionCorrecter(shifts).corrected(movies.Movie(rows, 3, 2)).rows, 3, 2)
    want = np.zeros((3, 2))
    want[1, 1] = 2
    assert got[1] == pytest.approx(want, abs=1e-9) and got[2][2, 1] == 3 and got[2].sum() == 3


def plain_pyramid(frames):
    """The rounds over all frames at once."""
    n, step = len(frames), 1
    sums, shifts, phases = [f.copy() for f in frames], [[0, 0] for _ in frames], [0.0] * len(frames)
    while step < n:
        for i in range(0, n - step, 2 * step):
            d1, d2, phase = motion.displacement(sums[i], sums[i + step])
            sums[i] = sums[i] + motion.fourier_shift(sums[i + step], d1, d2, phase)
            for j in range(i + step, min(n, i + 2 * step)):
                shifts[j] = [shifts[j][0] + d1, shifts[j][1] + d2]
                phases[j] = phase
        step *= 2
    return [(*s, p) for s, p in zip(shifts, phases, strict=True)]


@pytest.mark.parametrize("run", [1, 2, 8, 64])
def test_pyramid_across_runs(spark, monkeypatch, run):
    """Runs of any length give the rounds over all frames of a video, videos apart; moves are found across the borders of runs."""
    monkeypatch.setattr(motion, "RUN", run)
    rng = np.random.default_rng(2)
    still = rng.normal(size=(6, 7))
    frames, video, moves = [], [], []
    for v, n in ((1, 13), (2, 1), (3, 8)):
        for k in range(n):
            moves.append((0, 0) if k == 0 else tuple(int(x) for x in rng.integers(-2, 3, 2)))
            frames.append(np.roll(still, moves[-1], (0, 1)) + 0.02 * rng.normal(size=still.shape))
            video.append(v)
    movie = packed(spark, frames, video)
    got = {r["frame"]: (r["s1"], r["s2"], r["phase"]) for r in motion.register_video(movies.frame_arrays(movie), 6, 7).collect()}
    assert len(got) == len(frames)
    for v in (1, 2, 3):
        at = [k for k, x in enumerate(video) if x == v]
        for k, want in zip(at, plain_pyramid([frames[k] for k in at]), strict=True):
            assert got[k + 1][:2] == want[:2] and got[k + 1][2] == pytest.approx(want[2], abs=1e-6)
            assert ((got[k + 1][0] + moves[k][0]) % 6, (got[k + 1][1] + moves[k][1]) % 7) == (0, 0)


def test_load_register_shift_register_again(spark, tmp_path):
    """A saved movie is opened, registered to its model and read shifted; registered again, nothing moves."""
    rng = np.random.default_rng(3)
    model = [rng.normal(size=(8, 6)) for _ in range(9)]
    moves = [tuple(int(x) for x in rng.integers(-2, 3, 2)) for _ in model]
    signs = [1, -1, 1, 1, 1, 1, 1, 1, 1]  # a frame turned over comes back by its phase
    shaken = [s * np.roll(f, m, (0, 1)) for f, m, s in zip(model, moves, signs, strict=True)]
    packed(spark, shaken).packed.select("video_id", "frame", F.col("pixels").cast("array<float>")).write.parquet(str(tmp_path / "m.parquet"))
    movie = movies.open_movie(spark, str(tmp_path / "m.parquet"), 8, 6)
    templates = packed(spark, model).rows.select("frame", "px", "value")
    first = motion.MotionCorrecter.onto(movie, templates)
    assert {r["frame"]: (-r["s1"], -r["s2"]) for r in first.shifts.collect()} == dict(enumerate(moves, 1))
    back = first.corrected(movie)
    got = images(back.rows, 8, 6)
    assert all(got[k + 1] == pytest.approx(f, abs=1e-5) for k, f in enumerate(model))
    again = motion.MotionCorrecter.onto(back, templates).shifts.collect()
    assert all((r["s1"], r["s2"]) == (0, 0) and abs(r["phase"]) < 1e-6 for r in again)
    still = motion.MotionCorrecter.still(movie)
    assert images(still.corrected(movie).rows, 8, 6)[2] == pytest.approx(np.float32(shaken[1]))
