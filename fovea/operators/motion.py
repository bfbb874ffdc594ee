"""Shifts of frames: applying them and finding them by cross-correlation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fovea.functions.lineage import saved
from fovea.sources.movies import Movie, frame_arrays, long_rows

SHIFTS = "frame long, s1 int, s2 int, phase double"
ARRAYS = "video_id int, frame long, px array<int>, value array<double>"
#: Values of a run of frames that one task registers to each other, and frames of a run, at most.
RUN_VALUES, RUN = 1 << 21, 256


def shifted_pixel(px: Column, s1: Column, s2: Column, height: int, width: int) -> Column:
    """Where a pixel lands after a circular integer shift."""
    d1 = F.pmod(px % height + s1, F.lit(height))
    d2 = F.pmod(F.floor(px / height) + s2, F.lit(width))
    return (d1 + d2 * height).cast("int")


def shift_frames(rows: DataFrame, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """Long rows with each frame moved by its shift (frame, s1, s2): an index change, no transform."""
    moved = rows.join(shifts.select("frame", "s1", "s2"), "frame")
    return moved.withColumn("px", shifted_pixel(F.col("px"), F.col("s1"), F.col("s2"), height, width)).drop("s1", "s2")


def fourier_shift(image: np.ndarray, s1: float, s2: float, phase: float = 0.0) -> np.ndarray:
    """Circular shift by a phase ramp; the real part."""
    f1, f2 = np.fft.fftfreq(image.shape[0]), np.fft.fftfreq(image.shape[1])
    ramp = np.exp(-2j * np.pi * (f1[:, None] * s1 + f2[None, :] * s2) + 1j * phase)
    return np.fft.ifft2(np.fft.fft2(image) * ramp).real


def displacement(image: np.ndarray, target: np.ndarray) -> tuple[int, int, float]:
    """(d1, d2, phase): the circular shift of ``image`` against ``target`` of greatest cross-correlation."""
    cross = np.fft.ifft2(np.fft.fft2(image) * np.conj(np.fft.fft2(target)))
    size = np.abs(cross)
    # ties within rounding go to the first place in column-major order
    k = int(np.flatnonzero(size.ravel(order="F") >= size.max() * (1 - 1e-9))[0])
    at = [k % image.shape[0], k // image.shape[0]]
    peak = cross[at[0], at[1]]
    wrapped = [int(a - n if a + 1 > (1 + n) / 2 else a) for a, n in zip(at, image.shape, strict=True)]
    return wrapped[0], wrapped[1], float(np.arctan2(peak.imag, peak.real))


def dense(px, value, pixels: int) -> np.ndarray:
    """One frame as a flat array; absent pixels are zero, and so are null values."""
    value = np.nan_to_num(np.asarray(value, float))
    if px is None:
        return value
    out = np.zeros(pixels)
    out[np.asarray(px, int)] = value
    return out


def shift_arrays(arrays: DataFrame, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """``frame_arrays`` with each frame moved by its shift (frame, s1, s2, phase), also by parts of a pixel, in the frequency domain.

    A frame without a shift stays as it is, bit by bit; whole frames come out.
    """
    met = arrays.join(shifts.select("frame", *(F.col(c).cast("double").alias(c) for c in ("s1", "s2", "phase"))), "frame", "left")
    met = met.select("video_id", "frame", "px", "value", "s1", "s2", "phase")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for px, value, s1, s2, phase in zip(*(batch[c] for c in ("px", "value", "s1", "s2", "phase")), strict=True):
                flat = dense(px, value, height * width)
                if not np.isnan(s1) and (s1 or s2 or phase):
                    flat = fourier_shift(flat.reshape(height, width, order="F"), s1, s2, phase).ravel(order="F")
                out.append(flat)
            yield pd.DataFrame({"video_id": batch["video_id"], "frame": batch["frame"], "px": None, "value": out})

    return met.mapInPandas(run, ARRAYS)


def registered(rows: DataFrame, height: int, width: int, target: np.ndarray | None = None) -> DataFrame:
    """(frame, s1, s2, phase) of frames (frame, px, value arrays) that bring them onto ``target``, or each onto its own (tpx, tvalue)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square = lambda flat: flat.reshape(height, width, order="F")
        for batch in batches:
            out = []
            for k, frame in enumerate(batch["frame"]):
                onto = target if target is not None else square(dense(batch["tpx"][k], batch["tvalue"][k], height * width))
                d1, d2, phase = displacement(square(dense(batch["px"][k], batch["value"][k], height * width)), onto)
                out.append((frame, -d1, -d2, phase))
            yield pd.DataFrame(out, columns=["frame", "s1", "s2", "phase"])

    return rows.mapInPandas(run, SHIFTS)


def register_to_template(arrays: DataFrame, template: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, s1, s2, phase): the shift that brings each frame onto the template (px, v), one frame in size."""
    flat = np.zeros(height * width)
    for row in template.where(F.col("px").between(0, height * width - 1)).groupBy("px").agg(F.first("v").alias("v")).toLocalIterator():
        flat[row["px"]] = row["v"] or 0.0
    return registered(arrays.select("frame", "px", "value"), height, width, flat.reshape(height, width, order="F"))


def register_to_frames(arrays: DataFrame, templates: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, s1, s2, phase): the shift that brings each frame onto its own template (frame, px, value rows), such as a model's reconstruction of it."""
    onto = templates.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("px", "value"))).alias("p")).select("frame", F.col("p.px").alias("tpx"), F.col("p.value").alias("tvalue"))
    return registered(arrays.join(onto, "frame").select("frame", "px", "value", "tpx", "tvalue"), height, width)


@dataclass
class MotionCorrecter:
    """The shift of each frame (frame, s1, s2, phase), kept beside a movie and applied when it is read."""

    shifts: DataFrame

    @staticmethod
    def still(movie: Movie) -> MotionCorrecter:
        """No shift of any frame."""
        frames = movie.packed if movie.packed is not None else movie.rows
        return MotionCorrecter(frames.select("frame").distinct().select("frame", F.lit(0).alias("s1"), F.lit(0).alias("s2"), F.lit(0.0).alias("phase")))

    @staticmethod
    def onto(movie: Movie, templates: DataFrame) -> MotionCorrecter:
        """Fitted to a template a frame (frame, px, value); the movie is taken as it was recorded."""
        return MotionCorrecter(saved(register_to_frames(frame_arrays(movie), templates, movie.height, movie.width), "shifts"))

    @staticmethod
    def by_pyramid(movie: Movie) -> MotionCorrecter:
        """Fitted without a template, frames against each other within each video."""
        return MotionCorrecter(saved(register_video(frame_arrays(movie), movie.height, movie.width).drop("video_id"), "shifts"))

    def arrays(self, movie: Movie) -> DataFrame:
        return shift_arrays(frame_arrays(movie), self.shifts, movie.height, movie.width)

    def corrected(self, movie: Movie) -> Movie:
        """The movie with its frames shifted as they are read."""
        moved = self.arrays(movie)
        return Movie(long_rows(moved), movie.height, movie.width, moved.select("video_id", "frame", F.col("value").alias("pixels")))


def meet(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, tuple[int, int, float]]:
    """(sum of the left block and the right one brought onto it, the right one's shift and phase)."""
    d1, d2, phase = displacement(left, right)
    return left + fourier_shift(right, d1, d2, phase), (d1, d2, phase)


def pyramid(frames: list[np.ndarray]) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """(shifts of frames against each other without a template, their sum).

    In rounds of step 1, 2, 4, … the block that begins ``step`` later is
    registered to the block before; its sum is added to that of the latter, and
    its shift to all its frames. The phase of a frame is that of its last move.
    """
    n = len(frames)
    sums = [f.copy() for f in frames]
    shifts = np.zeros((n, 2), int)
    phases = np.zeros(n)
    step = 1
    while step < n:
        for k in range(0, n - step, 2 * step):
            sums[k], (d1, d2, phase) = meet(sums[k], sums[k + step])
            shifts[k + step : k + 2 * step] += (d1, d2)
            phases[k + step : k + 2 * step] = phase
        step *= 2
    return [(int(a), int(b), float(p)) for (a, b), p in zip(shifts, phases, strict=True)], sums[0]


def register_groups(arrays: DataFrame, height: int, width: int, *by: str) -> DataFrame:
    """(by…, frame, s1, s2, phase) of ``frame_arrays``, registered within each group of columns ``by`` as one pyramid over all its frames.

    The lowest rounds run within runs of frames, a task each; their sums meet
    in pairs, a round a doubling, so the whole takes the logarithm of the
    frames and a task never holds more than a run or two sums.
    """
    run_length = 1 << int(np.log2(max(1, min(RUN, RUN_VALUES // (height * width)))))
    keys = list(by)
    kinds = ", ".join(f"{n} {t}" for n, t in arrays.select(*keys).dtypes)
    firsts = arrays.groupBy(*keys).agg(F.min("frame").alias("first"))
    placed = arrays.join(firsts, keys).withColumn("block", F.floor((F.col("frame") - F.col("first")) / run_length))

    def start(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame", ignore_index=True)
        found, total = pyramid([dense(px, v, height * width).reshape(height, width, order="F") for px, v in zip(rows["px"], rows["value"], strict=True)])
        out = rows[[*keys, "block", "frame"]].copy()
        out[["s1", "s2", "phase"]] = found
        out["total"] = [total.ravel(order="F"), *[None] * (len(rows) - 1)]
        return out

    shifts = saved(placed.select(*keys, "block", "frame", "px", "value").groupBy(*keys, "block").applyInPandas(start, f"{kinds}, block long, {SHIFTS}, total array<double>"), "runs")
    blocks, moves = shifts.where("total IS NOT NULL").select(*keys, "block", "total"), []

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        square = lambda flat: np.asarray(flat, float).reshape(height, width, order="F")
        out = rows.iloc[:1][[*keys, "block"]].copy()
        total, move = (square(rows["total"][0]), (None,) * 3) if len(rows) == 1 else meet(square(rows["total"][0]), square(rows["total"][1]))
        out["block"] //= 2
        out[["s1", "s2", "phase"]] = [move]
        out["total"] = [total.ravel(order="F")]
        return out

    most = blocks.agg(F.max("block").alias("b")).first()["b"] or 0
    while most > 0:
        pair = F.floor(F.col("block") / 2).alias("pair")
        blocks = saved(blocks.groupBy(*keys, pair).applyInPandas(lambda k, rows: join(rows), f"{kinds}, block long, s1 int, s2 int, phase double, total array<double>"), "pyramid")
        # the right block of the pair has moved, with all its frames
        moves.append(blocks.where("s1 IS NOT NULL").select(*keys, (F.col("block") * 2 + 1).alias("at"), F.col("s1").alias("m1"), F.col("s2").alias("m2"), F.col("phase").alias("p")))
        most //= 2
    out = shifts.drop("total")
    for k, move in enumerate(moves):
        out = out.withColumn("at", F.floor(F.col("block") / (1 << k))).join(move, [*keys, "at"], "left")
        out = out.select(*keys, "block", "frame", (F.col("s1") + F.coalesce("m1", F.lit(0))).alias("s1"), (F.col("s2") + F.coalesce("m2", F.lit(0))).alias("s2"), F.coalesce("p", "phase").alias("phase"))
    return out.drop("block")


def register_video(arrays: DataFrame, height: int, width: int) -> DataFrame:
    """(video_id, frame, s1, s2, phase): one pyramid over each whole video."""
    return register_groups(arrays, height, width, "video_id")
