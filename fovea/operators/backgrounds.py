"""Background models of a movie and what they take from traces, footprints and each other.

* static: one image ``b`` (px, m, b);
* per video: an image each (video_id, px, m, b);
* rank one: an image each (video_id, px, b) times a common trace (frame, f).

The hooks of a model are methods with defaults that do nothing, so another
model needs only those that concern it. What a model leaves to another is a
rule for the pair of their types, see ``interacts``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.functions.lineage import saved

from .folds import mean_by_video


@dataclass
class View:
    """What the hooks of a model see of an analysis: the movie in long form, its pixels and frames, and the cells so far."""

    rows: DataFrame
    pixels: DataFrame
    frames: DataFrame
    n: int
    footprints: DataFrame
    traces: DataFrame | None = None


class Background:
    """Defaults: a background that is nowhere."""

    @classmethod
    def begin(cls, view: View) -> Background:
        return cls()

    def after_traces(self, view: View, others: list[Background]) -> Background:
        """The model once the traces are new."""
        return self

    def after_footprints(self, view: View, others: list[Background]) -> Background:
        """The model once the footprints are new; the view has those from before."""
        return self

    def stored(self) -> Background:
        """The model with its tables written."""
        return self

    def trace_correction(self, footprints: DataFrame, frames: DataFrame) -> DataFrame | None:
        """(frame, cell, x): what the background adds to the projections."""
        return None

    def pixel_correction(self, traces: DataFrame) -> DataFrame | None:
        """(px, cell, x): what the background adds to the pixel sums."""
        return None

    def image(self, frames: DataFrame) -> DataFrame | None:
        """(frame, px, x) of the given frames (video_id, frame)."""
        return None

    def update(self, footprints: DataFrame, traces: DataFrame) -> Background:
        return self


Others = "Background | list[Background] | None"
Rule = Callable[["Background", "Background"], DataFrame]
_rules: dict[tuple[str, type, type], Rule] = {}


def interacts(what: str, taker: type, giver: type) -> Callable[[Rule], Rule]:
    """Register what ``taker`` leaves to ``giver``: ``pixel`` (video_id, px, x) or ``trace`` (video_id, x)."""

    def register(rule: Rule) -> Rule:
        _rules[what, taker, giver] = rule
        return rule

    return register


def left_to(what: str, taker: Background, others: Others) -> list[DataFrame]:
    """What the others, in order, take from a model; a pair of types without a rule takes nothing."""
    given = [others] if isinstance(others, Background) else others or []
    rules = [(o, _rules.get((what, type(taker), type(o)))) for o in given]
    return [rule(taker, o) for o, rule in rules if rule is not None]


def footprint_sums(footprints: DataFrame, images: DataFrame, *keys: str) -> DataFrame:
    """A b by group: (…, cell, ab)."""
    return footprints.join(images.select(*keys, "px", "b"), "px").groupBy(*keys, "cell").agg(F.sum(F.col("w") * F.col("b")).alias("ab"))


def trace_sums(traces: DataFrame, *keys: str) -> DataFrame:
    return traces.groupBy(*keys, "cell").agg(F.sum("c").alias("s"))


def explained(footprints: DataFrame, sums: DataFrame, *keys: str) -> DataFrame:
    """A' s by pixel: (…, px, e)."""
    return footprints.join(sums, "cell").groupBy(*keys, "px").agg(F.sum(F.col("w") * F.col("s")).alias("e"))


class Static(Background):
    def __init__(self, image: DataFrame):
        self.table = image  # px, m, b

    @classmethod
    def start(cls, rows: DataFrame, frames: int) -> Static:
        m = rows.groupBy("px").agg((F.sum("value") / frames).alias("m"))
        return cls(m.withColumn("b", F.col("m")))

    def trace_correction(self, footprints: DataFrame, frames: DataFrame) -> DataFrame:
        """(cell, x), the same for every frame."""
        return footprint_sums(footprints, self.table).select("cell", F.col("ab").alias("x"))

    def pixel_correction(self, traces: DataFrame) -> DataFrame:
        """One row a pixel and cell: the size of a dense footprint table."""
        sums = traces.groupBy(F.lit(1).alias("k"), "cell").agg(F.sum("c").alias("s"))
        return self.table.withColumn("k", F.lit(1)).join(sums, "k").select("px", "cell", (F.col("b") * F.col("s")).alias("x"))

    def update(self, footprints: DataFrame, traces: DataFrame, frames: int = 1) -> Static:
        e = explained(footprints, trace_sums(traces))
        b = F.col("m") - F.coalesce("e", F.lit(0.0)) / frames
        return Static(self.table.drop("b").join(e, "px", "left").select("px", "m", b.alias("b")))

    @classmethod
    def begin(cls, view: View) -> Static:
        return cls.start(view.rows, view.n)

    def after_footprints(self, view: View, others: list[Background]) -> Static:
        return self.update(view.footprints, view.traces, view.n)

    def stored(self) -> Static:
        return Static(saved(self.table, "static"))

    def image(self, frames: DataFrame) -> DataFrame:
        return frames.select("frame", F.lit(1).alias("k")).join(self.table.select(F.lit(1).alias("k"), "px", "b"), "k").select("frame", "px", F.col("b").alias("x"))


class PerVideo(Background):
    def __init__(self, images: DataFrame):
        self.table = images  # video_id, px, m, b

    @classmethod
    def start(cls, rows: DataFrame) -> PerVideo:
        return cls(mean_by_video(rows).withColumn("b", F.col("m")))

    def trace_correction(self, footprints: DataFrame, frames: DataFrame) -> DataFrame:
        sums = footprint_sums(footprints, self.table, "video_id")
        return frames.select("video_id", "frame").join(sums, "video_id").select("frame", "cell", F.col("ab").alias("x"))

    def pixel_correction(self, traces: DataFrame) -> DataFrame:
        sums = trace_sums(traces, "video_id")
        return self.table.join(sums, "video_id").groupBy("px", "cell").agg(F.sum(F.col("b") * F.col("s")).alias("x"))

    def update(self, footprints: DataFrame, traces: DataFrame, others: Others = None, frames: int = 1, lengths: DataFrame | None = None, denominator: str = "total") -> PerVideo:
        """b = m - A' sum(C) / frames - b1 sum(f) / len: by all frames, or (``own``) by the video's."""
        e = explained(footprints, trace_sums(traces, "video_id"), "video_id")
        out = self.table.drop("b").join(e, ["video_id", "px"], "left")
        by = F.lit(float(frames))
        if denominator == "own":
            out, by = out.join(lengths.select("video_id", "n"), "video_id"), F.col("n")
        value = F.col("m") - F.coalesce("e", F.lit(0.0)) / by
        for k, taken in enumerate(left_to("pixel", self, others)):
            out = out.join(taken.withColumnRenamed("x", f"x{k}"), ["video_id", "px"], "left")
            value = value - F.coalesce(f"x{k}", F.lit(0.0))
        return PerVideo(out.select("video_id", "px", "m", value.alias("b")))

    @classmethod
    def begin(cls, view: View) -> PerVideo:
        return cls.start(view.rows)

    def after_footprints(self, view: View, others: list[Background]) -> PerVideo:
        return self.update(view.footprints, view.traces, others, view.n)

    def stored(self) -> PerVideo:
        return PerVideo(saved(self.table, "b0"))

    def image(self, frames: DataFrame) -> DataFrame:
        return frames.join(self.table, "video_id").select("frame", "px", F.col("b").alias("x"))


class RankOne(Background):
    def __init__(self, images: DataFrame, trace: DataFrame):
        self.table, self.trace = images, trace  # (video_id, px, b), (video_id, frame, f)

    @classmethod
    def start(cls, pixels: DataFrame, frames: DataFrame, footprints: DataFrame) -> RankOne:
        """b: the pixels that no cell covers, at unit norm, alike in all videos; f: zero. No such pixel: zero."""
        free = pixels.select("px").join(footprints.where("w > 0").select("px").distinct(), "px", "left_anti")
        n = free.agg(F.count("*").alias("n"))
        videos = frames.select("video_id").distinct().withColumn("k", F.lit(1))
        flat = free.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").withColumn("b", F.try_divide(F.lit(1.0), F.sqrt("n")))
        return cls(videos.join(flat, "k").select("video_id", "px", "b"), frames.select("video_id", "frame", F.lit(0.0).alias("f")))

    def raw_trace(self, rows: DataFrame) -> DataFrame:
        """Y' b: (video_id, frame, raw_f)."""
        return rows.join(self.table, ["video_id", "px"]).groupBy("video_id", "frame").agg(F.sum(F.col("value") * F.col("b")).alias("raw_f"))

    def raw_images(self, rows: DataFrame) -> DataFrame:
        """Y f: (video_id, px, raw_b)."""
        return rows.join(self.trace.select("frame", "f"), "frame").groupBy("video_id", "px").agg(F.sum(F.col("value") * F.col("f")).alias("raw_b"))

    def weighted_sums(self, traces: DataFrame) -> DataFrame:
        """C' f by video: (video_id, cell, s)."""
        return traces.join(self.trace.select("frame", "f"), "frame").groupBy("video_id", "cell").agg(F.sum(F.col("c") * F.col("f")).alias("s"))

    def trace_correction(self, footprints: DataFrame, frames: DataFrame) -> DataFrame:
        sums = footprint_sums(footprints, self.table, "video_id")
        return self.trace.join(sums, "video_id").select("frame", "cell", (F.col("f") * F.col("ab")).alias("x"))

    def pixel_correction(self, traces: DataFrame) -> DataFrame:
        return self.table.join(self.weighted_sums(traces), "video_id").groupBy("px", "cell").agg(F.sum(F.col("b") * F.col("s")).alias("x"))

    def update_trace(self, rows: DataFrame, footprints: DataFrame, traces: DataFrame, others: Others) -> RankOne:
        """f = Y' b - C (A b) - b' b0, not clamped."""
        ab = footprint_sums(footprints, self.table, "video_id")
        taken = traces.join(ab, ["video_id", "cell"]).groupBy("frame").agg(F.sum(F.col("c") * F.col("ab")).alias("taken"))
        out = self.trace.select("video_id", "frame").join(self.raw_trace(rows), ["video_id", "frame"], "left").join(taken, "frame", "left")
        value = F.coalesce("raw_f", F.lit(0.0)) - F.coalesce("taken", F.lit(0.0))
        for k, left in enumerate(left_to("trace", self, others)):
            out = out.join(left.withColumnRenamed("x", f"x{k}"), "video_id", "left")
            value = value - F.coalesce(f"x{k}", F.lit(0.0))
        return RankOne(self.table, out.select("video_id", "frame", value.alias("f")))

    def update_images(self, rows: DataFrame, footprints: DataFrame, traces: DataFrame, others: Others) -> RankOne:
        """b = Y f - A' (C' f) - b0 sum(f), at unit norm (zero where there is none)."""
        raw = self.raw_images(rows)
        e = explained(footprints, self.weighted_sums(traces), "video_id")
        out = raw.join(e, ["video_id", "px"], "left")
        value = F.col("raw_b") - F.coalesce("e", F.lit(0.0))
        for k, left in enumerate(left_to("pixel", self, others)):
            out = out.join(left.withColumnRenamed("x", f"x{k}"), ["video_id", "px"], "left")
            value = value - F.coalesce(f"x{k}", F.lit(0.0))
        out = out.select("video_id", "px", value.alias("b"))
        norms = out.groupBy("video_id").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("norm"))
        unit = F.coalesce(F.try_divide("b", "norm"), F.lit(0.0))
        return RankOne(out.join(norms, "video_id").select("video_id", "px", unit.alias("b")), self.trace)

    @classmethod
    def begin(cls, view: View) -> RankOne:
        return cls.start(view.pixels, view.frames, view.footprints)

    def after_traces(self, view: View, others: list[Background]) -> RankOne:
        return self.update_trace(view.rows, view.footprints, view.traces, others)

    def after_footprints(self, view: View, others: list[Background]) -> RankOne:
        return self.update_images(view.rows, view.footprints, view.traces, others)

    def stored(self) -> RankOne:
        return RankOne(saved(self.table, "b1"), saved(self.trace, "f"))

    def image(self, frames: DataFrame) -> DataFrame:
        f = self.trace.join(frames.select("frame"), "frame", "left_semi")
        return f.join(self.table, "video_id").select("frame", "px", (F.col("b") * F.col("f")).alias("x"))


# What models take from each other


def frame_sums(rank1: RankOne) -> DataFrame:
    return rank1.trace.groupBy("video_id").agg(F.sum("f").alias("sf"), F.count("*").alias("len"))


def interaction_b0(rank1: RankOne) -> DataFrame:
    """(video_id, px, x): b1 times the mean of f over the video."""
    return rank1.table.join(frame_sums(rank1), "video_id").select("video_id", "px", (F.col("b") * F.col("sf") / F.col("len")).alias("x"))


def interaction_b1(rank1: RankOne, other: Background) -> DataFrame:
    """(video_id, px, x): the other model's image times the sum of f over the video."""
    sums = frame_sums(rank1)
    if isinstance(other, Static):
        images = sums.withColumn("k", F.lit(1)).join(other.table.withColumn("k", F.lit(1)), "k")
    else:
        images = other.table.join(sums, "video_id")
    return images.select("video_id", "px", (F.col("b") * F.col("sf")).alias("x"))


def interaction_f(rank1: RankOne, other: Background) -> DataFrame:
    """(video_id, x): the inner product of the rank-one image with the other model's."""
    keys = ["px"] if isinstance(other, Static) else ["video_id", "px"]
    theirs = other.table.select(*keys, F.col("b").alias("b0"))
    return rank1.table.join(theirs, keys).groupBy("video_id").agg(F.sum(F.col("b") * F.col("b0")).alias("x"))


interacts("pixel", PerVideo, RankOne)(lambda own, other: interaction_b0(other))
interacts("pixel", RankOne, PerVideo)(interaction_b1)
interacts("pixel", RankOne, Static)(interaction_b1)
interacts("trace", RankOne, PerVideo)(interaction_f)
interacts("trace", RankOne, Static)(interaction_f)
