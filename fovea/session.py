"""The analysis as a session of verbs, in the order in which a user calls them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import fovea
from fovea.functions.lineage import saved, saved_in_buckets
from fovea.operators import folds, merging, segmentation, sweeps, views
from fovea.operators.backgrounds import Background, PerVideo, RankOne, View
from fovea.operators.motion import MotionCorrecter
from fovea.operators.products import project_footprints_masked, project_traces
from fovea.sources import store
from fovea.sources.movies import Movie, frame_arrays, long_rows


class Session:
    """State of one analysis; every verb writes its tables once, so plans stay short.

    ``backgrounds`` are the types of the background models, in the order in
    which they are updated; any ``Background`` with the hooks it needs will do.
    """

    def __init__(self, movie: Movie, backgrounds: tuple[type[Background], ...] = (PerVideo, RankOne)):
        self.movie, self.kinds = movie, backgrounds
        self.correcter = MotionCorrecter.still(movie)
        self._read(frame_arrays(movie))
        self.frames = saved(self.packed.select("video_id", "frame").distinct(), "frames")
        self.n = self.frames.count()
        self.image: DataFrame | None = None
        self.footprints: DataFrame | None = None
        self.traces: DataFrame | None = None
        self.cells: DataFrame | None = None
        self.backgrounds: list[Background] = []

    def _read(self, arrays: DataFrame) -> None:
        self.packed = saved_in_buckets(arrays, "movie", "frame")
        self.rows = long_rows(self.packed)

    def _view(self, traces: DataFrame | None = None) -> View:
        return View(self.rows, self.movie.pixels(), self.frames, self.n, self.footprints, traces)

    def _others(self, k: int) -> list[Background]:
        return self.backgrounds[:k] + self.backgrounds[k + 1 :]

    def align_frames(self) -> Session:
        """Register the frames of each video to each other, before there is a model."""
        self.correcter = MotionCorrecter.by_pyramid(self.movie)
        self._read(self.correcter.arrays(self.movie))
        return self

    def correct_motion(self) -> Session:
        """Register each frame, as it was recorded, to its reconstruction by the model so far, and go on with the movie so shifted."""
        model = views.reconstruct(self.movie.pixels(), self.frames, self.footprints, self._traces(), self.backgrounds)
        self.correcter = MotionCorrecter.onto(self.movie, model)
        self._read(self.correcter.arrays(self.movie))
        return self

    def summary_image(self) -> Session:
        self.image = saved(folds.negentropy_per_video(self.rows), "image")
        return self

    def init_from_negentropy(self, tol: float = 0.5) -> Session:
        """Footprints downhill from the peaks of the whole movie's negentropy image, instead of ``init_footprints``."""
        self.image = saved(folds.negentropy(self.rows), "image")
        found = segmentation.peaks_tolerance(self.image.withColumn("image", F.lit(1)), self.movie.height, self.movie.width, tol)
        self.footprints = saved(found.drop("image"), "footprints")
        self.zero_traces()
        return self

    def init_footprints(self, **limits: float) -> Session:
        self.footprints = saved(segmentation.init_footprints(self.image, self.movie.height, self.movie.width, **limits), "footprints")
        self.zero_traces()
        return self

    def zero_traces(self) -> Session:
        """All traces zero, gamma 0.8, lambda 50: a row a cell, the traces stay implicit."""
        names = self.footprints.select("cell").distinct()
        cells = names.select("cell", F.lit(0.8).alias("gamma"), F.lit(50.0).alias("lambda"))
        self.cells = saved(views.distinct_colours(cells).drop("red", "green", "blue"), "cells")
        self.traces = None
        return self

    def init_backgrounds(self) -> Session:
        self.backgrounds = [kind.begin(self._view()).stored() for kind in self.kinds]
        return self

    def _traces(self) -> DataFrame:
        if self.traces is not None:
            return self.traces
        return self.rows.sparkSession.createDataFrame([], "video_id int, frame long, cell int, r double, c double, s double")

    def update_traces(self, deconvolve: Callable = sweeps.oasis_fitted, by_video: bool = False) -> Session:
        """New traces of all cells; with ``by_video`` no pool crosses from one video to the next."""
        starts = [r["f"] for r in self.frames.groupBy("video_id").agg(F.min("frame").alias("f")).collect()] if by_video else None
        old = self._traces()
        values = project_traces(self.rows, self.footprints).select("frame", "cell", F.col("r").alias("x"))
        taken = [x for b in self.backgrounds if (x := b.trace_correction(self.footprints, self.frames)) is not None]
        # a model that is the same in every frame gives no frames
        for k, x in enumerate(taken):
            values = values.join(x.withColumnRenamed("x", f"x{k}"), ["frame", "cell"] if "frame" in x.columns else "cell", "left")
            values = values.select("frame", "cell", (F.col("x") - F.coalesce(f"x{k}", F.lit(0.0))).alias("x"))
        values = values.join(old.select("frame", "cell", "c"), ["frame", "cell"], "left").select("frame", "cell", "x", F.coalesce("c", F.lit(0.0)).alias("c"))
        whole = deconvolve is not sweeps.zero_clamp
        packed = saved(sweeps.trace_sweep(values, self.footprints, deconvolve, self.cells, starts=starts), "packed-traces")
        if whole:
            self.cells = saved(packed.select("cell", "gamma", "lambda").join(self.cells.select("cell", "color"), "cell"), "cells")
        self.traces = saved(sweeps.unpacked(packed).join(self.frames, "frame").select("video_id", "frame", "cell", "r", "c", "s"), "traces")
        for k, b in enumerate(self.backgrounds):
            new = b.after_traces(self._view(self.traces), self._others(k))
            self.backgrounds[k] = b if new is b else new.stored()
        return self

    def update_footprints(self, reach: int = 1) -> Session:
        mask = saved(sweeps.dilated(self.footprints, self.movie.height, self.movie.width, reach), "mask")
        sums = project_footprints_masked(self.packed, self.traces, mask).withColumnRenamed("yc", "v")
        taken = [x for b in self.backgrounds if (x := b.pixel_correction(self.traces)) is not None]
        if taken:
            x = reduce(DataFrame.unionByName, taken).groupBy("px", "cell").agg(F.sum("x").alias("x"))
            sums = sums.join(x, ["px", "cell"], "left").select("px", "cell", (F.col("v") - F.coalesce("x", F.lit(0.0))).alias("v"))
        new = saved(sweeps.footprint_sweep(sums, self.footprints, self.traces, self.movie.height, self.movie.width, reach), "footprints")
        # the backgrounds are updated with the footprints from before, one after another
        for k, b in enumerate(self.backgrounds):
            after = b.after_footprints(self._view(self.traces), self._others(k))
            self.backgrounds[k] = b if after is b else after.stored()
        self.footprints = new
        self.traces = saved(sweeps.drop_empty(self.traces, new), "traces")
        self.cells = saved(sweeps.drop_empty(self.cells, new), "cells")
        return self

    def merge_cells(self, threshold: float = 0.6) -> Session:
        footprints, traces, heads = merging.merge(self.footprints, self.traces, ("r", "c", "s"), threshold)
        self.footprints, self.traces = saved(footprints, "footprints"), saved(traces, "traces")
        self.cells = saved(self.cells.join(heads.where("cell = head"), "cell", "left_semi"), "cells")
        return self

    def run(self, rounds: int = 4, merges: int = 3, deconvolve: Callable = sweeps.oasis_fitted, **limits: float) -> Session:
        """Summary image, footprints, backgrounds and traces; then rounds of footprints, merges and traces."""
        self.summary_image().init_footprints(**limits).init_backgrounds().update_traces(deconvolve)
        for _ in range(rounds):
            self.update_footprints()
            for _ in range(merges):
                self.merge_cells()
            self.update_traces(deconvolve)
        return self

    def save(self, path: str, videos: DataFrame | None = None, filename: str | None = None, segments: int | None = None) -> None:
        row = (self.movie.height, self.movie.width, self.n, filename, segments, fovea.__version__)
        meta = self.rows.sparkSession.createDataFrame([row], "h int, w int, nframes long, filename string, nsegs int, code_version string")
        tables = {"footprints": self.footprints, "image": self.image, "traces": self.traces, "cells": self.cells, "meta": meta}
        store.save(path, tables, self.backgrounds, videos)
