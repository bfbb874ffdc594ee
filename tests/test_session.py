"""The whole analysis finds what was planted, and what is saved comes back."""

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from fovea.functions.deconvolution import oasis
from fovea.operators import motion
from fovea.operators.backgrounds import Background, PerVideo, RankOne, Static, interacts, left_to
from fovea.session import Session
from fovea.sources import movies, store, synthetic

LIMITS = {"min_size": 8, "sens": 5.0, "min_n": 100}


def matrix(table, row, column, value, n):
    out = {}
    for r in table.collect():
        out.setdefault(r[row], np.zeros(n))[r[column]] = r[value]
    return out


@pytest.fixture(scope="module")
def truth(spark):
    """(footprints, traces) of the four cells of the movie made of the tables."""
    feet = matrix(synthetic.footprints(spark, 4, 24, 24, 2.5), "cell", "px", "w", 576)
    traces = synthetic.ar1_closed(movies.event_spikes(spark, DATA), movies.CELL_GAMMA, 60)
    return feet, matrix(traces, "cell", "frame", "c", 241)


@pytest.fixture(scope="module")
def session(spark):
    """What the query pipeline_e2e runs: four rounds of three merges, fitted deconvolution."""
    return Session(movies.event_cells_movie(spark, DATA)).run(**LIMITS)


def test_the_default_run_finds_the_cells(session, truth):
    """Each cell found is one of the four, its trace follows that one's, no two are the same, and most are found."""
    found, traces = matrix(session.footprints, "cell", "px", "w", 576), matrix(session.traces, "cell", "frame", "c", 241)
    of = {}
    for cell, w in found.items():
        best = max(truth[0], key=lambda k: float(w @ truth[0][k]))
        assert float(w @ truth[0][best]) > 0.9 and np.corrcoef(traces[cell][1:], truth[1][best][1:])[0, 1] > 0.9
        of[cell] = best
    assert len(of) == len(set(of.values())) >= 3
    # a trace is the deconvolution of the projection that is saved with it
    raw = matrix(session.traces, "cell", "frame", "r", 241)
    for r in session.cells.collect():
        c, _ = oasis(raw[r["cell"]][1:], r["gamma"], r["lambda"])
        assert traces[r["cell"]][1:] == pytest.approx(c, abs=1e-6)


def test_one_still_background(spark, truth):
    session = Session(movies.event_cells_movie(spark, DATA), (Static,)).run(rounds=1, merges=1, **LIMITS)
    found = matrix(session.footprints, "cell", "px", "w", 576)
    assert len(found) >= 3 and all(max(float(w @ t) for t in truth[0].values()) > 0.85 for w in found.values())
    image = matrix(session.backgrounds[0].table.withColumn("k", F.lit(1)), "k", "px", "b", 576)[1]
    assert abs(np.median(image) - 10) < 1.0


def test_no_background_and_one_of_the_users_own(spark, tmp_path):
    """A model needs only the hooks that concern it, and a rule for what it leaves to others."""

    class Flat(Background):
        seen = 0

        def trace_correction(self, footprints, frames):
            return footprints.groupBy("cell").agg((F.sum("w") * 10).alias("x"))

        def pixel_correction(self, traces):
            return traces.groupBy("cell").agg((F.sum("c") * 10).alias("x")).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(575)))).select("px", "cell", "x")

        def after_footprints(self, view, others):
            Flat.seen += 1
            return self

    movie = movies.event_cells_movie(spark, DATA)
    session = Session(movie, (Flat,)).run(rounds=1, merges=0, **LIMITS)
    assert Flat.seen == 1 and session.footprints.select("cell").distinct().count() >= 3
    assert Session(movie, ()).summary_image().init_footprints(**LIMITS).init_backgrounds().backgrounds == []
    rank = RankOne(spark.createDataFrame([(1, 0, 0.5)], "video_id int, px int, b double"), spark.createDataFrame([(1, 1, 2.0)], "video_id int, frame long, f double"))
    assert left_to("trace", rank, [Flat()]) == [] and len(left_to("trace", rank, [Flat(), PerVideo(rank.table.withColumn("m", F.lit(1.0)))])) == 1
    interacts("trace", RankOne, Flat)(lambda own, other: own.table.groupBy("video_id").agg((F.sum("b") * 10).alias("x")))
    assert left_to("trace", rank, [Flat()])[0].collect()[0]["x"] == 5.0


def test_a_shaken_movie_is_brought_back(spark, session):
    """The movie of a fitted model, shaken, is registered to the model's reconstruction and read shifted."""
    movie = session.movie
    move = F.col("frame") % 3 - 1
    moves = session.frames.select("frame", move.cast("int").alias("s1"), (-move).cast("int").alias("s2"))
    shaken = Session(movies.Movie(motion.shift_frames(session.rows, moves, 24, 24), 24, 24))
    for name in ("footprints", "traces", "cells", "image", "backgrounds"):
        setattr(shaken, name, getattr(session, name))
    shaken.correct_motion()
    want = {r["frame"]: (r["s1"], r["s2"]) for r in moves.collect()}
    got = {r["frame"]: (-r["s1"], -r["s2"]) for r in shaken.correcter.shifts.collect()}
    # a frame in which no cell is lit is all background, and may lie anywhere
    lit = {r["frame"] for r in session.traces.groupBy("frame").agg(F.sum("c").alias("c")).where("c > 60").collect()}
    assert len(lit) > 50 and sum(got[k] == want[k] for k in lit) > 0.9 * len(lit)
    both = shaken.rows.join(movie.rows.withColumnRenamed("value", "y"), ["video_id", "frame", "px"]).where(F.col("frame").isin(*[k for k in lit if got[k] == want[k]]))
    assert both.agg(F.max(F.abs(F.col("value") - F.col("y")))).first()[0] < 1e-6


def test_round_trip(spark, session, tmp_path):
    path = str(tmp_path / "solution")
    session.save(path, spark.createDataFrame([(1, "x_animal3day2.nwb")], "video_id int, filename string"))
    tables, (b0, b1) = store.load(spark, path)
    assert tables["traces"].select("video_key").distinct().first()[0] == "animal3day2"
    for name, table in (("footprints", session.footprints), ("cells", session.cells)):
        assert sorted(map(tuple, tables[name].select(table.columns).collect())) == sorted(map(tuple, table.collect()))
    assert tables["meta"].first()["h"] == 24 and len(tables["cells"].first()["color"]) == 6
    assert b0.table.count() == session.backgrounds[0].table.count()
    assert b1.trace.agg(F.sum("f")).first()[0] == pytest.approx(session.backgrounds[1].trace.agg(F.sum("f")).first()[0])
