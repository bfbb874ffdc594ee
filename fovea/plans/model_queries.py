"""Queries on traces, footprints, backgrounds, sweeps, merging and views of the model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.functions.columns import clamped, rounded, trace_negentropy as negentropy_of
from fovea.functions.lineage import saved
from fovea.operators import backgrounds, merging, products, sweeps, views
from fovea.operators.backgrounds import PerVideo, RankOne, Static
from fovea.plans.ctes import FEET, MODEL, TRACES, penalised, pools_sql
from fovea.plans.movie_queries import r
from fovea.plans.registry import query
from fovea.sources import movies

FRAMES = 720
CELLS = range(1, 10)


@dataclass
class EventModel:
    """The event movie with the grid footprints: traces, and backgrounds before and after an update."""

    movie: movies.Movie
    rows: DataFrame
    footprints: DataFrame
    frames: DataFrame
    traces: DataFrame  # video_id, frame, cell, r, c
    b0: PerVideo
    b1: RankOne

    def updated(self) -> tuple[PerVideo, RankOne]:
        b0 = self.b0.update(self.footprints, self.traces, self.b1, FRAMES)
        b0 = PerVideo(saved(b0.table, "b0"))
        return b0, self.b1.update_images(self.rows, self.footprints, self.traces, b0)


def event_traces(spark: SparkSession, sf_dir: str) -> tuple[movies.Movie, DataFrame, DataFrame]:
    movie, grid = movies.event_movie(spark, sf_dir), movies.grid_footprints(spark)
    return movie, grid, products.project_traces(movie.rows, grid).withColumn("c", clamped(F.col("r")))


def event_model(spark: SparkSession, sf_dir: str) -> EventModel:
    movie = movies.event_movie(spark, sf_dir)
    rows, grid = saved(movie.rows, "event-movie"), movies.grid_footprints(spark)
    frames = rows.select("video_id", "frame").distinct()
    traces = saved(products.project_traces(rows, grid).withColumn("c", clamped(F.col("r"))), "event-traces")
    b0 = PerVideo.start(rows)
    start = RankOne.start(movie.pixels(), frames, grid)
    b1 = start.update_trace(rows, grid, traces, b0)
    return EventModel(movie, rows, grid, frames, traces, PerVideo(saved(b0.table, "b0")), RankOne(start.table, saved(b1.trace, "f")))


# Products


@query(f"WITH {TRACES} SELECT frame, cell, round(r, 6) + 0.0 AS r FROM tr")
def project_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_traces(spark, sf_dir)[2].select("frame", "cell", r("r"))


@query(f"WITH {TRACES} SELECT frame, cell, round(c, 6) + 0.0 AS c FROM tr")
def zero_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_traces(spark, sf_dir)[2].select("frame", "cell", r("c"))


@query(f"WITH {FEET} SELECT a.cell AS i, b.cell AS j, round(sum(a.w * b.w), 6) + 0.0 AS g FROM feet a JOIN feet b USING (px) GROUP BY ALL")
def footprint_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.footprint_gram(movies.event_footprints(spark, sf_dir)).select("i", "j", r("g"))


@query(f"WITH {TRACES} SELECT ev.px, tr.cell, round(sum(value * c), 1) + 0.0 AS yc FROM ev JOIN tr USING (frame) GROUP BY ALL")
def project_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    movie, _, traces = event_traces(spark, sf_dir)
    return products.project_footprints(movie.rows, traces).select("px", "cell", r("yc", 1))


@query(f"WITH {TRACES} SELECT a.cell AS i, b.cell AS j, round(sum(a.c * b.c), 2) + 0.0 AS g FROM tr a JOIN tr b USING (frame) GROUP BY ALL")
def trace_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.trace_gram(event_traces(spark, sf_dir)[2]).select("i", "j", r("g", 2))


@query(f"""WITH {TRACES}, m AS (SELECT frame, px, sum(c * w) AS x FROM tr JOIN grid USING (cell) GROUP BY ALL)
SELECT round(sqrt(sum((value - coalesce(x, 0)) ** 2)), 4) + 0.0 AS norm FROM ev LEFT JOIN m USING (frame, px)""")
def residual_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    movie, grid, traces = event_traces(spark, sf_dir)
    return products.residual_norm(movie.rows, grid, traces).select(r("norm", 4))


CORR = "cr AS (SELECT a.cell AS i, b.cell AS j, CASE WHEN stddev_pop(a.c) > 1e-9 AND stddev_pop(b.c) > 1e-9 THEN corr(a.c, b.c) END AS corr FROM tr a JOIN tr b ON a.frame = b.frame AND a.cell < b.cell GROUP BY ALL)"


@query(f"WITH {TRACES}, {CORR} SELECT i, j, round(corr, 6) + 0.0 AS corr FROM cr")
def trace_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.trace_correlation(event_traces(spark, sf_dir)[2]).select("i", "j", r("corr"))


@query(f"""WITH {TRACES}, aa AS (SELECT a.cell AS i, b.cell AS j, sum(a.w * b.w) AS g FROM grid a JOIN grid b USING (px) GROUP BY ALL),
cc AS (SELECT a.cell AS i, b.cell AS j, sum(a.c * b.c) AS g FROM tr a JOIN tr b USING (frame) GROUP BY ALL),
p AS (SELECT a.cell AS a, b.cell AS b, sum(a.r * b.c) AS g FROM tr a JOIN tr b USING (frame) GROUP BY ALL),
pairs AS (SELECT i, j FROM aa WHERE i <> j AND g <> 0),
maps AS (SELECT i, j, cell AS a, CASE WHEN cell = j THEN i ELSE cell END AS m FROM pairs, (SELECT DISTINCT cell FROM grid)),
now AS (SELECT -2 * (SELECT sum(g) FROM p WHERE a = b) + (SELECT sum(aa.g * cc.g) FROM aa JOIN cc USING (i, j)) AS l),
l1 AS (SELECT i, j, -2 * sum(p.g) AS l FROM maps JOIN p ON p.a = maps.a AND p.b = maps.m GROUP BY ALL),
l2 AS (SELECT x.i, x.j, sum(aa.g * cc.g) AS l FROM maps x JOIN maps y USING (i, j) JOIN aa ON aa.i = x.a AND aa.j = y.a JOIN cc ON cc.i = x.m AND cc.j = y.m GROUP BY ALL)
SELECT i, j, round(l1.l + l2.l - now.l, 1) + 0.0 AS loss FROM l1 JOIN l2 USING (i, j), now""")
def merge_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    movie, grid, traces = event_traces(spark, sf_dir)
    return products.merge_loss(movie.rows, grid, traces).select("i", "j", r("loss", 1))


MOMENTS = """mo AS (SELECT cell, avg(r) x1, avg(r ** 2) x2, avg(r ** 3) x3, avg(r ** 4) x4 FROM tr GROUP BY cell), ce AS (
  SELECT cell, nullif(x2 - x1 * x1, 0) AS v, x3 - 3 * x1 * x2 + 2 * x1 ** 3 AS m3, x4 - 4 * x1 * x3 + 6 * x1 * x1 * x2 - 3 * x1 ** 4 AS m4 FROM mo)"""


@query(f"WITH {TRACES}, {MOMENTS} SELECT cell, round(m4 / v ** 2, 6) + 0.0 AS kurtosis FROM ce")
def trace_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_traces(spark, sf_dir)[2].groupBy("cell").agg(rounded(F.kurtosis("r") + 3).alias("kurtosis"))


@query(f"WITH {TRACES}, {MOMENTS} SELECT cell, round(m3 ** 2 / v ** 3 / 12 + (m4 / v ** 2 - 3) ** 2 / 48, 6) + 0.0 AS negentropy FROM ce")
def trace_negentropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_traces(spark, sf_dir)[2].groupBy("cell").agg(rounded(negentropy_of("r")).alias("negentropy"))


@query(f"""WITH {FEET} SELECT cell, (SELECT count(*) FROM embeddings)::BIGINT AS n, 0.0::DOUBLE AS r, 0.0::DOUBLE AS c, 0.0::DOUBLE AS s, 0.8::DOUBLE AS gamma, 50.0::DOUBLE AS "lambda"
FROM feet GROUP BY cell""")
def zero_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traces zero: every cell and frame of a movie, with the parameters of the start."""
    cells = movies.event_footprints(spark, sf_dir).select("cell").distinct()
    traces = cells.join(movies.embedding_movie(spark, sf_dir).packed.select("frame"), F.lit(True)).withColumns({n: F.lit(0.0) for n in ("r", "c", "s")})
    sums = traces.groupBy("cell").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in ("r", "c", "s")))
    return sums.withColumns({"gamma": F.lit(0.8), "lambda": F.lit(50.0)})


# Backgrounds


@query(f"""WITH {MODEL} SELECT 'static' AS model, 0 AS video_id, px, round(b, 6) + 0.0 AS b FROM bs
UNION ALL SELECT 'per_video', video_id, px, round(b, 6) + 0.0 FROM b0 UNION ALL SELECT 'rank_one', video_id, px, round(b, 6) + 0.0 FROM b1""")
def init_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    parts = [("static", Static.start(m.rows, FRAMES).table.withColumn("video_id", F.lit(0))), ("per_video", m.b0.table), ("rank_one", m.b1.table)]
    out = [t.select(F.lit(n).alias("model"), "video_id", "px", r("b")) for n, t in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {MODEL} SELECT video_id, px, round(b, 6) + 0.0 AS b FROM b1")
def rank1_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    movie = movies.event_movie(spark, sf_dir)
    frames = movie.rows.select("video_id", "frame").distinct()
    return RankOne.start(movie.pixels(), frames, movies.grid_footprints(spark)).table.select("video_id", "px", r("b"))


@query(f"WITH {MODEL} SELECT video_id, px, round(x, 6) + 0.0 AS x FROM x0")
def bg_pixel_interaction_b0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backgrounds.interaction_b0(event_model(spark, sf_dir).b1).select("video_id", "px", r("x"))


@query(f"WITH {MODEL} SELECT video_id, px, round(b0.b * sf, 6) + 0.0 AS x FROM b0 JOIN sf USING (video_id)")
def bg_pixel_interaction_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return backgrounds.interaction_b1(m.b1, m.b0).select("video_id", "px", r("x"))


@query(f"WITH {MODEL} SELECT video_id, px, round(bs.b * sf, 6) + 0.0 AS x FROM bs, sf")
def bg_pixel_interaction_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return backgrounds.interaction_b1(m.b1, Static.start(m.rows, FRAMES)).select("video_id", "px", r("x"))


@query(f"WITH {MODEL} SELECT video_id, round(x, 6) + 0.0 AS x FROM dots")
def bg_trace_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return backgrounds.interaction_f(m.b1, m.b0).select("video_id", r("x"))


@query(f"WITH {MODEL} SELECT video_id, round(sum(b1.b * bs.b), 6) + 0.0 AS x FROM b1 JOIN bs USING (px) GROUP BY ALL")
def bg_trace_interaction_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return backgrounds.interaction_f(m.b1, Static.start(m.rows, FRAMES)).select("video_id", r("x"))


@query(f"""WITH {MODEL} SELECT b0.px, cell, round(sum(b0.b * s), 2) + 0.0 AS x
FROM b0 JOIN (SELECT video_id, cell, sum(c) AS s FROM tr GROUP BY ALL) USING (video_id) GROUP BY ALL""")
def bg_pixel_correction_b0(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return m.b0.pixel_correction(m.traces).select("px", "cell", r("x", 2))


@query(f"""WITH {MODEL}, ab AS (SELECT video_id, cell, sum(w * b) AS ab FROM grid JOIN b0 USING (px) GROUP BY ALL)
SELECT frame, cell, round(ab, 6) + 0.0 AS x FROM ab JOIN f USING (video_id)""")
def bg_trace_correction_b0(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return m.b0.trace_correction(m.footprints, m.frames).select("frame", "cell", r("x"))


@query(f"WITH {MODEL} SELECT video_id, px, round(b, 6) + 0.0 AS b FROM b0n")
def bg_update_b0(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return m.b0.update(m.footprints, m.traces, m.b1, FRAMES).table.select("video_id", "px", r("b"))


@query(f"WITH {MODEL} SELECT b1.px, cell, round(sum(b1.b * s), 2) + 0.0 AS x FROM b1 JOIN cf USING (video_id) GROUP BY ALL")
def bg_pixel_correction_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return m.b1.pixel_correction(m.traces).select("px", "cell", r("x", 2))


@query(f"WITH {MODEL} SELECT video_id, px, round(raw_b, 2) + 0.0 AS raw_b FROM rawb")
def rank1_raw_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return m.b1.raw_images(m.rows).select("video_id", "px", r("raw_b", 2))


@query(f"WITH {MODEL} SELECT video_id, px, round(b, 6) + 0.0 AS b FROM b1n")
def bg_update_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_model(spark, sf_dir).updated()[1].table.select("video_id", "px", r("b"))


@query(f"WITH {MODEL} SELECT video_id, frame, round(raw_f, 6) + 0.0 AS raw_f FROM rawf")
def rank1_raw_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return m.b1.raw_trace(m.rows).select("video_id", "frame", r("raw_f"))


@query(f"""WITH {MODEL}, ab AS (SELECT video_id, cell, sum(w * b) AS ab FROM grid JOIN b1n USING (px) GROUP BY ALL)
SELECT frame, cell, round(f * ab, 6) + 0.0 AS x FROM f JOIN ab USING (video_id)""")
def bg_trace_correction_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return m.updated()[1].trace_correction(m.footprints, m.frames).select("frame", "cell", r("x"))


@query(f"""WITH {MODEL}, ab AS (SELECT video_id, cell, sum(w * b) AS ab FROM grid JOIN b1n USING (px) GROUP BY ALL),
t AS (SELECT frame, sum(c * ab) AS t FROM tr JOIN ab USING (video_id, cell) GROUP BY ALL),
rf AS (SELECT ev.video_id, frame, sum(value * b) AS raw FROM ev JOIN b1n USING (video_id, px) GROUP BY ALL),
d AS (SELECT video_id, sum(b1n.b * b0n.b) AS x FROM b1n JOIN b0n USING (video_id, px) GROUP BY ALL)
SELECT video_id, frame, round(raw - coalesce(t, 0) - x, 6) + 0.0 AS f FROM rf LEFT JOIN t USING (frame) JOIN d USING (video_id)""")
def bg_update_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    b0, b1 = m.updated()
    b1 = RankOne(saved(b1.table, "b1"), b1.trace)
    return b1.update_trace(m.rows, m.footprints, m.traces, b0).trace.select("video_id", "frame", r("f"))


@query(f"WITH {MODEL} SELECT bs.px, cell, round(b * s, 2) + 0.0 AS x FROM bs, (SELECT cell, sum(c) AS s FROM tr GROUP BY ALL)")
def static_pixel_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return Static.start(m.rows, FRAMES).pixel_correction(m.traces).select("px", "cell", r("x", 2))


@query(f"WITH {MODEL} SELECT cell, round(sum(w * b), 6) + 0.0 AS x FROM grid JOIN bs USING (px) GROUP BY cell")
def static_trace_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return Static.start(m.rows, FRAMES).trace_correction(m.footprints, m.frames).select("cell", r("x"))


@query(f"""WITH {MODEL}, e AS (SELECT px, sum(w * s) AS e FROM grid JOIN (SELECT cell, sum(c) AS s FROM tr GROUP BY ALL) USING (cell) GROUP BY ALL)
SELECT bs.px, round(b - coalesce(e, 0) / 720, 6) + 0.0 AS b FROM bs LEFT JOIN e USING (px)""")
def static_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return Static.start(m.rows, FRAMES).update(m.footprints, m.traces, FRAMES).table.select("px", r("b"))


# Frames

FRAME_MODEL = f"""{MODEL}, x AS (SELECT frame, px, sum(c * w) AS x FROM tr JOIN grid USING (cell) GROUP BY ALL),
rc AS (SELECT ev.frame, ev.px, ev.value AS y, coalesce(x, 0) AS x, b0.b + coalesce(b1.b * f, 0) AS bg
  FROM ev LEFT JOIN x USING (frame, px) JOIN b0 USING (video_id, px) LEFT JOIN b1 USING (video_id, px) JOIN f ON f.frame = ev.frame WHERE ev.frame IN (100, 500))"""
SHOWN = "frame IN (100, 500)"


@query(f"WITH {FRAME_MODEL} SELECT frame, px, round(x + bg, 6) + 0.0 AS value FROM rc")
def reconstruct_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return views.reconstruct(m.movie.pixels(), m.frames.where(SHOWN), m.footprints, m.traces, [m.b0, m.b1]).select("frame", "px", r("value"))


@query(f"WITH {FRAME_MODEL} SELECT frame, px, round(y - x - bg, 6) + 0.0 AS value FROM rc")
def residual_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    shown = views.reconstruct(m.movie.pixels(), m.frames.where(SHOWN), m.footprints, m.traces, [m.b0, m.b1])
    return views.residual(m.rows.where(SHOWN), shown).select("frame", "px", r("value"))


@query(f"WITH {FRAME_MODEL} SELECT frame, px, round(y - bg, 6) + 0.0 AS value FROM rc")
def bg_subtracted_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return views.bg_subtracted(m.movie.pixels(), m.rows.where(SHOWN), m.frames.where(SHOWN), [m.b0, m.b1]).select("frame", "px", r("value"))


# Sweeps


def trace_inputs(m: EventModel) -> DataFrame:
    """Projections less the per-video background, with traces of zero."""
    taken = m.b0.trace_correction(m.footprints, m.frames)
    x = m.traces.join(taken, ["frame", "cell"]).select("frame", "cell", (F.col("r") - F.col("x")).alias("x"))
    return x.withColumn("c", F.lit(0.0))


def trace_sweep_sql() -> str:
    """The sweep written out cell by cell: each step reads the cells before it."""
    steps = []
    for j in CELLS:
        less = "".join(f" - coalesce((SELECT g FROM aa WHERE i = {j} AND j = {k}), 0) * c{k}" for k in range(1, j))
        before = "x0t" if j == 1 else f"t{j - 1}"
        steps.append(f"u{j} AS (SELECT *, x{j}{less} AS r{j} FROM {before}), t{j} AS MATERIALIZED (SELECT *, greatest(r{j}, 0) AS c{j} FROM u{j})")
    columns = ", ".join(f"sum(CASE WHEN cell = {j} THEN r - ab END) AS x{j}" for j in CELLS)
    out = " UNION ALL ".join(f"SELECT frame, {j} AS cell, round(r{j}, 6) + 0.0 AS r, round(c{j}, 6) + 0.0 AS c FROM t9" for j in CELLS)
    return f"""WITH {MODEL}, ab AS (SELECT video_id, cell, sum(w * b) AS ab FROM grid JOIN b0 USING (px) GROUP BY ALL),
aa AS MATERIALIZED (SELECT a.cell AS i, b.cell AS j, sum(a.w * b.w) AS g FROM grid a JOIN grid b USING (px) GROUP BY ALL),
x0t AS MATERIALIZED (SELECT frame, {columns} FROM tr JOIN ab USING (video_id, cell) GROUP BY frame), {", ".join(steps)} {out}"""


@query(trace_sweep_sql())
def hals_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    return sweeps.unpacked(sweeps.trace_sweep(trace_inputs(m), m.footprints, frames_per_task=240)).select("frame", "cell", r("r"), r("c"))


def oasis_sweep_sql() -> str:
    """The sweep written out cell by cell, each with its deconvolution: a cell reads the traces of the cells before it."""
    steps = []
    for j in CELLS:
        less = "".join(f" - coalesce((SELECT g FROM aa WHERE i = {j} AND j = {k}), 0) * c{k}.c" for k in range(1, j))
        joins = "".join(f" JOIN t{k}_fit c{k} ON c{k}.frame = x.frame" for k in range(1, j))
        raw = f"SELECT list(r ORDER BY frame) AS y FROM (SELECT x.frame, x.x{less} AS r FROM xs x{joins} WHERE x.cell = {j})"
        steps.append(pools_sql(f"t{j}", f"SELECT {j} AS key, 0.8::DOUBLE AS gamma, {penalised('y', '0.8::DOUBLE', '2.0::DOUBLE')} AS x FROM ({raw})"))
    out = " UNION ALL ".join(f"SELECT frame, {j} AS cell, round(c, 6) + 0.0 AS c, round(s, 6) + 0.0 AS s FROM t{j}_fit" for j in CELLS)
    return f"""WITH RECURSIVE {MODEL}, ab AS (SELECT video_id, cell, sum(w * b) AS ab FROM grid JOIN b0 USING (px) GROUP BY ALL),
aa AS MATERIALIZED (SELECT a.cell AS i, b.cell AS j, sum(a.w * b.w) AS g FROM grid a JOIN grid b USING (px) GROUP BY ALL),
xs AS MATERIALIZED (SELECT frame, cell, r - ab AS x FROM tr JOIN ab USING (video_id, cell)), {", ".join(steps)} {out}"""


@query(oasis_sweep_sql())
def hals_traces_oasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep with a deconvolution of whole traces."""
    m = event_model(spark, sf_dir)
    cells = m.footprints.select("cell").distinct().select("cell", F.lit(0.8).alias("gamma"), F.lit(2.0).alias("lambda"))
    packed = sweeps.trace_sweep(trace_inputs(m), m.footprints, sweeps.oasis_fixed, cells, None)
    return sweeps.unpacked(packed).select("frame", "cell", r("c"), r("s"))


def footprint_sums(m: EventModel) -> DataFrame:
    yc = products.project_footprints_masked(movies.frame_arrays(m.movie), m.traces, sweeps.dilated(m.footprints, 8, 8))
    taken = m.b0.pixel_correction(m.traces)
    return yc.join(taken, ["px", "cell"]).select("px", "cell", (F.col("yc") - F.col("x")).alias("v"))


def footprint_sweep_ctes() -> str:
    """The sweep written out cell by cell over the pixels."""
    steps = []
    for j in CELLS:
        now = "".join(f" - (SELECT g FROM cc WHERE i = {j} AND j = {k}) * {'n' if k < j else 'a'}{k}" for k in CELLS if k != j)
        before = "p0" if j == 1 else f"q{j - 1}"
        steps.append(f"h{j} AS (SELECT *, greatest(v{j}{now}, 0) * m{j} AS z{j} FROM {before}), q{j} AS MATERIALIZED (SELECT *, z{j} / (sqrt(sum(z{j} * z{j}) OVER ()) + 1e-10) AS n{j} FROM h{j})")
    columns = ", ".join(f"max(CASE WHEN s.cell = {j} THEN s.v END) AS v{j}, coalesce(max(CASE WHEN s.cell = {j} THEN g.w END), 0) AS a{j}, coalesce(max(CASE WHEN k.cell = {j} THEN 1 END), 0) AS m{j}" for j in CELLS)
    out = " UNION ALL ".join(f"SELECT {j} AS cell, px, n{j} AS w FROM q9 WHERE n{j} > 0" for j in CELLS)
    return f"""{MODEL}, cc AS MATERIALIZED (SELECT a.cell AS i, b.cell AS j, sum(a.c * b.c) AS g FROM tr a JOIN tr b USING (frame) GROUP BY ALL),
sums AS (SELECT y.px, y.cell, yc - x AS v FROM (SELECT ev.px, tr.cell, sum(value * c) AS yc FROM ev JOIN tr USING (frame) GROUP BY ALL) y
  JOIN (SELECT px, cell, sum(b0.b * s) AS x FROM b0 JOIN (SELECT video_id, cell, sum(c) AS s FROM tr GROUP BY ALL) USING (video_id) GROUP BY ALL) x USING (px, cell)),
mask AS (SELECT DISTINCT cell, px + a + 8 * b AS px FROM grid, range(-1, 2) x(a), range(-1, 2) y(b) WHERE px % 8 + a BETWEEN 0 AND 7 AND px // 8 + b BETWEEN 0 AND 7),
p0 AS MATERIALIZED (SELECT s.px, {columns} FROM sums s LEFT JOIN grid g ON g.cell = s.cell AND g.px = s.px LEFT JOIN mask k ON k.cell = s.cell AND k.px = s.px GROUP BY s.px),
{", ".join(steps)}, swept AS ({out})"""


@query(f"WITH {footprint_sweep_ctes()} SELECT cell, px, round(w, 6) + 0.0 AS w FROM swept")
def hals_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = event_model(spark, sf_dir)
    new = sweeps.footprint_sweep(footprint_sums(m), m.footprints, m.traces, 8, 8)
    return new.select("cell", "px", r("w"))


@query(f"WITH {TRACES} SELECT cell, count(*) AS n, round(sum(c), 6) + 0.0 AS total FROM tr WHERE cell IN (SELECT cell FROM grid WHERE cell % 4 <> 1) GROUP BY cell")
def drop_empty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of cells whose footprints still have weights (every fourth is emptied here)."""
    _, grid, traces = event_traces(spark, sf_dir)
    emptied = grid.withColumn("w", F.when(F.col("cell") % 4 == 1, 0.0).otherwise(F.col("w")))
    return sweeps.drop_empty(traces, emptied).groupBy("cell").agg(F.count("*").alias("n"), rounded(F.sum("c")).alias("total"))


@query(f"""WITH {FEET} SELECT DISTINCT cell, (px + a + 8 * b)::INTEGER AS px FROM feet, range(-1, 2) x(a), range(-1, 2) y(b)
WHERE px % 8 + a BETWEEN 0 AND 7 AND px // 8 + b BETWEEN 0 AND 7""")
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.dilated(movies.event_footprints(spark, sf_dir), 8, 8)


# Merging

AGREE = 0.2
EDGES = f"{CORR}, ed AS (SELECT i, j, g AS overlap, corr FROM cr JOIN (SELECT a.cell AS i, b.cell AS j, sum(a.w * b.w) AS g FROM grid a JOIN grid b USING (px) GROUP BY ALL) USING (i, j) WHERE g > 0 AND corr > {AGREE})"


@query(f"WITH {TRACES}, {EDGES} SELECT i, j, round(overlap, 6) + 0.0 AS overlap, round(corr, 6) + 0.0 AS corr FROM ed")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, grid, traces = event_traces(spark, sf_dir)
    return merging.candidates(grid, traces, AGREE).select("i", "j", r("overlap"), r("corr"))


def merge_sql() -> str:
    steps = ["h0 AS (SELECT DISTINCT cell, NULL::INTEGER AS head FROM grid)"]
    steps += [
        f"h{k} AS (SELECT cell, CASE WHEN head IS NULL AND cell IN (SELECT j FROM ed WHERE i = {k}) AND (SELECT head FROM h{k - 1} WHERE cell = {k}) IS NULL THEN {k} ELSE head END AS head FROM h{k - 1})"
        for k in CELLS
    ]
    return f"""WITH {TRACES}, {EDGES}, {", ".join(steps)} SELECT coalesce(head, h9.cell) AS cell, count(DISTINCT h9.cell) AS members, round(sum(c), 6) + 0.0 AS total
FROM h9 JOIN tr USING (cell) GROUP BY ALL"""


@query(merge_sql())
def merge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of cells that agree: members and the sum of their joint trace."""
    _, grid, traces = event_traces(spark, sf_dir)
    _, joint, heads = merging.merge(grid, traces, ("c",), AGREE)
    members = heads.groupBy(F.col("head").alias("cell")).agg(F.count("*").alias("members"))
    return joint.groupBy("cell").agg(rounded(F.sum("c")).alias("total")).join(members, "cell")


# Views


@query(f"WITH {FEET} SELECT cell, first(px ORDER BY w DESC, px) AS px, round(max(w), 6) + 0.0 AS w FROM feet GROUP BY cell HAVING sum(w * w) >= 0.99")
def roi_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.roi_peaks(movies.event_footprints(spark, sf_dir)).select("cell", "px", r("w"))


def composite_sql() -> str:
    """The layers painted one by one; a pixel is as opaque as its share of the cell's greatest weight."""
    steps = ["shares AS (SELECT cell, px, w / max(w) OVER (PARTITION BY cell) AS o FROM feet)", "k0 AS (SELECT px::INTEGER AS px, 0.0::DOUBLE AS red, 0.0::DOUBLE AS green, 0.0::DOUBLE AS blue FROM range(64) t(px))"]
    for k in CELLS:
        mixed = ", ".join(f"{n} * (1 - coalesce(o, 0)) + {v} * coalesce(o, 0) AS {n}" for n, v in (("red", k / 10), ("green", 1 - k / 10), ("blue", 0.5)))
        steps.append(f"k{k} AS (SELECT k.px, {mixed} FROM k{k - 1} k LEFT JOIN (SELECT px, o FROM shares WHERE cell = {k}) g USING (px))")
    return f"WITH {FEET}, {', '.join(steps)} SELECT px, round(red, 6) + 0.0 AS red, round(green, 6) + 0.0 AS green, round(blue, 6) + 0.0 AS blue FROM k9"


@query(composite_sql())
def roi_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = movies.event_footprints(spark, sf_dir)
    k = F.col("cell") / 10
    colours = feet.select("cell").distinct().select("cell", k.alias("red"), (1 - k).alias("green"), F.lit(0.5).alias("blue"))
    pixels = spark.range(64).select(F.col("id").cast("int").alias("px"))
    return views.roi_composite(feet, colours, pixels).select("px", r("red"), r("green"), r("blue"))


@query(f"WITH {FEET} SELECT p.px::INTEGER AS px, first(cell ORDER BY w DESC, cell) AS cell FROM range(64) p(px) LEFT JOIN feet ON feet.px = p.px GROUP BY ALL")
def roi_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.roi_labels(movies.event_footprints(spark, sf_dir), spark.range(64).select(F.col("id").cast("int").alias("px")))


@query(f"""WITH {TRACES}, o AS (SELECT frame, c FROM tr WHERE cell = 1), k AS (SELECT frame AS peak FROM o ORDER BY c DESC, frame LIMIT 1)
SELECT frame, round(c, 6) + 0.0 AS value FROM o, k WHERE abs(frame / 20.0 - peak / 20.0) <= 10""")
def trace_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.trace_zoom(event_traces(spark, sf_dir)[2], 1).select("frame", r("value"))


@query(f"WITH {TRACES} SELECT cell, frame, round(r - 200.0 * cell, 6) + 0.0 AS y FROM tr")
def stacked_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stacked_traces(event_traces(spark, sf_dir)[2]).select("cell", "frame", r("y"))
