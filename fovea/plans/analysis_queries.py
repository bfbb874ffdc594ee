"""Queries on deconvolution, segmentation, registration and the whole analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.functions import deconvolution
from fovea.functions.columns import rounded
from fovea.operators import folds, motion, segmentation, sweeps, views
from fovea.plans.ctes import EMB, MODEL, NOISY, TRACES, penalised, pools_sql
from fovea.plans.model_queries import event_model, event_traces
from fovea.plans.movie_queries import SEGMENTS, r
from fovea.plans.registry import query
from fovea.session import Session
from fovea.sources import movies, synthetic


def packed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, y): whole traces as arrays."""
    traces = event_traces(spark, sf_dir)[2]
    packed = traces.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("frame", "r"))).alias("t"))
    return packed.select("cell", F.col("t.r").alias("y"))


def deconvolved(traces: DataFrame, gamma: float, lam: float, rule: str = "undamped") -> DataFrame:
    """(cell, frame, c, s), one trace a group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c, s = deconvolution.oasis(np.asarray(rows["y"].iloc[0]), gamma, lam, rule)
        return pd.DataFrame({"cell": rows["cell"].iloc[0], "frame": np.arange(1, len(c) + 1), "c": c, "s": s})

    return traces.groupBy("cell").applyInPandas(run, "cell int, frame long, c double, s double")


OASIS_SQL = f"""WITH RECURSIVE {TRACES}, y AS (SELECT cell, list(r ORDER BY frame) AS y FROM tr GROUP BY cell),
{pools_sql("p", f"SELECT cell AS key, 0.8::DOUBLE AS gamma, {penalised('y', '0.8::DOUBLE', '2.0::DOUBLE')} AS x FROM y")}, spikes AS (SELECT key AS cell, frame, c, s FROM p_fit)"""


@query(f"{OASIS_SQL} SELECT cell, frame, round(c, 6) + 0.0 AS c FROM spikes")
def oasis_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deconvolved(packed_traces(spark, sf_dir), 0.8, 2.0).select("cell", "frame", r("c"))


@query(f"{OASIS_SQL} SELECT cell, frame, round(s, 6) + 0.0 AS s FROM spikes")
def oasis_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deconvolved(packed_traces(spark, sf_dir), 0.8, 2.0).select("cell", "frame", r("s"))


@query()
def oasis_opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen parameters of each trace, and the loss before and after."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = np.asarray(rows["y"].iloc[0])
        c0, _ = deconvolution.oasis(y, 0.8, 50.0)
        c, _, gamma, lam = deconvolution.fitted(y, 0.8, 50.0)
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "gamma": [gamma], "lambda": [lam], "before": [deconvolution.negentropy(c0 - y)], "after": [deconvolution.negentropy(c - y)]})

    out = packed_traces(spark, sf_dir).groupBy("cell").applyInPandas(run, "cell int, gamma double, lambda double, before double, after double")
    return out.select("cell", r("gamma"), r("lambda"), r("before"), r("after"))


def noisy_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, y, c, s): traces that decay after the spikes of ``events``, with noise from ``embeddings``, and the truth."""
    packed = movies.event_spikes(spark, sf_dir).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("frame", "s"))).alias("t")).select("cell", F.col("t.s").alias("s"))
    truth = packed.withColumn("c", synthetic.ar1(F.col("s"), 0.9))
    long = truth.select("cell", F.posexplode("c").alias("k", "v"))
    noisy = movies.vector_noise(spark, sf_dir, long, F.col("k") % 64 + 1, F.col("k") * movies.CELLS + F.col("cell"))
    y = noisy.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("v") + 0.3 * F.col("z")).alias("y")))).alias("t"))
    return truth.join(y.select("cell", F.col("t.y").alias("y")), "cell").select("cell", "y", "c", "s")


GRID_SCHEMA = "cell int, gamma double, lambda double, sse double, error double, kurtosis double, negentropy double, corr_c double, corr_s double"


def sweep_grid(traces: DataFrame, gammas: list[float], lambdas: list[float]) -> DataFrame:
    """Fit quality by trace and pair of parameters; each pair of a trace is a group of its own."""
    pairs = F.array(*(F.struct(F.lit(g).alias("gamma"), F.lit(x).alias("lambda")) for g in gammas for x in lambdas))
    tried = traces.withColumn("p", F.explode(pairs)).select("cell", "y", "c", "s", "p.gamma", "p.lambda")

    def corr(a: np.ndarray, b: np.ndarray) -> float:
        return float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else 0.0

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            y, c0, s0 = (np.asarray(x, float) for x in (row.y, row.c, row.s))
            gamma, lam = row[4], row[5]
            c, s = deconvolution.oasis(y, gamma, lam)
            d = c - y
            z = d - d.mean()
            kurt = float((z**4).mean() / (z * z).mean() ** 2) if z.any() else 0.0
            out.append((row.cell, gamma, lam, float((d * d).sum()), float(((c - c0) ** 2).sum()), kurt, deconvolution.negentropy(d), corr(c, c0), corr(s, s0)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in GRID_SCHEMA.split(", ")])

    found = tried.groupBy("cell", "gamma", "lambda").applyInPandas(run, GRID_SCHEMA)
    return found.select("cell", "gamma", "lambda", *(r(n, 4) for n in ("sse", "error", "kurtosis", "negentropy", "corr_c", "corr_s")))


def grid_sql(gammas: list[float], lambdas: list[float]) -> str:
    source = f"""SELECT {{'cell': cell, 'gamma': g, 'lambda': l}} AS key, g AS gamma, {penalised("y", "g", "l")} AS x
FROM (SELECT cell, list(y ORDER BY frame) AS y FROM noisy GROUP BY cell), (SELECT unnest({gammas}::DOUBLE[]) AS g), (SELECT unnest({lambdas}::DOUBLE[]) AS l)"""
    corr = "coalesce(CASE WHEN stddev_pop(c.{0}) > 1e-9 AND stddev_pop(t.{0}) > 1e-9 THEN corr(c.{0}, t.{0}) END, 0)"
    return f"""WITH RECURSIVE {NOISY}, {pools_sql("p", source)}, c AS (SELECT key, key.cell AS cell, frame, c, s FROM p_fit),
d AS (SELECT key, c.c - y AS d, c.c - y - avg(c.c - y) OVER (PARTITION BY key) AS z FROM c JOIN noisy USING (cell, frame)),
m AS (SELECT key, sum(d * d) AS sse, avg(z ** 2) AS m2, avg(z ** 3) AS m3, avg(z ** 4) AS m4 FROM d GROUP BY key),
t AS (SELECT key, sum((c.c - t.c) ** 2) AS error, {corr.format("c")} AS corr_c, {corr.format("s")} AS corr_s FROM c JOIN noisy t USING (cell, frame) GROUP BY key)
SELECT key.cell AS cell, key.gamma AS gamma, key."lambda" AS "lambda", round(sse, 4) + 0.0 AS sse, round(error, 4) + 0.0 AS error, round(m4 / m2 ** 2, 4) + 0.0 AS kurtosis,
  round(m3 ** 2 / m2 ** 3 / 12 + (m4 / m2 ** 2 - 3) ** 2 / 48, 4) + 0.0 AS negentropy, round(corr_c, 4) + 0.0 AS corr_c, round(corr_s, 4) + 0.0 AS corr_s FROM m JOIN t USING (key)"""


LAMBDAS, GAMMA_GRID = [k / 4 for k in range(21)], ([0.8, 0.85, 0.9, 0.95], [k / 2 for k in range(7)])


@query(grid_sql([0.9], LAMBDAS))
def lambda_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep_grid(noisy_traces(spark, sf_dir), [0.9], LAMBDAS)


@query(grid_sql(*GAMMA_GRID))
def gamma_lambda_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep_grid(noisy_traces(spark, sf_dir), *GAMMA_GRID)


@query(f"""WITH {TRACES}, y AS (SELECT cell, y, greatest(2, len(y) // 8) AS n FROM (SELECT cell, list(r ORDER BY frame) AS y FROM tr GROUP BY cell)),
parts AS (SELECT *, unnest(range(0, len(y) - n + 1, n - n // 2)) AS a FROM y), samples AS (SELECT cell, n, a, i, y[a + i + 1] AS v FROM (SELECT *, unnest(range(n)) AS i FROM parts)),
waves AS (SELECT cell, n, a, k, sum(v * cos(2 * pi() * k * i / n)) AS x, sum(v * sin(2 * pi() * k * i / n)) AS y
  FROM (SELECT *, unnest(range(n // 2 + 1)) AS k FROM samples) GROUP BY cell, n, a, k),
power AS (SELECT cell, n, k, avg((x * x + y * y) / n) AS p FROM waves GROUP BY cell, n, k),
sided AS (SELECT cell, CASE WHEN k BETWEEN 1 AND (n + 1) // 2 - 1 THEN 2 * p ELSE p END AS p FROM power WHERE k::DOUBLE / n > 0.25)
SELECT cell, round(sqrt(avg(p) / 2), 6) + 0.0 AS sigma FROM sided GROUP BY cell""")
def noise_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": rows["cell"], "sigma": [deconvolution.noise_sigma(np.asarray(y)) for y in rows["y"]]})

    return packed_traces(spark, sf_dir).groupBy("cell").applyInPandas(run, "cell int, sigma double").select("cell", r("sigma"))


# Regions

VIDEO_IMAGE = """moments AS (SELECT video_id, px, avg(value) x1, avg(value ** 2) x2, avg(value ** 3) x3, avg(value ** 4) x4 FROM emb GROUP BY ALL), summary AS (
  SELECT px, avg((x3 - 3 * x1 * x2 + 2 * x1 ** 3) ** 2 / (x2 - x1 * x1) ** 3 / 12 + ((x4 - 4 * x1 * x3 + 6 * x1 * x1 * x2 - 3 * x1 ** 4) / (x2 - x1 * x1) ** 2 - 3) / 48) AS v FROM moments GROUP BY px)"""


def regions_sql(image: str, seeds: str, edge: str) -> str:
    """Regions on an 8 x 8 frame as a recursion over pixels: each step takes one more pixel into the region under way, or opens one at the next seed.

    ``image``: one row of lists by pixel, ``v`` and what ``edge`` reads, and
    ``ord``, the pixels in the order of seeds. ``seeds`` is a condition on a
    pixel s, ``edge`` one on a free pixel q beside a pixel p of the region that
    began at ``seed``. Gives found (px, label).
    """
    free = f"""list_filter(range(64), lambda q: cur > 0 AND lab[q + 1] = 0 AND len(list_filter([q + 1, q - 1, q + 8, q - 8],
      lambda p: p BETWEEN 0 AND 63 AND abs(p % 8 - q % 8) <= 1 AND lab[p + 1] = cur AND {edge})) > 0)[1]"""
    return f"""img AS MATERIALIZED ({image}), grown AS (
  SELECT 0 AS step, list_transform(range(64), lambda i: 0) AS lab, 0 AS cur, -1::BIGINT AS seed
  UNION ALL
  SELECT step + 1, list_transform(lab, lambda l, i: CASE WHEN i = coalesce(q, s) + 1 THEN CASE WHEN q IS NULL THEN cur + 1 ELSE cur END ELSE l END),
    CASE WHEN q IS NULL THEN cur + 1 ELSE cur END, CASE WHEN q IS NULL THEN s ELSE seed END
  FROM (SELECT grown.*, {free} AS q, list_filter(ord, lambda s: lab[s + 1] = 0 AND {seeds})[1] AS s FROM grown, img) WHERE q IS NOT NULL OR s IS NOT NULL
), found AS (SELECT unnest(range(64)) AS px, unnest(lab) AS label FROM grown ORDER BY step DESC LIMIT 64)"""


IMAGE_ROW = "SELECT list(v ORDER BY px) AS v, (SELECT list(px::BIGINT ORDER BY v DESC, px) FROM summary) AS ord FROM summary"
UNIT = """members AS (SELECT label, found.px::INTEGER AS px, greatest(v, 0) AS w FROM found JOIN summary USING (px) WHERE label > 0 AND v > 0)
SELECT dense_rank() OVER (ORDER BY label)::INTEGER AS cell, px, round(w / sqrt(sum(w * w) OVER (PARTITION BY label)), 6) + 0.0 AS w FROM members"""


def summary_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.negentropy_per_video(movies.embedding_movie(spark, sf_dir).rows)


def flood_sql(images: str, min_size: int, sens: float, min_n: int) -> str:
    """Clusters of 8 x 8 images as a recursion over pixels, then over clusters: each one stands out of the pool of those below it, or joins the pool.

    ``images``: (image, px, v). A pixel joins the largest cluster beside it,
    the first in the order of neighbours, which takes in the small ones there.
    The tail of chi-square is one less the series of its lower part.
    """
    near = """list_filter(list_transform(list_filter([p + 8, p - 8, p + 1, p - 1], lambda q: q BETWEEN 0 AND 63 AND abs(q % 8 - p % 8) <= 1), lambda q: lab[q + 1]), lambda l: l > 0)"""
    tail = "1 - list_sum(list_transform(range(2000), lambda i: exp((n / 2.0 + i) * ln(x / 2) - x / 2 - lgamma(n / 2.0 + i + 1))))"
    return f"""imgs AS MATERIALIZED ({images}), img AS MATERIALIZED (SELECT image, list(px::BIGINT ORDER BY v DESC, px) AS ord FROM imgs GROUP BY image), flood AS (
  SELECT image, 0 AS step, list_transform(range(64), lambda i: 0) AS lab FROM img
  UNION ALL
  SELECT image, step + 1, list_transform(lab, lambda l, i: CASE WHEN i = p + 1 THEN coalesce(best, step + 1)
    WHEN l > 0 AND l <> best AND list_contains(near, l) AND sizes[list_position(near, l)] < {min_size} THEN best ELSE l END)
  FROM (SELECT *, near[list_position(sizes, list_max(sizes))] AS best FROM (SELECT *, list_transform(near, lambda k: len(list_filter(lab, lambda l: l = k))) AS sizes FROM (
    SELECT *, {near} AS near FROM (SELECT flood.*, ord[step + 1] AS p FROM flood JOIN img USING (image) WHERE step < 64))))
), labels AS (SELECT image, unnest(range(64))::INTEGER AS px, unnest(lab) AS label FROM flood WHERE step = 64
), sized AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY image, label) >= {min_size} THEN label ELSE 0 END AS own FROM labels
), groups AS MATERIALIZED (
  SELECT image, own, sum(v) AS gs, sum(v * v) AS gss, count(*) AS n, row_number() OVER (PARTITION BY image ORDER BY avg(v * v), own) AS k FROM sized JOIN imgs USING (image, px) GROUP BY image, own
), pool AS (
  SELECT image, 0::BIGINT AS k, 0.0::DOUBLE AS s, 0.0::DOUBLE AS ss, 0::HUGEINT AS m, false AS keep FROM img
  UNION ALL
  SELECT image, k, CASE WHEN keep THEN s ELSE s + gs END, CASE WHEN keep THEN ss ELSE ss + gss END, CASE WHEN keep THEN m ELSE m + n END, keep
  FROM (SELECT *, coalesce(m > {min_n} AND var > 0 AND x > 0 AND {tail} < exp(-{sens}::DOUBLE), false) AS keep FROM (SELECT *, (gss - 2 * mean * gs + n * mean * mean) / nullif(var, 0) AS x FROM (
    SELECT g.*, s, ss, m, s / nullif(m, 0) AS mean, ss / nullif(m, 0) - (s / nullif(m, 0)) ** 2 AS var FROM pool JOIN groups g ON g.image = pool.image AND g.k = pool.k + 1)))
), kept AS (SELECT image, own, row_number() OVER (PARTITION BY image ORDER BY k)::INTEGER AS cell FROM pool JOIN groups USING (image, k) WHERE keep
), weights AS (SELECT image, cell, px, greatest(v, 0) AS w FROM sized JOIN kept USING (image, own) JOIN imgs USING (image, px))
SELECT image, cell, px, round(w / sqrt(sum(w * w) OVER (PARTITION BY image, cell)), 6) + 0.0 AS w FROM weights WHERE w > 0"""


UNIONFIND = f"WITH RECURSIVE {EMB}, {flood_sql('SELECT video_id AS image, px, avg(value) AS v FROM emb GROUP BY ALL', 3, 2.0, 20)}"


def mean_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = movies.embedding_movie(spark, sf_dir).rows
    return rows.groupBy(F.col("video_id").alias("image"), "px").agg(F.avg("value").alias("v"))


@query(UNIONFIND)
def segment_unionfind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of each video's image, with limits for small frames."""
    return segmentation.unionfind(mean_images(spark, sf_dir), 8, 8, 3, 2.0, 20).select("image", "cell", "px", r("w"))


@query(UNIONFIND)
def segment_unionfind_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same regions from a flood by tiles, which go from four pixels to the whole image."""
    return segmentation.unionfind(mean_images(spark, sf_dir), 8, 8, 3, 2.0, 20, tile=2).select("image", "cell", "px", r("w"))


@query(f"SELECT cell, px, w FROM (WITH RECURSIVE {EMB}, {VIDEO_IMAGE}, {flood_sql('SELECT 1 AS image, px, v FROM summary', 3, 0.5, 10)})")
def init_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.init_footprints(summary_image(spark, sf_dir), 8, 8, min_size=3, sens=0.5, min_n=10).select("cell", "px", r("w"))


@query(f"WITH RECURSIVE {EMB}, {VIDEO_IMAGE}, {regions_sql(IMAGE_ROW, 'v[s + 1] > 0', 'v[q + 1] > 0 AND v[p + 1] > v[q + 1]')}, {UNIT}")
def segment_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = summary_image(spark, sf_dir).withColumn("image", F.lit(1))
    return segmentation.peaks(image, 8, 8, 0.0).select("cell", "px", r("w"))


@query(f"WITH RECURSIVE {EMB}, {VIDEO_IMAGE}, {regions_sql(IMAGE_ROW, 'true', 'v[p + 1] > 0.5 * v[seed + 1]')}, {UNIT}")
def segment_peaks_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = summary_image(spark, sf_dir).withColumn("image", F.lit(1))
    return segmentation.peaks_tolerance(image, 8, 8, 0.5).select("cell", "px", r("w"))


GROW_ROW = """SELECT list(z ORDER BY px) AS z, (SELECT list(px::BIGINT ORDER BY pnr DESC, px) FROM stats) AS ord FROM (
  SELECT top.px, list(coalesce((value - m) / nullif(sd, 0), 0) ORDER BY emb.px) AS z FROM top JOIN emb USING (frame) JOIN stats ON stats.px = emb.px GROUP BY top.px)"""


@query(f"""WITH RECURSIVE {EMB}, stats AS (SELECT px, avg(value) AS m, stddev_pop(value) AS sd, (max(value) - avg(value)) / nullif(stddev_pop(value), 0) AS pnr FROM emb GROUP BY px),
top AS (SELECT px, frame FROM emb QUALIFY row_number() OVER (PARTITION BY px ORDER BY value DESC, frame) = 1),
{regions_sql(GROW_ROW, "true", "z[seed + 1][q + 1] > -list_min(z[seed + 1])")},
first AS (SELECT label, px AS seed FROM (SELECT label, px, row_number() OVER (PARTITION BY label ORDER BY list_position(ord, px)) AS k FROM found, img WHERE label > 0) WHERE k = 1),
members AS (SELECT label, px::INTEGER AS px, z[seed + 1][px + 1] AS w, count(*) OVER (PARTITION BY label) AS n FROM found JOIN first USING (label), img WHERE z[seed + 1][px + 1] <> 0)
SELECT dense_rank() OVER (ORDER BY label)::INTEGER AS cell, px, round(w, 4) + 0.0 AS w FROM members WHERE n > 1""")
def roi_grow_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    movie = movies.embedding_movie(spark, sf_dir)
    ratio = folds.peak_noise_ratio(movie.rows, movie.packed.count())
    return segmentation.grow_from_peaks(ratio, folds.peak_frame(movie.rows), movie.rows, 8, 8, 1).select("cell", "px", r("w", 4))


# Motion


@query(f"""WITH {EMB} SELECT frame, ((px % 8 + frame % 3) % 8 + 8 * ((px // 8 + frame % 2) % 8))::INTEGER AS px, round(value, 6) + 0.0 AS value FROM emb""")
def shift_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = movies.embedding_movie(spark, sf_dir).rows
    shifts = rows.select("frame").distinct().select("frame", (F.col("frame") % 3).cast("int").alias("s1"), (F.col("frame") % 2).cast("int").alias("s2"))
    return motion.shift_frames(rows, shifts, 8, 8).select("frame", "px", r("value"))


@query(f"""WITH {EMB}, t AS (SELECT px, value AS v FROM emb WHERE frame = 7),
s AS (SELECT frame, px % 8 AS d1, px // 8 AS d2, value AS v FROM emb),
x AS (SELECT frame, a, b, sum(s.v * t.v) AS x FROM s, range(8) p(a), range(8) q(b), t
  WHERE t.px = (d1 - a + 8) % 8 + 8 * ((d2 - b + 8) % 8) GROUP BY ALL),
m AS (SELECT frame, a, b FROM x QUALIFY row_number() OVER (PARTITION BY frame ORDER BY abs(x) DESC, b, a) = 1)
SELECT frame, (-(CASE WHEN a + 1 > 4.5 THEN a - 8 ELSE a END))::INTEGER AS s1, (-(CASE WHEN b + 1 > 4.5 THEN b - 8 ELSE b END))::INTEGER AS s2 FROM m""")
def register_to_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the movie registered to one of them."""
    movie = movies.embedding_movie(spark, sf_dir)
    still = movie.rows.where("frame = 7").select("px", F.col("value").alias("v"))
    return motion.register_to_template(movies.frame_arrays(movie), still, 8, 8).select("frame", "s1", "s2")


#: The kernel of a shift by parts of a pixel, from the waves of an 8-pixel circle; a frame's shift depends on its number here.
WAVES = """moved AS (SELECT frame, (frame % 3) * 0.5::DOUBLE AS s1, (frame % 2) * 0.25::DOUBLE AS s2, (frame % 4) * 0.3::DOUBLE AS phase FROM emb_f),
waves AS (SELECT s, d, sum(cos(2 * pi() * k * (d - s) / 8)) / 8 AS re, sum(sin(2 * pi() * k * (d - s) / 8)) / 8 AS im
  FROM (SELECT DISTINCT unnest([s1, s2]) AS s FROM moved), range(8) a(d), range(-4, 4) b(k) GROUP BY ALL),
kernels AS (SELECT s1, s2, phase, a.d AS d1, b.d AS d2, cos(phase) * (a.re * b.re - a.im * b.im) - sin(phase) * (a.re * b.im + a.im * b.re) AS w
  FROM (SELECT DISTINCT s1, s2, phase FROM moved) JOIN waves a ON a.s = s1 JOIN waves b ON b.s = s2)"""


@query(f"""WITH {EMB}, {WAVES} SELECT frame, (((px % 8) + d1) % 8 + 8 * (((px // 8) + d2) % 8))::INTEGER AS px, round(sum(value * w), 6) + 0.0 AS value
FROM emb JOIN moved USING (frame) JOIN kernels USING (s1, s2, phase) GROUP BY ALL""")
def shift_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames moved by parts of a pixel and a phase, in the frequency domain."""
    movie = movies.embedding_movie(spark, sf_dir)
    frame = F.col("frame")
    shifts = movie.packed.select("frame", (frame % 3 * 0.5).alias("s1"), (frame % 2 * 0.25).alias("s2"), (frame % 4 * 0.3).alias("phase"))
    return motion.MotionCorrecter(shifts).corrected(movie).rows.select("frame", "px", r("value"))


@query(f"""WITH {MODEL}, x AS (SELECT frame, px, sum(c * w) AS x FROM tr JOIN grid USING (cell) GROUP BY ALL),
t AS (SELECT ev.frame, ev.px, coalesce(x, 0) + b0.b + coalesce(b1.b * f, 0) AS v FROM ev LEFT JOIN x USING (frame, px) JOIN b0 USING (video_id, px) LEFT JOIN b1 USING (video_id, px) JOIN f ON f.frame = ev.frame),
moved AS (SELECT frame, (px % 8 + frame % 3) % 8 AS d1, (px // 8 + frame % 2) % 8 AS d2, value AS v FROM ev),
c AS (SELECT moved.frame, a, b, sum(moved.v * t.v) AS x FROM moved, range(8) p(a), range(8) q(b), t
  WHERE t.frame = moved.frame AND t.px = (d1 - a + 8) % 8 + 8 * ((d2 - b + 8) % 8) GROUP BY ALL),
m AS (SELECT frame, a, b, x FROM c QUALIFY row_number() OVER (PARTITION BY frame ORDER BY round(abs(x), 6) DESC, b, a) = 1)
SELECT frame, (-(CASE WHEN a + 1 > 4.5 THEN a - 8 ELSE a END))::INTEGER AS s1, (-(CASE WHEN b + 1 > 4.5 THEN b - 8 ELSE b END))::INTEGER AS s2,
  CASE WHEN x < 0 THEN 3.1416::DOUBLE ELSE 0.0::DOUBLE END AS phase FROM m""")
def register_to_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A movie whose frames were moved, each registered to the model's own reconstruction of it."""
    m = event_model(spark, sf_dir)
    frame = F.col("frame")
    moves = m.frames.select("frame", (frame % 3).cast("int").alias("s1"), (frame % 2).cast("int").alias("s2"))
    shaken = movies.Movie(motion.shift_frames(m.rows, moves, 8, 8), 8, 8)
    model = views.reconstruct(m.movie.pixels(), m.frames, m.footprints, m.traces, [m.b0, m.b1])
    shifts = motion.MotionCorrecter.onto(shaken, model).shifts
    return shifts.select("frame", "s1", "s2", rounded(F.abs("phase"), 4).alias("phase"))


@query()
def register_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    movie = movies.embedding_movie(spark, sf_dir)
    seg = movies.segment_of(F.col("frame"), movie.packed.count(), SEGMENTS * 4)
    shifts = motion.register_groups(movies.frame_arrays(movie).withColumn("seg", seg), 8, 8, "video_id", "seg")
    return shifts.select("video_id", "seg", "frame", "s1", "s2", r("phase", 4))


@query()
def register_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pyramid over each whole video."""
    movie = movies.embedding_movie(spark, sf_dir)
    return motion.register_video(movies.frame_arrays(movie), 8, 8).select("video_id", "frame", "s1", "s2", r("phase", 4))


@query(f"WITH {EMB} SELECT frame, round(25 * cos(2 * pi() * frame / 40))::INTEGER AS s1, round(25 * sin(2 * pi() * frame / 40))::INTEGER AS s2 FROM emb_f")
def shift_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts of every frame of a movie around a circle."""
    turn = 2 * F.pi() * F.col("frame") / 40
    return movies.embedding_movie(spark, sf_dir).packed.select("frame", F.round(25 * F.cos(turn)).cast("int").alias("s1"), F.round(25 * F.sin(turn)).cast("int").alias("s2"))


# The whole analysis


@query()
def pipeline_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis with the session's own defaults, four rounds of three merges with fitted deconvolution, over a movie of four cells made of the tables: pixels and energy of each cell found."""
    session = Session(movies.event_cells_movie(spark, sf_dir)).run(min_size=8, sens=5.0, min_n=100)
    sizes = session.footprints.groupBy("cell").agg(F.count("*").alias("pixels"))
    return sizes.join(session.traces.groupBy("cell").agg(rounded(F.sum("c"), 2).alias("total")), "cell")
