"""Queries on sources, segments, folds and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fovea.functions.columns import pixel, rounded
from fovea.functions.lineage import saved, scratch
from fovea.operators import folds, views
from fovea.plans.ctes import CELL_MOVIE, EMB, EMB_IMAGE, EV, FEET, LI, MODEL, SPIKES, TRACES
from fovea.plans.registry import query
from fovea.sources import movies, store, synthetic

SEGMENTS = 5


def r(name: str, digits: int = 6):
    return rounded(F.col(name), digits).alias(name)


@query(f"WITH {EMB} SELECT video_id, frame, len(embedding)::INTEGER AS pixels, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0.0 AS total FROM emb_f")
def src_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of a movie file: its size and sum."""
    packed = movies.embedding_movie(spark, sf_dir).packed
    total = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return packed.select("video_id", "frame", F.size("pixels").alias("pixels"), rounded(total).alias("total"))


@query("SELECT DISTINCT 'recording_' || len(embedding) AS key FROM embeddings")
def src_single_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one dataset key of a container: all rows must have the same."""
    rows = movies.read(spark, sf_dir, "embeddings")
    return movies.single_key(rows.select(F.concat(F.lit("recording_"), F.size("embedding").cast("string")).alias("key")))


@query(f"""WITH {EMB}, n AS (SELECT video_id, count(*) AS frames FROM emb_f GROUP BY ALL)
SELECT video_id, frames, 8 AS height, 8 AS width, ceil(frames / ceil(frames / {SEGMENTS}.0))::INTEGER AS segments, ceil(frames / {SEGMENTS}.0)::BIGINT AS longest FROM n""")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movies.segment_summary(movies.embedding_movie(spark, sf_dir), SEGMENTS)


@query(f"""WITH {LI}, o AS (SELECT video_id, n, coalesce(sum(n) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM li_n)
SELECT video_id, frame, px, value FROM li JOIN o USING (video_id)
WHERE video_id = 3 AND (frame - o - 1) // ceil(n / 5.0)::BIGINT = 1""")
def scan_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment 2 of video 3: a range of frames, found from the lengths."""
    movie = movies.lineitem_movie(spark, sf_dir)
    lengths = movies.video_offsets(movies.video_lengths(movie))
    ranges = movies.segment_ranges(lengths.select("video_id", "n", "offset"), SEGMENTS).where("video_id = 3 AND seg = 2")
    spans = ranges.select("video_id", (F.col("lo") + F.col("offset")).alias("lo"), (F.col("hi") + F.col("offset")).alias("hi"))
    return movie.rows.join(spans, "video_id").where("frame BETWEEN lo AND hi").select("video_id", "frame", "px", "value")


@query(f"""WITH {EMB} SELECT frame, (px % 8 - 3 + 2 * (px // 8 - 1))::INTEGER AS px, round(value, 6) + 0.0 AS value
FROM emb WHERE px % 8 BETWEEN 3 AND 4 AND px // 8 BETWEEN 1 AND 4""")
def crop_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop of a crop of every frame."""
    movie = movies.embedding_movie(spark, sf_dir)
    outer = movies.crop(movie.rows, 8, (2, 5), (1, 6))
    return movies.crop(outer, 4, (1, 2), (0, 3)).select("frame", "px", r("value"))


@query(f"WITH {EMB} SELECT video_id, count(DISTINCT frame) AS nframes, max(px % 8) + 1 AS height, (max(px // 8) + 1)::INTEGER AS width FROM emb GROUP BY video_id")
def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = movies.embedding_movie(spark, sf_dir).rows
    return rows.groupBy("video_id").agg(
        F.count_distinct("frame").alias("nframes"), (F.max(F.col("px") % 8) + 1).alias("height"), (F.max(F.floor(F.col("px") / 8)) + 1).cast("int").alias("width")
    )


LI_OFFSETS = f"{LI}, o AS (SELECT video_id, n, coalesce(sum(n) OVER (ORDER BY video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM li_n)"


@query(f"WITH {LI_OFFSETS} SELECT DISTINCT video_id, frame, ((frame - o - 1) // ceil(n / 5.0)::BIGINT + 1)::INTEGER AS seg FROM li JOIN o USING (video_id)")
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of every frame."""
    movie = movies.lineitem_movie(spark, sf_dir)
    lengths = movies.video_offsets(movies.video_lengths(movie)).select("video_id", "n", "offset")
    frames = movie.rows.select("video_id", "frame").distinct().join(lengths, "video_id")
    return frames.select("video_id", "frame", movies.segment_of(F.col("frame") - F.col("offset"), F.col("n"), SEGMENTS).alias("seg"))


@query(f"""WITH {EMB}, n AS (SELECT video_id, count(*) AS n FROM emb_f GROUP BY ALL)
SELECT video_id, seg::INTEGER AS seg, ((seg - 1) * ceil(n / 5.0)::BIGINT + 1)::BIGINT AS lo, least(seg * ceil(n / 5.0)::BIGINT, n)::BIGINT AS hi FROM n, range(1, 6) s(seg)""")
def segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = movies.video_lengths(movies.embedding_movie(spark, sf_dir)).select("video_id", "n")
    return movies.segment_ranges(lengths, SEGMENTS).select("video_id", "seg", "lo", "hi")


@query(f"WITH {EMB} SELECT video_id, min(frame) AS first, max(frame) AS last FROM emb_f GROUP BY ALL")
def video_frame_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movies.video_lengths(movies.embedding_movie(spark, sf_dir)).select("video_id", "first", "last")


@query(f"WITH {EMB}, n AS (SELECT count(*) AS n FROM emb_f) SELECT frame, ((frame - 1) // ceil(n / 5.0)::BIGINT + 1)::INTEGER AS seg FROM emb_f, n")
def frame_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames looked up in the table of segment ranges (five rows, so a broadcast range join)."""
    frames = movies.embedding_movie(spark, sf_dir).packed.select("frame")
    ranges = movies.segment_ranges(frames.agg(F.count("*").alias("n")), SEGMENTS).select("seg", "lo", "hi")
    return frames.join(F.broadcast(ranges), F.col("frame").between(F.col("lo"), F.col("hi"))).select("frame", "seg")


@query(f"WITH {EMB} SELECT px, round(value, 6) + 0.0 AS value FROM emb WHERE frame = 7")
def read_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movies.embedding_movie(spark, sf_dir).rows.where("frame = 7").select("px", r("value"))


@query(f"WITH {LI} SELECT video_id, count(*) AS n, min(frame) AS first, max(frame) AS last, sum(value) AS total FROM li GROUP BY ALL")
def multi_video_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly movies with frames of their own, put one after another."""
    movie = movies.lineitem_movie(spark, sf_dir)
    starts = movie.rows.groupBy("video_id").agg(F.min("frame").alias("start"))
    local = movie.rows.join(starts, "video_id").select("video_id", (F.col("frame") - F.col("start") + 1).alias("frame"), "px", "value")
    parts = [local.where(F.col("video_id") == k).drop("video_id") for k in range(1, 8)]
    whole = movies.union_videos(parts)
    return whole.groupBy("video_id").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.sum("value").alias("total"))


@query(f"WITH {LI_OFFSETS} SELECT video_id, n, o AS \"offset\" FROM o")
def video_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movies.video_offsets(movies.video_lengths(movies.lineitem_movie(spark, sf_dir))).select("video_id", "n", "offset")


@query(f"""WITH {LI_OFFSETS} SELECT video_id, seg::INTEGER AS seg, (o + (seg - 1) * ceil(n / 5.0)::BIGINT + 1)::BIGINT AS lo, (o + least(seg * ceil(n / 5.0)::BIGINT, n))::BIGINT AS hi FROM o, range(1, 6) s(seg)""")
def segment_ranges_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = movies.video_offsets(movies.video_lengths(movies.lineitem_movie(spark, sf_dir))).select("video_id", "n", "offset")
    ranges = movies.segment_ranges(lengths, SEGMENTS)
    return ranges.select("video_id", "seg", (F.col("lo") + F.col("offset")).alias("lo"), (F.col("hi") + F.col("offset")).alias("hi"))


BOXES = tuple((f"v{k}", 1 + k % 3, 6 + k % 3, 1 + k // 3 % 3, 6 + k // 3 % 3) for k in range(1, 11))


@query(f"""WITH {EMB}, b AS (SELECT 'v' || k AS filename, k AS video_id, k % 3 AS l, k // 3 % 3 AS t FROM range(1, 11) r(k))
SELECT filename, frame, (px % 8 - l + 6 * (px // 8 - t))::INTEGER AS px, round(value, 6) + 0.0 AS value
FROM emb JOIN b USING (video_id) WHERE px % 8 BETWEEN l AND l + 5 AND px // 8 BETWEEN t AND t + 5""")
def aligned_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video cropped to its own box by an alignment table read as CSV."""
    lines = spark.createDataFrame([(",".join(map(str, box)),) for box in BOXES], "line string")
    boxes = lines.select(F.from_csv("line", movies.ALIGNMENT).alias("b")).select("b.*")
    rows = movies.embedding_movie(spark, sf_dir).rows.withColumn("filename", F.concat(F.lit("v"), F.col("video_id").cast("string")))
    return movies.aligned(rows, boxes, 8).select("filename", "frame", "px", r("value"))


@query(f"WITH {LI_OFFSETS} SELECT ((video_id - 1) * 5 + seg)::INTEGER AS seg, video_id FROM o, range(1, 6) s(seg)")
def segment_to_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = movies.video_lengths(movies.lineitem_movie(spark, sf_dir)).select("video_id", "n")
    return movies.segment_ranges(lengths, SEGMENTS).select(((F.col("video_id") - 1) * SEGMENTS + F.col("seg")).alias("seg"), "video_id")


@query(f"WITH {EMB} SELECT frame, count(*) AS n, round(sum(px * value), 6) + 0.0 AS checksum FROM emb GROUP BY frame")
def to_float32_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames given by their two axes, made flat in column-major order as 32-bit values."""
    grid = movies.embedding_movie(spark, sf_dir).rows.select("frame", (F.col("px") % 8).alias("d1"), F.floor(F.col("px") / 8).alias("d2"), "value")
    flat = grid.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct(pixel(F.col("d1"), F.col("d2"), 8).alias("px"), F.col("value").cast("float").alias("v")))).alias("p"))
    checksum = F.aggregate(F.col("p"), F.lit(0.0), lambda s, x: s + x["px"] * x["v"].cast("double"))
    return flat.select("frame", F.size("p").cast("long").alias("n"), rounded(checksum).alias("checksum"))


@query(f"WITH {EMB}, m AS (SELECT px, min(value) AS m FROM emb GROUP BY px) SELECT px, round(sum(value - m), 6) + 0.0 AS total, round(min(value - m), 6) + 0.0 AS least FROM emb JOIN m USING (px) GROUP BY px")
def subtract_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.subtract_min(movies.embedding_movie(spark, sf_dir).rows)
    return rows.groupBy("px").agg(rounded(F.sum("value")).alias("total"), rounded(F.min("value")).alias("least"))


@query(f"WITH {LI} SELECT px, CASE WHEN count(*) < (SELECT count(*) FROM li_days) THEN least(min(value), 0) ELSE min(value) END AS minv FROM li GROUP BY px")
def pixel_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum over all frames; a pixel absent from a frame is zero there."""
    movie = movies.lineitem_movie(spark, sf_dir)
    frames = movie.rows.agg(F.count_distinct("frame").alias("frames"))
    least = movie.rows.groupBy("px").agg(F.min("value").alias("m"), F.count("*").alias("n")).join(F.broadcast(frames), F.lit(True))
    return least.select("px", F.when(F.col("n") < F.col("frames"), F.least("m", F.lit(0.0))).otherwise(F.col("m")).alias("minv"))


@query(f"WITH {EMB}, m AS (SELECT px, min(value) AS m FROM emb GROUP BY px) SELECT px, round(value - m, 6) + 0.0 AS value FROM emb JOIN m USING (px) WHERE frame = 7")
def read_frame_minsub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = movies.embedding_movie(spark, sf_dir).rows
    return folds.subtract_min(rows.where("frame = 7"), folds.pixel_min(rows)).select("px", r("value"))


@query(f"WITH {EMB} SELECT 'empty' AS source, 0::BIGINT AS nframes, 100 AS height, 100 AS width UNION ALL SELECT 'with a movie', count(*), 8, 8 FROM emb_f")
def empty_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null source has a size and no frames, and adds none to a movie."""
    empty, movie = movies.empty_movie(spark), movies.embedding_movie(spark, sf_dir)
    both = movies.Movie(movie.rows.unionByName(empty.rows), movie.height, movie.width)
    parts = [m.rows.agg(F.count_distinct("frame").alias("nframes")).withColumns({"source": F.lit(n), "height": F.lit(m.height), "width": F.lit(m.width)}) for n, m in (("empty", empty), ("with a movie", both))]
    return parts[0].unionByName(parts[1])


SUFFIXES = (".nwb", ".hdf", ".hdf5", ".h5", ".parquet", ".tif", "")


@query(f"""WITH p AS (SELECT 'orders/' || o_orderkey || (CASE o_orderkey % 7 {" ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SUFFIXES))} END) AS path FROM orders)
SELECT path, CASE WHEN path LIKE '%.nwb' THEN 'nwb' WHEN regexp_matches(path, '[.](hdf|hdf5|h5)$') THEN 'hdf' WHEN path LIKE '%.parquet' THEN 'parquet' ELSE 'empty' END AS kind FROM p""")
def open_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a path opens as: one path an order, of seven kinds."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    paths = movies.read(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), suffix).alias("path"))
    return paths.select("path", movies.open_kind(F.col("path")).alias("kind"))


RECORDINGS = ("20210304_101500_animal4learnday1.nwb", "20210305_094500_animal4learnday2.nwb", "20210306_120000_animal4reversalday1.nwb")
VIDEO_NAMES = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(RECORDINGS, 1))


@query(f"""WITH {TRACES} SELECT regexp_extract(CASE video_id {VIDEO_NAMES} END, 'animal[0-9].*day[0-9]+') AS video_key, cell, count(*) AS n, round(sum(c), 6) + 0.0 AS total
FROM tr GROUP BY ALL""")
def save_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces written partitioned by video key, and read back."""
    from fovea.plans.model_queries import event_model

    model = event_model(spark, sf_dir)
    videos = spark.createDataFrame(list(enumerate(RECORDINGS, 1)), "video_id int, filename string")
    written = saved(store.keyed_traces(model.traces, videos), "keyed-traces")
    return written.groupBy("video_key", "cell").agg(F.count("*").alias("n"), rounded(F.sum("c")).alias("total"))


@query("""WITH f AS (SELECT CASE c_custkey % 5 WHEN 0 THEN 'plain' || c_custkey ELSE '2021_' || c_custkey || '_animal' || c_nationkey || (CASE c_custkey % 2 WHEN 0 THEN 'learn' ELSE 'reversal' END) || 'day' || c_custkey % 30 END || '.nwb' AS f FROM customer)
SELECT f AS filename, CASE WHEN regexp_extract(f, 'animal[0-9].*day[0-9]+') = '' THEN f ELSE regexp_extract(f, 'animal[0-9].*day[0-9]+') END AS video_key FROM f""")
def video_key_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of file names, one a customer; every fifth has none."""
    key = F.col("c_custkey").cast("string")
    phase = F.when(F.col("c_custkey") % 2 == 0, "learn").otherwise("reversal")
    long = F.concat(F.lit("2021_"), key, F.lit("_animal"), F.col("c_nationkey").cast("string"), phase, F.lit("day"), (F.col("c_custkey") % 30).cast("string"))
    name = F.concat(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("plain"), key)).otherwise(long), F.lit(".nwb"))
    return movies.read(spark, sf_dir, "customer").select(name.alias("filename")).select("filename", store.video_key(F.col("filename")).alias("video_key"))


@query(f"""WITH {MODEL}, t AS (SELECT 'footprints' AS "table", count(*) AS n, round(sum(w), 4) + 0.0 AS s FROM grid UNION ALL SELECT 'traces', count(*), round(sum(c), 4) + 0.0 FROM tr
UNION ALL SELECT 'b0', count(*), round(sum(b), 4) + 0.0 FROM b0 UNION ALL SELECT 'f', count(*), round(sum(f), 4) + 0.0 FROM f)
SELECT "table", n AS rows_saved, s AS sum_saved, n AS rows_loaded, s AS sum_loaded FROM t""")
def load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solution saved and loaded: rows and sums of every table, before and after."""
    import uuid

    from fovea.plans.model_queries import event_model

    model = event_model(spark, sf_dir)
    path = f"{scratch(spark).rstrip('/')}/fovea/solution-{uuid.uuid4().hex}"
    store.save(path, {"footprints": model.footprints, "traces": model.traces}, [model.b0, model.b1])
    tables, (b0, b1) = store.load(spark, path, ("footprints", "traces"))

    def line(name: str, before: DataFrame, after: DataFrame, value: str) -> DataFrame:
        count = lambda t, p: t.agg(F.count("*").alias(f"rows_{p}"), rounded(F.sum(value), 4).alias(f"sum_{p}"), F.lit(name).alias("table"))
        return count(before, "saved").join(count(after, "loaded"), "table")

    parts = [("footprints", model.footprints, tables["footprints"], "w"), ("traces", model.traces, tables["traces"], "c"), ("b0", model.b0.table, b0.table, "b"), ("f", model.b1.trace, b1.trace, "f")]
    out = line(*parts[0])
    for part in parts[1:]:
        out = out.unionByName(line(*part))
    return out


@query(f"""WITH {FEET}, c AS (SELECT cell, px % 8 AS d1, px // 8 AS d2, w FROM feet WHERE px % 8 BETWEEN 1 AND 5 AND px // 8 BETWEEN 1 AND 5)
SELECT cell, (d1 - 1 + 5 * (d2 - 1))::INTEGER AS px, round(w / sqrt(sum(w * w) OVER (PARTITION BY cell)), 6) + 0.0 AS w FROM c""")
def ground_truth_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = movies.event_footprints(spark, sf_dir)
    traces = feet.select("cell", F.lit(1).cast("long").alias("frame"), F.lit(1.0).alias("c")).distinct()
    unit, _ = store.normalised_truth(feet, traces, 8, 1, (5, 5))
    return unit.select("cell", "px", r("w"))


@query(f"WITH {CELL_MOVIE} SELECT frame, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS deviation FROM cells_movie GROUP BY frame")
def synth_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A movie of known cells, made of the tables: mean and deviation by frame."""
    rows = movies.event_cells_movie(spark, sf_dir).rows
    return rows.groupBy("frame").agg(rounded(F.avg("value")).alias("mean"), rounded(F.stddev_pop("value")).alias("deviation"))


@query(f"WITH {LI} SELECT px, sum(value) AS total FROM li GROUP BY px")
def fold_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold(movies.lineitem_movie(spark, sf_dir).rows, lambda v: v, F.sum, "total")


@query(f"WITH {LI} SELECT px, min(value * value) AS least FROM li GROUP BY px")
def fold_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold(movies.lineitem_movie(spark, sf_dir).rows, lambda v: v * v, F.min, "least")


@query(f"WITH {EMB}, {EMB_IMAGE} SELECT px, round(v, 6) + 0.0 AS v FROM emb_image")
def negentropy_img(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.negentropy(movies.embedding_movie(spark, sf_dir).rows).select("px", r("v"))


@query(f"WITH {EMB}, {EMB_IMAGE} SELECT px, round(x3 ** 2 / x2 ** 3 / 12 + x4 / x2 ** 2 / 48, 6) + 0.0 AS v FROM emb_m")
def negentropy_no_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.negentropy_no_mean(movies.embedding_movie(spark, sf_dir).rows).select("px", r("v"))


@query(f"""WITH {EMB}, m AS (SELECT video_id, px, avg(value) x1, avg(value ** 2) x2, avg(value ** 3) x3, avg(value ** 4) x4 FROM emb GROUP BY ALL), v AS (
  SELECT px, (x3 - 3 * x1 * x2 + 2 * x1 ** 3) ** 2 / (x2 - x1 * x1) ** 3 / 12 + ((x4 - 4 * x1 * x3 + 6 * x1 * x1 * x2 - 3 * x1 ** 4) / (x2 - x1 * x1) ** 2 - 3) / 48 AS v FROM m)
SELECT px, round(avg(v), 6) + 0.0 AS v FROM v GROUP BY px""")
def negentropy_img_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.negentropy_per_video(movies.embedding_movie(spark, sf_dir).rows).select("px", r("v"))


@query(f"WITH {LI} SELECT video_id, px, round(sum(value) / n, 6) + 0.0 AS m FROM li JOIN li_n USING (video_id) GROUP BY video_id, px, n")
def per_video_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each pixel over the frames of a video; absent is zero."""
    movie = movies.lineitem_movie(spark, sf_dir)
    lengths = movies.video_lengths(movie).select("video_id", "n")
    sums = movie.rows.groupBy("video_id", "px").agg(F.sum("value").alias("s"))
    return sums.join(lengths, "video_id").select("video_id", "px", rounded(F.col("s") / F.col("n")).alias("m"))


@query(f"WITH {EMB} SELECT px, round(avg(value), 6) + 0.0 AS b FROM emb GROUP BY px")
def static_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fovea.operators.backgrounds import Static

    movie = movies.embedding_movie(spark, sf_dir)
    return Static.start(movie.rows, movie.packed.count()).table.select("px", r("b"))


@query(f"""WITH {LI}, t AS (SELECT count(*) AS t FROM li_days), s AS (SELECT px, sum(value) / t AS m, sum(value * value) / t AS q, CASE WHEN count(*) < t THEN greatest(max(value), 0) ELSE max(value) END AS top FROM li, t GROUP BY px, t)
SELECT px, round((top - m) / nullif(sqrt(greatest(q - m * m, 0)), 0), 6) + 0.0 AS pnr FROM s""")
def peak_noise_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    movie = movies.lineitem_movie(spark, sf_dir)
    frames = movie.rows.agg(F.count_distinct("frame").alias("n")).first()["n"]
    return folds.peak_noise_ratio(movie.rows, frames).select("px", r("pnr"))


@query(f"WITH {LI} SELECT px, frame, value AS peak FROM li QUALIFY row_number() OVER (PARTITION BY px ORDER BY value DESC, frame) = 1")
def peak_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.peak_frame(movies.lineitem_movie(spark, sf_dir).rows)


@query(f"""WITH {EMB}, {EMB_IMAGE}, o AS (SELECT a - 1 AS a, b - 1 AS b FROM range(3) x(a), range(3) y(b))
SELECT c.px, round(median(n.v), 6) + 0.0 AS v FROM emb_image c, o JOIN emb_image n
  ON n.px = greatest(0, least(7, c.px % 8 + o.a)) + 8 * greatest(0, least(7, c.px // 8 + o.b)) GROUP BY c.px""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = folds.negentropy(movies.embedding_movie(spark, sf_dir).rows)
    return folds.median_filter(image, 3, 8, 8).select("px", r("v"))


@query(f"WITH {LI} SELECT px, row_number() OVER (ORDER BY sum(value) DESC, px)::INTEGER AS rank FROM li GROUP BY px")
def pixel_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = folds.fold(movies.lineitem_movie(spark, sf_dir).rows, lambda v: v, F.sum, "v")
    return folds.pixel_rank(image).select("px", "rank")


@query(f"WITH {EMB}, {EMB_IMAGE} SELECT (px // 8)::INTEGER AS seg, round(avg(v * v), 9) + 0.0 AS energy, row_number() OVER (ORDER BY avg(v * v), px // 8)::INTEGER AS rank FROM emb_image GROUP BY px // 8")
def cluster_energy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = folds.negentropy(movies.embedding_movie(spark, sf_dir).rows)
    clusters = image.withColumn("seg", F.floor(F.col("px") / 8).cast("int"))
    return folds.cluster_energy_rank(clusters).select("seg", r("energy", 9), "rank")


@query(f"""WITH {EMB}, {EMB_IMAGE}, o(a, b) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0))
SELECT c.px, n.px AS neighbour, round(n.v, 6) + 0.0 AS v FROM emb_image c, o JOIN emb_image n ON n.px = c.px + o.a + 8 * o.b
WHERE c.px % 8 + o.a BETWEEN 0 AND 7 AND c.px // 8 + o.b BETWEEN 0 AND 7""")
def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = folds.negentropy(movies.embedding_movie(spark, sf_dir).rows)
    return folds.grid_neighbours(image, 8, 8).select("px", "neighbour", r("v"))


@query(f"WITH {SPIKES} SELECT a.cell, a.frame, round(sum(b.s * 0.9::DOUBLE ** (a.frame - b.frame)), 6) + 0.0 AS c FROM spikes a JOIN spikes b ON a.cell = b.cell AND b.frame <= a.frame GROUP BY ALL")
def ar1_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spikes = movies.event_spikes(spark, sf_dir)
    packed = spikes.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("frame", "s"))).alias("t"))
    traces = packed.select("cell", F.posexplode(synthetic.ar1(F.col("t.s"), 0.9)).alias("k", "c"))
    return traces.select("cell", (F.col("k") + 1).cast("long").alias("frame"), r("c"))


@query("""WITH every AS (SELECT l_linenumber AS seg, min(l_orderkey) AS "at" FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY ALL UNION ALL SELECT DISTINCT l_linenumber, 1000000000000 + l_linenumber FROM lineitem),
first AS (SELECT seg, min("at") AS "at" FROM every GROUP BY seg) SELECT row_number() OVER (ORDER BY "at", seg)::INTEGER AS place, seg FROM first""")
def set_union_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers with a large return first, in the order of their first one, then the others in their own (one row a line number is ordered)."""
    from pyspark.sql import Window

    items = movies.read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("seg"), "l_orderkey", "l_returnflag", "l_quantity")
    some = items.where("l_returnflag = 'R' AND l_quantity > 49").groupBy("seg").agg(F.min("l_orderkey").alias("at"))
    every = items.select("seg").distinct().select("seg", (F.col("seg") + F.lit(10**12)).alias("at"))
    first = some.unionByName(every).groupBy("seg").agg(F.min("at").alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at", "seg")).alias("place"), "seg")


STAGES_SQL = "stages AS (SELECT stage, row_number() OVER (ORDER BY stage)::INTEGER AS i, s FROM (SELECT l_returnflag || l_linestatus AS stage, sum(l_quantity)::DOUBLE AS s FROM lineitem GROUP BY stage))"


@query(f"WITH {STAGES_SQL} SELECT i, stage, sum(s) OVER (ORDER BY i) - s AS start_s, sum(s) OVER (ORDER BY i) AS end_s, sum(s) OVER (ORDER BY i) - s / 2 AS middle_s FROM stages")
def stage_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end and middle of stages that follow each other: return and line states, each as long as its quantity (one row a stage is ordered)."""
    from pyspark.sql import Window

    sums = movies.read(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("stage")).agg(F.sum("l_quantity").cast("double").alias("s"))
    stages = sums.withColumn("i", F.row_number().over(Window.orderBy("stage")))
    end = F.sum("s").over(Window.orderBy("i"))
    return stages.select("i", "stage", (end - F.col("s")).alias("start_s"), end.alias("end_s"), (end - F.col("s") / 2).alias("middle_s"))


@query(f"WITH {EMB}, {EMB_IMAGE} SELECT px, CASE WHEN v > 0 THEN round(log10(v), 6) + 0.0 END AS log_v FROM emb_image")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = folds.negentropy(movies.embedding_movie(spark, sf_dir).rows)
    return views.log_image(image).select("px", r("log_v"))


@query(f"WITH {EMB}, n AS (SELECT count(*) AS n FROM emb_f) SELECT frame, d::INTEGER AS step, ((frame - 1 + d + 2 * n) % n + 1)::BIGINT AS next FROM emb_f, n, (VALUES (-11), (-1), (0), (1), (10)) b(d)")
def frame_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from every frame of a movie, around its ends."""
    packed = movies.embedding_movie(spark, sf_dir).packed
    steps = F.explode(F.array(*(F.lit(d) for d in (-11, -1, 0, 1, 10)))).alias("step")
    return packed.select("frame", steps).select("frame", "step", views.stepped(F.col("frame"), F.col("step"), packed.count()).cast("long").alias("next"))
