"""Movies as tables: packed (one row per frame) and long (one row per pixel and frame)."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fovea.functions.columns import column_of, pixel, row_of

PACKED = "video_id int, frame long, pixels array<float>"
LONG = "video_id int, frame long, px int, value double"


@dataclass
class Movie:
    """A long movie (video_id, frame, px, value) with its frame size; frames are global and count from 1."""

    rows: DataFrame
    height: int
    width: int
    packed: DataFrame | None = None

    def __repr__(self) -> str:
        return f"Movie({self.height} x {self.width}, columns {self.rows.columns})"

    def pixels(self) -> DataFrame:
        return self.rows.sparkSession.range(self.height * self.width).select(F.col("id").cast("int").alias("px"))


def frame_arrays(movie: Movie) -> DataFrame:
    """(video_id, frame, px, value): a row a frame with its pixels as arrays in order.

    A packed movie is taken as it is and has no array of pixel numbers: its
    values are those of pixels 0, 1, …. Of other movies absent pixels stay
    absent.
    """
    if movie.packed is not None:
        return movie.packed.select("video_id", "frame", F.lit(None).cast("array<int>").alias("px"), F.col("pixels").cast("array<double>").alias("value"))
    grouped = movie.rows.groupBy("video_id", "frame").agg(F.sort_array(F.collect_list(F.struct("px", "value"))).alias("p"))
    return grouped.select("video_id", "frame", F.col("p.px").alias("px"), F.col("p.value").alias("value"))


def long_rows(arrays: DataFrame) -> DataFrame:
    """``frame_arrays`` in long form."""
    px = F.coalesce("px", F.sequence(F.lit(0), F.size("value") - 1))
    zipped = F.explode(F.arrays_zip(px.alias("px"), F.col("value"))).alias("p")
    return arrays.where(F.size("value") > 0).select("video_id", "frame", zipped).select("video_id", "frame", "p.px", "p.value")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exploded(packed: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Packed rows in long form; a pixel range is sliced before it is exploded."""
    pixels = F.col("pixels") if lo is None else F.slice("pixels", lo + 1, hi - lo)
    return packed.select("video_id", "frame", F.posexplode(pixels).alias("px", "value")).select(
        "video_id", "frame", (F.col("px") + (lo or 0)).cast("int").alias("px"), F.col("value").cast("double").alias("value")
    )


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Global frame numbers: the place within the group after the sizes of the groups before.

    Only the table of group sizes (one row a video) is ordered as a whole.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    before = sizes.select(group, F.coalesce(F.sum("n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("nth", within).join(before, group).withColumn("frame", F.col("before") + F.col("nth")).drop("nth", "before")


def embedding_movie(spark: SparkSession, sf_dir: str) -> Movie:
    """``embeddings`` as ten videos of 8 x 8 frames, one per label."""
    rows = numbered(read(spark, sf_dir, "embeddings"), "label", ["vec_id"])
    packed = rows.select((F.col("label") + 1).cast("int").alias("video_id"), "frame", F.col("embedding").alias("pixels"))
    return Movie(exploded(packed), 8, 8, packed)


def event_movie(spark: SparkSession, sf_dir: str) -> Movie:
    """``events`` as three videos of 240 hourly 8 x 8 frames, dense; an event outside the 720 hours fails."""
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) + 1")
    hour = F.when(hour.between(1, 720) | hour.isNull(), hour).otherwise(F.raise_error(F.lit("an event lies outside the movie's hours")).cast("bigint"))
    sums = read(spark, sf_dir, "events").groupBy(hour.alias("frame"), (F.col("user_id") % 64).cast("int").alias("px")).agg(F.sum("value").alias("v"))
    cells = spark.range(720 * 64).select((F.floor(F.col("id") / 64) + 1).alias("frame"), (F.col("id") % 64).cast("int").alias("px"))
    rows = cells.join(sums, ["frame", "px"], "left").select(
        (F.floor((F.col("frame") - 1) / 240) + 1).cast("int").alias("video_id"), "frame", "px", F.coalesce("v", F.lit(0.0)).alias("value")
    )
    return Movie(rows, 8, 8)


def lineitem_movie(spark: SparkSession, sf_dir: str) -> Movie:
    """``lineitem`` as seven yearly videos of daily 32 x 32 frames, sparse (absent is zero).

    The ranked table holds one row per shipping day, so the calendar bounds it.
    """
    items = read(spark, sf_dir, "lineitem").select("l_shipdate", (F.col("l_partkey") % 1024).cast("int").alias("px"), "l_quantity")
    days = items.select("l_shipdate").distinct()
    days = days.select("l_shipdate", F.row_number().over(Window.orderBy("l_shipdate")).cast("long").alias("frame"))
    rows = (
        items.groupBy("l_shipdate", "px").agg(F.sum("l_quantity").alias("value")).join(days, "l_shipdate")
        .select((F.year("l_shipdate") - 1994).cast("int").alias("video_id"), "frame", "px", "value")
    )
    return Movie(rows, 32, 32)


def grid_footprints(spark: SparkSession) -> DataFrame:
    """Nine overlapping 3 x 3 footprints of unit norm on an 8 x 8 frame: (cell, px, w)."""
    i = F.col("id")
    d1, d2 = F.floor(i / 27) % 3, F.floor(i / 9) % 3
    return spark.range(81).select(
        (1 + 3 * d2 + d1).cast("int").alias("cell"), pixel(2 * d1 + F.floor(i / 3) % 3, 2 * d2 + i % 3, 8).alias("px"), F.lit(1 / 3).alias("w")
    )


def event_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's footprints, weighted by what the events sum to at each pixel and of unit norm; pixels without events are left out."""
    sums = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 64).cast("int").alias("px")).agg(F.sum("value").alias("m"))
    met = grid_footprints(spark).join(sums, "px")
    norms = met.groupBy("cell").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return met.join(norms, "cell").select("cell", "px", (F.col("m") / F.col("norm")).alias("w"))


CELLS, BINS, CELL_SIDE, CELL_RADIUS, CELL_GAMMA = 4, 240, 24, 2.5, 0.85


def event_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, frame, s): ``events`` of four groups of users in 240 bins of three hours; a spike is what a bin's sum has over the group's mean and 1.2 deviations."""
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    sums = read(spark, sf_dir, "events").groupBy((F.col("user_id") % CELLS + 1).cast("int").alias("cell"), (F.floor(hour / 3) + 1).alias("frame")).agg(F.sum("value").alias("v"))
    every = spark.range(CELLS * BINS).select((F.floor(F.col("id") / BINS) + 1).cast("int").alias("cell"), (F.col("id") % BINS + 1).alias("frame"))
    every = every.join(sums, ["cell", "frame"], "left").select("cell", "frame", F.coalesce("v", F.lit(0.0)).alias("v"))
    stats = every.groupBy("cell").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    over = F.coalesce(F.try_divide(F.col("v") - F.col("m"), F.col("sd")), F.lit(0.0)) - 1.2
    return every.join(stats, "cell").select("cell", "frame", F.greatest(F.lit(0.0), over).alias("s"))


def vector_noise(spark: SparkSession, sf_dir: str, wanted: DataFrame, place: Column, row: Column) -> DataFrame:
    """``wanted`` with z, about of unit deviation: component ``place`` of the vector whose id is ``row``, wrapped around by the number of vectors; zero without such a vector."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    keyed = wanted.withColumn("place", place.cast("int")).withColumn("vec_id", row % vectors.count())
    value = F.coalesce(F.try_element_at("embedding", "place").cast("double") * 8, F.lit(0.0))
    return keyed.join(vectors, "vec_id", "left").withColumn("z", value).drop("place", "vec_id", "embedding")


def event_cells_movie(spark: SparkSession, sf_dir: str) -> Movie:
    """Four spots of 24 x 24 pixels that decay after the spikes of ``events``, on a flat background with noise from ``embeddings``: three videos of 80 frames."""
    from fovea.sources import synthetic

    side, area = CELL_SIDE, CELL_SIDE * CELL_SIDE
    spots = synthetic.footprints(spark, CELLS, side, side, CELL_RADIUS)
    traces = synthetic.ar1_closed(event_spikes(spark, sf_dir), CELL_GAMMA, 60)
    signal = spots.join(traces, "cell").groupBy("frame", "px").agg(F.sum(F.col("w") * F.col("c") * 60).alias("x"))
    every = spark.range(BINS * area).select((F.floor(F.col("id") / area) + 1).alias("frame"), (F.col("id") % area).cast("int").alias("px"))
    noisy = vector_noise(spark, sf_dir, every, F.col("px") % 64 + 1, F.col("frame") * 9 + F.floor(F.col("px") / 64))
    value = F.coalesce("x", F.lit(0.0)) + 10 + F.col("z")
    video = (F.floor((F.col("frame") - 1) / (BINS // 3)) + 1).cast("int")
    return Movie(noisy.join(signal, ["frame", "px"], "left").select(video.alias("video_id"), "frame", "px", value.alias("value")), side, side)


# Segments, videos, crops


def segment_summary(movie: Movie, segments: int) -> DataFrame:
    """(video_id, frames, height, width, segments, longest): what a movie cut into segments amounts to, a row a video."""
    lengths = video_lengths(movie).select("video_id", F.col("n").alias("frames"))
    longest = F.ceil(F.col("frames") / segments).cast("long")
    return lengths.select("video_id", "frames", F.lit(movie.height).alias("height"), F.lit(movie.width).alias("width"), F.ceil(F.col("frames") / longest).cast("int").alias("segments"), longest.alias("longest"))


def segment_length(frames: int, segments: int) -> int:
    return -(-frames // segments)


def segment_of(frame: Column, frames: Column | int, segments: int) -> Column:
    """Segment (from 1) of a local frame: runs of ceil(frames / segments)."""
    per = F.ceil((frames if isinstance(frames, Column) else F.lit(frames)) / segments)
    return (F.floor((frame - 1) / per) + 1).cast("int")


def segment_ranges(frames: DataFrame, segments: int) -> DataFrame:
    """(…, seg, lo, hi) for each row with ``n`` frames; trailing segments may be empty (hi < lo)."""
    per = F.ceil(F.col("n") / segments)
    return frames.withColumn("seg", F.explode(F.sequence(F.lit(1), F.lit(segments)))).select(
        *frames.columns, "seg", ((F.col("seg") - 1) * per + 1).alias("lo"), F.least(F.col("seg") * per, F.col("n")).alias("hi")
    )


def video_lengths(movie: Movie) -> DataFrame:
    """(video_id, n, first, last): frames of each video and its global range."""
    return movie.rows.groupBy("video_id").agg(
        F.count_distinct("frame").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last")
    )


def video_offsets(lengths: DataFrame) -> DataFrame:
    """Frames before each video (one row a video is ordered)."""
    before = F.sum("n").over(Window.orderBy("video_id").rowsBetween(Window.unboundedPreceding, -1))
    return lengths.withColumn("offset", F.coalesce(before, F.lit(0)))


def crop(rows: DataFrame, height: int, d1: tuple[int, int], d2: tuple[int, int]) -> DataFrame:
    """The box of zero-based inclusive ranges, in its own pixel numbers; crops compose."""
    at1, at2 = row_of(F.col("px"), height), column_of(F.col("px"), height)
    inside = at1.between(*d1) & at2.between(*d2)
    return rows.where(inside).withColumn("px", pixel(at1 - d1[0], at2 - d2[0], d1[1] - d1[0] + 1))


def union_videos(parts: list[DataFrame]) -> DataFrame:
    """Videos with local frames one after another: video numbers and global frames."""
    tagged = [p.withColumn("video_id", F.lit(k)) for k, p in enumerate(parts, 1)]
    lengths = reduce(DataFrame.unionByName, [t.groupBy("video_id").agg(F.max("frame").alias("n")) for t in tagged])
    both = reduce(DataFrame.unionByName, tagged)
    return both.join(video_offsets(lengths).select("video_id", "offset"), "video_id").withColumn("frame", F.col("frame") + F.col("offset")).drop("offset")


ALIGNMENT = "filename string, left int, right int, top int, bottom int"


def aligned(rows: DataFrame, boxes: DataFrame, height: int) -> DataFrame:
    """Crop each video (column filename) to its box (1-based, inclusive; left and right along the first axis).

    All boxes must be of one size, or the query fails.
    """
    sizes = boxes.agg(
        F.count_distinct(F.struct(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))).alias("k"),
        F.first(F.col("right") - F.col("left") + 1).alias("h"),
    )
    sizes = sizes.select(F.when(F.assert_true(F.col("k") == 1, F.lit("frame sizes differ")).isNull(), F.col("h")).alias("h"))
    at1, at2 = row_of(F.col("px"), height) + 1, column_of(F.col("px"), height) + 1
    inside = at1.between(F.col("left"), F.col("right")) & at2.between(F.col("top"), F.col("bottom"))
    placed = (at1 - F.col("left") + (at2 - F.col("top")) * F.col("h")).cast("int")
    boxed = boxes.join(sizes, F.lit(True))
    return rows.join(boxed, "filename").where(inside).select("filename", "frame", placed.alias("px"), "value")


def single_key(keys: DataFrame, column: str = "key") -> DataFrame:
    """The one key of a container; any other number of keys fails."""
    counted = keys.agg(F.count_distinct(column).alias("n"), F.first(column).alias(column))
    return counted.select(F.when(F.col("n") == 1, F.col(column)).otherwise(F.raise_error(F.lit("expected one dataset"))).alias(column))


def empty_movie(spark: SparkSession) -> Movie:
    """No frames of 100 x 100."""
    return Movie(spark.createDataFrame([], LONG), 100, 100, spark.createDataFrame([], PACKED))


def open_kind(path: Column) -> Column:
    """What a path opens as, by its suffix: nwb, hdf (.hdf, .hdf5, .h5), parquet or empty."""
    return (
        F.when(path.endswith(".nwb"), "nwb")
        .when(path.endswith(".hdf") | path.endswith(".hdf5") | path.endswith(".h5"), "hdf")
        .when(path.endswith(".parquet"), "parquet")
        .otherwise("empty")
    )


def open_movie(spark: SparkSession, path: str, height: int, width: int) -> Movie:
    """A movie stored as packed Parquet, or an HDF5 file through the optional reader.

    A path of any other kind is the empty movie. A missing file, or a missing
    reader for a recording, fails: no movie is taken for an empty one.
    """
    if path.endswith((".nwb", ".hdf", ".hdf5", ".h5")):
        from fovea.sources import hdf

        if not hdf.available():
            raise RuntimeError(f"h5py is needed to open {path}")
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        return hdf.open_hdf(spark, path)
    if not path.endswith(".parquet"):
        return empty_movie(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    packed = spark.read.schema(PACKED).parquet(path)
    return Movie(exploded(packed), height, width, packed)
