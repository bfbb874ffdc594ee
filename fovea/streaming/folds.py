"""Per-pixel folds over a stream of frames.

Moments and extremes are sums and maxima over frames, so a stream of packed
frames keeps one row of state a pixel, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fovea.functions.columns import image_negentropy
from fovea.sources.movies import PACKED, exploded


def frames(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Packed frames as their Parquet files arrive in a folder."""
    return spark.readStream.schema(PACKED).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_image(packed: DataFrame) -> DataFrame:
    """(px, n, least, greatest, mean, negentropy) of the frames so far; for output mode complete or update."""
    v = F.col("value")
    sums = exploded(packed).groupBy("px").agg(
        F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), *(F.avg(F.pow(v, F.lit(float(k)))).alias(f"x{k}") for k in range(1, 5))
    )
    image = image_negentropy(*(F.col(f"x{k}") for k in range(1, 5)))
    return sums.select("px", "n", "least", "greatest", F.col("x1").alias("mean"), image.alias("negentropy"))


def start(image: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there, into a table of memory; a restart goes on from the checkpoint folder."""
    return image.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
