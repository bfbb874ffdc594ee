"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    An application without the setting gets a temporary folder of its own if
    it runs in one process, as in tests; on a cluster it fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    name = spark.sparkContext.applicationId
    if name not in _own:
        _own[name] = "file://" + tempfile.mkdtemp(prefix="fovea-scratch-")
    return _own[name]


def own_folder(spark: SparkSession) -> str:
    """Where this application writes its tables."""
    return f"{scratch(spark).rstrip('/')}/fovea/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has saved; results that read them must have been written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; a filter on a column of ``by`` reads only its folders.

    The result has no lineage: a lost executor costs a re-read, not a re-run,
    and what was decided by row order (partition ids, samples) stays decided.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``saved``, dealt by ``key`` as a join on it would deal the rows, so such joins move only their other side."""
    spark = df.sparkSession
    table, path = f"fovea_{uuid.uuid4().hex}", f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)
