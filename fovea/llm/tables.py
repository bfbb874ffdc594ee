"""Shared helpers: reading tables, vocabulary files, slicing Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from fovea.functions.lineage import saved  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file, the default of the operators' ``vocabulary``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def keeps_names(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a function from documents to documents with the same columns, which names its own columns ``__…``: columns of the user that begin so have other names while it runs."""

    @wraps(work)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        if not any(n.startswith("__") for n in names):
            return work(docs, *args, **kwargs)
        taken, other = {n.lower() for n in names}, []
        for k, name in enumerate(names):
            new = name
            while new.startswith("__") or (new != name and new.lower() in taken):
                new = f"own_{k}_{new.lstrip('_')}"
            taken.add(new.lower())
            other.append(new)
        return work(docs.toDF(*other), *args, **kwargs).toDF(*names)

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pa.compute.binary_length(batch.column(at)).fill_null(0).to_pylist()
        start = held = 0
        for k, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        yield batch.slice(start)
        pa.default_memory_pool().release_unused()
