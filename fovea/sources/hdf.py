"""HDF5 recordings through ``h5py``, where it is installed: frames are read in the tasks, in runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession

from fovea.sources.movies import PACKED, Movie, exploded

RUN = 256


def available() -> bool:
    try:
        import h5py  # noqa: F401
    except ImportError:
        return False
    return True


def dataset_key(file, path: str) -> str:
    """``images`` of an .hdf file; the data of the one group under ``/analysis`` of an .nwb file."""
    if not path.endswith(".nwb"):
        return "images"
    keys = list(file["analysis"])
    if len(keys) != 1:
        raise ValueError(f"expected one key under /analysis, found {len(keys)}")
    return f"analysis/{keys[0]}/data"


def open_hdf(spark: SparkSession, path: str, video_id: int = 1) -> Movie:
    """A recording (d1, d2, frames) on storage that all executors see; pixels are column-major."""
    import h5py

    with h5py.File(path) as file:
        key = dataset_key(file, path)
        frames, width, height = file[key].shape  # the axes are reversed in Python

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import h5py

        with h5py.File(path) as file:
            for starts in batches:
                for start in starts["id"]:
                    block = file[key][start : start + RUN].astype("float32").reshape(-1, width * height)
                    yield pd.DataFrame({"video_id": video_id, "frame": range(start + 1, start + 1 + len(block)), "pixels": list(block)})

    packed = spark.range(0, frames, RUN).mapInPandas(run, PACKED)
    return Movie(exploded(packed), height, width, packed)
