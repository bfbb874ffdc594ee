"""The stream's image is that of the whole movie."""

import pytest
from helpers import DATA

from fovea.operators import folds
from fovea.sources import movies
from fovea.streaming import folds as streamed


def test_running_image(spark, tmp_path):
    movie = movies.embedding_movie(spark, DATA)
    movie.packed.select("video_id", "frame", "pixels").repartition(6).write.parquet(str(tmp_path / "frames"))
    image = streamed.running_image(streamed.frames(spark, str(tmp_path / "frames"), 2))
    streamed.start(image, "running_image", str(tmp_path / "state")).awaitTermination()
    got = {r["px"]: r for r in spark.table("running_image").collect()}
    want = {r["px"]: r["v"] for r in folds.negentropy(movie.rows).collect()}
    assert len(got) == 64 and all(got[p]["negentropy"] == pytest.approx(v, abs=1e-9) for p, v in want.items())
    assert got[0]["n"] == movie.packed.count()
