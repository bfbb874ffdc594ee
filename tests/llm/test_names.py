"""Columns of any name and kind come through the functions from documents to documents."""

import pytest
from pyspark.sql import functions as F

from fovea.llm import decontamination, near_copies, secret_scan

from .conftest import OWN

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
SECRET = 'password = "kX9vQ2mZ7pL4wR8tB3nC" and more words behind it'


def works(spark, monkeypatch):
    benchmark = spark.createDataFrame([(1, LONG), (2, "one two three four five six seven eight nine")], "item_id long, text string")

    def several(docs):
        with monkeypatch.context() as m:
            m.setattr(decontamination, "MAX_ITEMS", 1)
            return decontamination.without_leaks(docs, benchmark)

    return {
        "near copies": near_copies.one_of_each, "secrets": secret_scan.redacted,
        "leaks, one index": lambda d: decontamination.without_leaks(d, benchmark), "leaks, several": several,
    }


@pytest.mark.parametrize("name", ["near copies", "secrets", "leaks, one index", "leaks, several"])
def test_any_names(spark, docs, monkeypatch, name):
    """All names of the sources, a map, an array, and rows that repeat: the same rows as without them, each with what it had."""
    assert len(OWN) > 20 and "__may" in OWN and "__found" in OWN and "__key_a" in OWN
    work = works(spark, monkeypatch)[name]
    rows = [(1, LONG), (1, LONG), (2, LONG + " nu"), (3, SECRET), (3, SECRET), (4, None), (5, "quite another text of seven words here"), (None, "no id at all but words")]
    plain = docs(rows)
    want = sorted(map(str, work(plain).collect()))
    other = plain
    for k, n in enumerate(OWN):
        other = other.withColumn(n, F.lit(k))
    other = other.withColumns({"own_5_id": F.lit("x"), "map": F.create_map(F.lit("a"), F.col("doc_id")), "list": F.array("doc_id")})
    out = work(other)
    assert out.columns == other.columns
    got = out.collect()
    assert sorted(str(type(r)(**{c: r[c] for c in plain.columns})) for r in got) == want
    assert all(r[n] == k for r in got for k, n in enumerate(OWN)) and all(r["list"] == [r["doc_id"]] and r["map"] == {"a": r["doc_id"]} for r in got)
