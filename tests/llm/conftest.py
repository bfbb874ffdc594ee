import glob
import os
import re

import pytest

import fovea.llm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASHES = (
    "score", "size", "shard", "slot", "fp", "component_id", "predicted", "y", "part", "at", "start", "ids", "x", "a", "b", "c", "f", "rank", "word", "members", "gone_id", "gone_text", "repeated_id",
    "labelled_id", "labelled", "id", "quality", "label", "form", "print", "row", "text_key", "first", "root", "times", "key", "found", "candidate", "similarity", "item_id", "lang_pred", "held_out", "n_tokens",
)


#: Every name with two underscores in front that the sources use, whether for a column or not.
OWN = sorted({n for path in glob.glob(os.path.join(os.path.dirname(fovea.llm.__file__), "*.py")) for n in re.findall(r"__[a-z_]*[a-z]", open(path).read())})


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) pairs."""

    def build(rows, clashing=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if clashing:
            for k, name in enumerate(CLASHES):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit(k))
        return df

    return build


#: Null, empty and blank texts, null ids, repeated rows, ties and a very long text.
def hard_rows():
    long = " ".join(f"word{k % 977} and {k % 13}" for k in range(40_000))
    return [
        (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two"), (6, "The quick brown fox jumps over the lazy dog."), (6, "The quick brown fox jumps over the lazy dog."),
        (7, "The quick brown fox jumps over the lazy dog."), (None, "no id here but text all the same"), (8, long), (9, "x" * 50_000), (10, "中文 café \U0001f600 don't they'll 123,456"),
        (11, "<|endoftext|> inside <|endoftext|>"), (12, "!!! ??? 123"), (None, None),
    ]
