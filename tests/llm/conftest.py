from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators might use inside.
CLASHING = "node long, comp long, value string, `n` long, score string, spans string, shard int, row_number long, block int, `__text` string, kept boolean, start int"


@pytest.fixture
def documents(spark):
    """A documents table of the given (doc_id, text) or (doc_id, text, lang, source) rows."""
    def make(*rows):
        data = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(data, SCHEMA)
    return make


@pytest.fixture
def cluttered(spark):
    """The same table with extra columns of clashing names."""
    def add(df):
        from pyspark.sql import functions as F
        for field in CLASHING.split(", "):
            name, kind = field.replace("`", "").split(" ")
            df = df.withColumn(name, F.lit(None).cast(kind))
        return df
    return add


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a text without an id of its own"), (4, "one"), (5, "same words here again today"), (5, "same words here again today"),
       (6, "Same WORDS here  again\ntoday"), (7, "word " * 30000), (8, "x" * 200000), (9, "ünï © 漢字 🙂   \x00 end"), (10, "<|endoftext|> &amp; +1 (")]


@pytest.fixture
def odd():
    return ODD
