import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, an extra column whose name clashes with results."""
    long = "the of and word " * 60_000
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "the same text of the week", "en"), (4, "the same text of the week", "en"), (5, "the same text of the week", "en"), (None, "no id here", "en"), (6, long, "en"), (7, "!!! ???", "de"), (8, "x" * 300_000, None)]
    return spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], DOCS).withColumns({"score": F.lit("clash"), "n_tokens": F.lit("clash"), "shard": F.lit(1), "group_id": F.lit("clash")})
