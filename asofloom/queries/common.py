"""What the queries share."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..boundary import q
from ..loom import Loom

DATES = ["1997-01-01", "1999-01-01", "2001-01-01"]
DIGITS = 6


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df, digits=DIGITS):
    """Numbers as the SQL gives them: doubles rounded, without a negative zero, and whole numbers as bigint.

    As in DuckDB, round() multiplies, rounds and divides, which isn't the nearest decimal for large numbers; what the product is too large for stays as it is.
    """
    out, scale = [], 10.0**digits
    for f in df.schema:
        c = q(f.name)
        if isinstance(f.dataType, T.FloatType | T.DoubleType | T.DecimalType):
            c = c.cast("double")
            c = F.when(F.abs(c * scale) < math.inf, F.round(c * scale) / scale).otherwise(c) + 0.0
        elif isinstance(f.dataType, T.ByteType | T.ShortType | T.IntegerType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def loom(spark, sf_dir, config, dates=DATES, tables=None):
    return Loom({"intervals": [], "relationships": []} | config, spark, dates, tables, sf_dir)


def r(expression, digits=DIGITS):
    """SQL for a rounded double."""
    return f"round(({expression})::double, {digits}) + 0.0"


def dates_sql(dates=DATES):
    return "a as (select unnest([" + ", ".join(f"date '{d}'" for d in dates) + "]) as as_of_date)"
