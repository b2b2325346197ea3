import decimal
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from asofloom import tuned

    at = tmp_path_factory.mktemp("spark")
    builder = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1")
    builder = builder.config("spark.sql.warehouse.dir", str(at / "warehouse")).config("spark.checkpoint.dir", str(at / "shared")).config("spark.ui.showConsoleProgress", "false")
    s = tuned(builder, 4).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


#: Relative and absolute difference up to which two engines' floating-point results are the same.
RELATIVE, ABSOLUTE = 1e-7, 2e-6


def plain(v):
    """A cell in a form that is the same from either engine; numbers stay numbers."""
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        return float(v)
    return str(v).replace(" 00:00:00", "")


class Rows(list):
    """Sorted rows that equal others if all cells do, numbers within the tolerance."""

    def __eq__(self, other):
        return len(self) == len(other) and all(len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True)) for a, b in zip(self, other, strict=True))

    __hash__ = None


def same(x, y):
    return math.isclose(x, y, rel_tol=RELATIVE, abs_tol=ABSOLUTE) if isinstance(x, float) and isinstance(y, float) else x == y


def rows_of(df):
    """A Spark DataFrame's or DuckDB relation's columns by name, and its rows, sorted: whole numbers and words first, fractions last."""
    if hasattr(df, "toPandas"):
        names, rows = df.columns, [tuple(r) for r in df.collect()]
    else:
        names, rows = df.columns, df.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in rows]
    fraction = lambda x: isinstance(x, float) and not x.is_integer()
    loose = [any(fraction(r[i]) for r in rows) for i in range(len(names))]
    key = lambda r: ([str(x) for x, f in zip(r, loose, strict=True) if not f], [f"{x:.6g}" if isinstance(x, float) else x for x, f in zip(r, loose, strict=True) if f])
    return sorted(names), Rows(sorted(rows, key=key))
