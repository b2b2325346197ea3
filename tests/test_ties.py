"""Queries on tables at which they differed from their SQL: rows of one time, equal frequencies, numbers beyond 1e15."""

import duckdb

from asofloom.queries import QUERIES, SQL

from .conftest import rows_of


def table(tmp_path, name, query):
    """A folder with one table, and a DuckDB connection that has it."""
    c = duckdb.connect()
    c.execute(f"copy ({query}) to '{tmp_path}/{name}.parquet' (format parquet)")
    c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    return c


EVENTS = "select (row_number() over ())::bigint as event_id, timestamp '2024-01-01' + to_seconds(s) as ts, u::bigint as user_id, 'view' as event_type, v::double as value, '' as props from (values {}) t(u, s, v)"


def test_change_point_of_equal_times(spark, tmp_path):
    values = [(u, 86400 * (i // 3), v) for u in (1, 2) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8 * u])]
    c = table(tmp_path, "events", EVENTS.format(", ".join(map(str, values))))
    assert rows_of(QUERIES["bridge_change_point"](spark, str(tmp_path))) == rows_of(c.sql(SQL["bridge_change_point"]))


#: Counts by day of users of the test tables, for whom several frequencies have equal power.
TIED = {
    281: [5, 3, 1, 3, 3, 0, 0, 2, 4, 6, 2, 2, 3, 3, 2, 3, 1, 1, 2, 6, 0, 3, 2, 2, 1, 5, 1, 2, 1, 1],
    357: [5, 0, 3, 4, 3, 1, 6, 2, 0, 6, 2, 4, 1, 0, 1, 1, 2, 4, 4, 2, 2, 2, 4, 3, 2, 1, 1, 4, 3, 3],
    1076: [3, 1, 3, 3, 1, 1, 2, 1, 3, 1, 3, 1, 0, 0, 4, 3, 2, 5, 0, 0, 2, 2, 3, 1, 2, 1, 4, 2, 3, 3],
    1091: [2, 3, 2, 1, 2, 3, 1, 0, 2, 2, 1, 5, 1, 1, 1, 4, 2, 5, 1, 2, 2, 0, 2, 3, 3, 1, 1, 0, 1, 2],
    1247: [1, 2, 2, 0, 4, 2, 1, 2, 2, 1, 3, 2, 2, 2, 2, 2, 1, 1, 1, 4, 2, 2, 1, 2, 2, 6, 1, 1, 3, 3],
}


def test_periodicity_of_equal_powers(spark, tmp_path):
    values = [(u, 86400 * d + i, 1) for u, days in TIED.items() for d, n in enumerate(days) for i in range(n)]
    c = table(tmp_path, "events", EVENTS.format(", ".join(map(str, values))))
    got, want = rows_of(QUERIES["bridge_periodicity"](spark, str(tmp_path))), rows_of(c.sql(SQL["bridge_periodicity"]))
    assert got == want


def test_exp_to_the_last_bit(spark, tmp_path):
    values = [(i, i, x) for i, x in enumerate([0, 1, -1, 122.79, 66.77, 105.9, 180.4, 62.7, 64.3, 709.5, 710, -800, *(k / 7 for k in range(1000))])]
    c = table(tmp_path, "events", EVENTS.format(", ".join(map(str, values)) + ", (9999, 1, null)"))
    got = {r["event_id"]: r["value"] for r in QUERIES["xf_exp"](spark, str(tmp_path)).collect()}
    assert got == dict(c.sql(SQL["xf_exp"]).fetchall())
