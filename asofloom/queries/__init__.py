"""One query for each operator, over the whole of its tables, with the DuckDB SQL that gives the same rows."""

from . import aggregations, bridges, structure, transformations

PARTS = (structure, aggregations, transformations, bridges)
QUERIES = {n: f for p in PARTS for n, f in p.QUERIES.items()}
SQL = {n: s for p in PARTS for n, s in p.SQL.items()}
