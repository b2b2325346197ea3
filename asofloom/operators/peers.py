"""Features of a row among the other rows of its group, the row itself left out.

The group's sums are computed once and the row's own share is taken off, so nothing is compared pair by pair. Percentiles come from a
bucketed rank, so a large group isn't one task.
"""

from pyspark.sql import functions as F

from ..boundary import AS_OF, known, q
from ..functions.aggregations import nz, ratio
from .ranks import ranked


def features(c, entity, spec, columns):
    """Rows (__node, as_of_date where anything has a time, features). A row with a null group, or a group of which nothing is known, has none."""
    events = [(r, n) for f, r, n in columns if f == "peer_event_rate"]
    measures = list(dict.fromkeys(m for f, m, _ in columns if f not in ("size", "peer_event_rate")))
    timed = bool(entity.temporal_ix) or any(c.planner.graph.entities[r.child].temporal_ix for r, _ in events)
    at = [AS_OF] if timed else []
    raw = c.tables(entity.table)
    rows = raw.select(q(entity.id).alias("__node"), q(spec.by).alias("by"), *([q(entity.temporal_ix).alias("ts")] if entity.temporal_ix else []), *(q(m).cast("double").alias(f"m{i}") for i, m in enumerate(measures))).where("by is not null")
    rows = c.dated(rows) if timed else rows
    rows = rows.withColumn("in", known(F.col("ts"), mode=c.mode).cast("int") if entity.temporal_ix else F.lit(1)).withColumn("in", F.coalesce("in", F.lit(0)))
    for i, (r, _) in enumerate(events):
        rows = rows.join(_counts(c, r, at, f"e{i}"), [*at, "__node"], "left")
    member = F.col("in") == 1
    sums = [F.sum("in").alias("n")]
    for i in range(len(measures)):
        x = F.when(member, F.col(f"m{i}"))
        sums += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"ss{i}")]
    sums += [F.sum(F.when(member, F.coalesce(F.col(f"e{i}"), F.lit(0)))).alias(f"es{i}") for i in range(len(events))]
    groups = rows.groupBy(*at, "by").agg(*sums).where("n > 0")
    rows = rows.join(groups, [*at, "by"])
    wanted = {f for f, _, _ in columns}
    if "peer_pctile" in wanted:
        for i in range(len(measures)):
            rows = rows.withColumns({f"k{i}": F.when(member, F.col(f"m{i}")), f"o{i}": F.when(~member, F.col(f"m{i}"))})
        base = rows
        for i in range(len(measures)):
            # members and the row itself are ranked among members: others get no value here and the number of smaller members below
            rows = ranked(rows, f"k{i}", at, f"r{i}", ("by",), base).drop(f"r{i}|n")
            if entity.temporal_ix:
                rows = _rank_of_outsiders(rows, at, i, base)
    n = F.col("n") - F.col("in")
    out = []
    for f, detail, name in columns:
        if f == "size":
            value = n
        elif f == "peer_event_rate":
            i = [r for r, _ in events].index(detail)
            value = ratio(F.col(f"es{i}") - F.col("in") * F.coalesce(F.col(f"e{i}"), F.lit(0)), n)
        else:
            i = measures.index(detail)
            x = F.col(f"m{i}")
            own = F.when(member, F.coalesce(x, F.lit(0.0))).otherwise(F.lit(0.0))
            # null where the row's own measure is missing
            total, squares = (F.when(x.isNotNull(), F.col(f"{k}{i}") - o) for k, o in (("s", own), ("ss", own * own)))
            mean = ratio(total, n)
            spread = F.sqrt(F.greatest((squares - total * total / nz(n.cast("double"))) / nz((n - 1).cast("double")), F.lit(0.0)))
            value = {"peer_mean": mean, "ego_minus_peer_mean": x - mean, "peer_zscore": (x - mean) / nz(spread), "peer_pctile": ratio(F.when(x.isNotNull(), F.col(f"r{i}")).otherwise(0), n) if f == "peer_pctile" else None}[f]
        out.append(value.alias(name))
    return rows.select(*at, "__node", *out)


def _counts(c, r, at, name):
    child = c.planner.graph.entities[r.child]
    rows = c.tables(child.table).select(q(r.child_key).alias("__node"), *([q(child.temporal_ix).alias("ts")] if child.temporal_ix else [])).where("__node is not null")
    rows = c.dated(rows, "ts" if child.temporal_ix else None) if at else rows
    return rows.groupBy(*at, "__node").agg(F.count("*").alias(name))


def _rank_of_outsiders(rows, at, i, base):
    """Rows that aren't known yet are compared with the members that are: they are ranked in all rows, less the unknown ones before them."""
    both = ranked(rows, f"m{i}", at, f"all{i}", ("by",), base).drop(f"all{i}|n")
    out = ranked(both, f"o{i}", at, f"out{i}", ("by",), base).drop(f"out{i}|n")
    return out.withColumn(f"r{i}", F.when(F.col("in") == 1, F.col(f"r{i}")).otherwise(F.col(f"all{i}") - F.col(f"out{i}"))).drop(f"all{i}", f"out{i}")
