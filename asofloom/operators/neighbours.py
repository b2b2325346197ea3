"""Features of the neighbours one edge away, with both the edge and the neighbour's state known at the as-of date."""

from pyspark.sql import functions as F

from ..boundary import AS_OF, q, within


def features(c, entity, spec, columns):
    """Rows (as_of_date, __node, features). A neighbour counts once for each edge and known state row."""
    e = spec.edges
    raw = c.tables(e["table"]).select(q(e["source"]).alias("s"), q(e["target"]).alias("t"), q(e["timestamp"]).alias("ts"))
    ends = [F.struct(F.col("s").alias("a"), F.col("t").alias("b"))] + ([] if spec.directed else [F.struct(F.col("t").alias("a"), F.col("s").alias("b"))])
    edges = c.dated(raw.select("ts", F.explode(F.array(*ends)).alias("x")).select(F.col("x.a").alias("__node"), F.col("x.b").alias("n"), "ts").where("__node is not null"), "ts")
    degree = [F.count_if(within(F.col("ts"), i, mode=c.mode)).alias(n) for f, i, n in columns if f == "degree"]
    states = [(f, m, n) for f, m, n in columns if f != "degree"]
    own = edges.groupBy(AS_OF, "__node").agg(*(degree or [F.count("*").alias("__edges")]))
    if states:
        right = c.planner.graph.entities[spec.right or spec.left]
        ts = [q(right.temporal_ix).alias("state_ts")] if right.temporal_ix else []
        measures = list(dict.fromkeys(m for _, m, _ in states))
        state = c.tables(right.table).select(q(right.id).alias("n"), *ts, *(q(m).cast("double" if dict((x, f) for f, x, _ in states)[m] == "neighbour_mean" else "int").alias(f"m{i}") for i, m in enumerate(measures)))
        joined = edges.join(state, "n")
        if ts:
            joined = joined.where(within(F.col("state_ts"), None, mode=c.mode))
        means = joined.groupBy(AS_OF, "__node").agg(*(F.avg(f"m{measures.index(m)}").alias(n) for _, m, n in states))
        own = own.join(means, [AS_OF, "__node"], "left")
    return own.drop("__edges")
