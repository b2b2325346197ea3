"""Ranks and scores in a whole population, without a window that has no partition."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..boundary import q
from ..functions.aggregations import nz


def ordered_bucket(x):
    """A long that never falls as ``x`` grows: sign, binary exponent and 16 bits of the mantissa. Equal values have equal buckets; infinities have their own, null and NaN are last."""
    exponent = F.floor(F.log2(F.abs(x)))
    scaled = F.floor(F.abs(x) / F.pow(F.lit(2.0), exponent) * 65536.0)  # 65536 .. 131071
    magnitude = F.when(x == 0, F.lit(0.0)).otherwise((exponent + 1100) * 131072.0 + scaled)
    infinite = F.abs(x) == float("inf")
    return F.when(x.isNull() | F.isnan(x), F.lit(1 << 40)).when(infinite, F.when(x > 0, F.lit(1 << 39)).otherwise(F.lit(-(1 << 39)))).otherwise((F.signum(x) * magnitude).cast("long"))


def ranked(df, column, scope, name, by=(), base=None):
    """Adds ``name``: how many rows of the same scope are smaller, and ``name|n``: how many rows it has.

    Values are bucketed by their leading bits; the rows before a bucket come from the buckets' counts, those in it from a window over one
    bucket. So no task holds a whole population, unless it is nearly constant. Null and NaN come last. ``base`` has the same rows as ``df``
    before other ranks were added: counting there keeps the plan of several ranks from doubling with each.
    """
    scope = [*scope, *by]
    parts = [q(c) for c in scope]
    bucket = ordered_bucket(q(column).cast("double")).alias("__b")
    counts = (df if base is None else base).groupBy(*parts, bucket).agg(F.count("*").alias("__n"))
    df = df.withColumn("__b", bucket)
    over = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    up = over.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(c.alias(f"__s{i}") for i, c in enumerate(parts)), F.col("__b").alias("__bb"), F.coalesce(F.sum("__n").over(up), F.lit(0)).alias("__before"), F.sum("__n").over(over).alias("__all"))
    on = F.col("__b") == F.col("__bb")
    for i, c in enumerate(parts):
        on = on & c.eqNullSafe(F.col(f"__s{i}"))
    joined = df.join(counts, on, "left").drop("__bb", *(f"__s{i}" for i in range(len(parts))))
    x = q(column).cast("double")
    within = F.rank().over(Window.partitionBy(*parts, "__b").orderBy(F.when(~F.isnan(x), x).asc_nulls_last()))
    return joined.withColumn(name, F.col("__before") + within - 1).withColumn(f"{name}|n", F.col("__all")).drop("__b", "__before", "__all")


def population_rank(df, column, scope, name, base=None):
    """Adds the relative rank, (smaller rows) / (rows - 1), 0 for a single row."""
    df = ranked(df, column, scope, f"{name}|r", base=base)
    score = F.when(q(f"{name}|r|n") <= 1, F.lit(0.0)).otherwise(q(f"{name}|r") / (q(f"{name}|r|n") - 1))
    return df.withColumn(name, score).drop(f"{name}|r", f"{name}|r|n")


def population_scores(df, column, scope, name, base=None):
    """Adds (x - mean) / standard deviation; the moments of a scope are a broadcast row."""
    x = q(column).cast("double")
    moments = (df if base is None else base).groupBy(*map(q, scope)).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__d"))
    if scope:
        moments = moments.select(*(q(c).alias(f"__s{i}") for i, c in enumerate(scope)), "__m", "__d")
        on = F.lit(True)
        for i, c in enumerate(scope):
            on = on & (q(c) == F.col(f"__s{i}"))
        joined = df.join(F.broadcast(moments), on, "left").drop(*(f"__s{i}" for i in range(len(scope))))
    else:
        joined = df.crossJoin(F.broadcast(moments))
    return joined.withColumn(name, (x - F.col("__m")) / nz(F.col("__d"))).drop("__m", "__d")
