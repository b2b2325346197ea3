"""Direct and as-of transfers of a parent's columns onto its children's rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..boundary import AS_OF, back, q


def _scope(left, right):
    return [AS_OF] if AS_OF in left.columns and AS_OF in right.columns else []


def transfer(df, parent, key, parent_key, columns):
    """A left join; ``columns`` are (name in the parent, name in the result) pairs. Catalyst broadcasts a small parent."""
    scope = _scope(df, parent)
    right = parent.select(q(parent_key).alias("__key"), *(q(c).alias(f"__{c}") for c in scope), *(q(a).alias(f"__d{i}") for i, (a, _) in enumerate(columns)))
    on = q(key) == q("__key")
    for c in scope:
        on = on & (q(c) == q(f"__{c}"))
    joined = df.join(right, on, "left")
    return joined.select(*map(q, df.columns), *(q(f"__d{i}").alias(b) for i, (_, b) in enumerate(columns)))


def as_of_join(df, parent, key, parent_key, ts, parent_ts, columns, grace=None, tiebreak=None):
    """Each row's latest parent row of the same key that isn't later than the row itself, nor older than ``grace`` before it.

    Both sides are put in one frame and sorted by key and time once; the latest parent row is then carried forward. There is no join, so
    neither the number of matches nor an inequality matters. Of parent rows of one time the greatest tiebreak wins. Rows with a null key
    or time match nothing; they are spread by a hash of the row, so that no task gets all of them.
    """
    scope = _scope(df, parent)
    lent = F.struct(q(parent_ts).alias("__t"), *(q(a).alias(f"__d{i}") for i, (a, _) in enumerate(columns)))
    own = F.struct(*(q(c).alias(f"__c{i}") for i, c in enumerate(df.columns)))
    keyed = [c for c in scope]
    tie = q(tiebreak) if tiebreak else F.lit(None)
    right = parent.where(q(parent_key).isNotNull() & q(parent_ts).isNotNull()).select(
        q(parent_key).alias("__k"), *map(q, keyed), q(parent_ts).cast("timestamp_ntz").alias("__at"), F.lit(0).alias("__side"), tie.cast("string").alias("__tie") if tiebreak is None else tie.alias("__tie"), lent.alias("__lent")
    )
    kind = dict(df.dtypes)
    hashable = [q(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    alone = F.when(q(key).isNull() | q(ts).isNull(), F.xxhash64(*hashable))
    left = df.select(q(key).alias("__k"), *map(q, keyed), alone.alias("__alone"), q(ts).cast("timestamp_ntz").alias("__at"), F.lit(1).alias("__side"), own.alias("__own"))
    both = right.unionByName(left, allowMissingColumns=True)
    w = Window.partitionBy("__k", *map(q, keyed), "__alone").orderBy(F.col("__at").asc_nulls_first(), "__side", F.col("__tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("__side", "__own", F.when(F.col("__k").isNotNull() & F.col("__at").isNotNull(), F.last("__lent", True).over(w)).alias("__lent"), "__at").where("__side = 1")
    fresh = F.lit(True) if not grace else F.col("__lent.__t").cast("timestamp_ntz") >= back(F.col("__at"), grace)
    return filled.select(*(F.col(f"__own.__c{i}").cast(kind[c]).alias(c) for i, c in enumerate(df.columns)), *(F.when(fresh, F.col(f"__lent.__d{i}")).alias(b) for i, (_, b) in enumerate(columns)))
