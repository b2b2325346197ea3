"""Optional filling of missing values.

Counts that are missing are 0: there was nothing to count. Other measures stay missing unless a statistic of the whole matrix is asked for,
which reads the rows that a model will be tested on and therefore needs ``allow_full_matrix_fit``.
"""

import warnings

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..boundary import q

COUNTS = ("COUNT", "SUM", "NUNIQUE", "N_", "EVENT_RATE")
SUFFIX = "__missing"


def is_count(name, prefixes=COUNTS):
    return str(name).partition("(")[0].strip().upper().startswith(tuple(prefixes))


def guard(strategy, allowed):
    if strategy not in ("none", "mean", "median"):
        raise ValueError(f"measure_strategy {strategy!r} isn't none, mean or median")
    if strategy == "none":
        return
    if not allowed:
        raise ValueError(f"measure_strategy {strategy!r} is fitted on every row, later ones too; pass allow_full_matrix_fit=True to have it all the same")
    warnings.warn(f"{strategy} is fitted on the whole matrix and leaks what comes later", stacklevel=3)


def impute(df, keys=(), measure_strategy="none", allow_full_matrix_fit=False, indicators=True, prefixes=COUNTS):
    """``df`` with missing numbers filled, and a 0/1 column <name>__missing for each column that had any.

    One pass counts what is missing (and fits the statistic); the filling itself is part of the plan that reads the result.
    """
    guard(measure_strategy, allow_full_matrix_fit)
    numeric = [f.name for f in df.schema if f.name not in keys and isinstance(f.dataType, T.NumericType)]
    others = [c for c in df.columns if c not in keys and c not in numeric]
    stats = [F.count_if(q(c).isNull()).alias(f"n{i}") for i, c in enumerate([*numeric, *others])]
    measures = [c for c in numeric if not is_count(c, prefixes)]
    if measure_strategy != "none":
        f = F.avg if measure_strategy == "mean" else lambda x: F.percentile(x, F.lit(0.5))
        stats += [f(q(c)).alias(f"m{i}") for i, c in enumerate(measures)]
    seen = df.agg(*stats).first() if stats else {}
    missing = [c for i, c in enumerate([*numeric, *others]) if seen[f"n{i}"]]
    fill = {c: 0 for c in numeric if is_count(c, prefixes)}
    if measure_strategy != "none":
        fill |= {c: seen[f"m{i}"] for i, c in enumerate(measures) if seen[f"m{i}"] is not None}
    kinds = {f.name: f.dataType for f in df.schema}
    columns = [F.coalesce(q(c), F.lit(fill[c]).cast(kinds[c])).alias(c) if c in missing and c in fill else q(c) for c in df.columns]
    return df.select(*columns, *(q(c).isNull().cast("int").alias(c + SUFFIX) for c in missing if indicators))
