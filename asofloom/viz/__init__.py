"""Statistics of a matrix that plots are made of. They are computed in Spark; only their small results reach the driver."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..boundary import AS_OF, q


def numeric_columns(df, keys=()):
    return [f.name for f in df.schema if f.name not in keys and f.name != AS_OF and isinstance(f.dataType, T.NumericType)]


def summary_table(df, columns=None):
    """Count, missing share, mean, deviation, extremes and quartiles of each column, in one pass."""
    columns = columns or numeric_columns(df)
    cells = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        cells += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"sd{i}"), F.min(x).alias(f"min{i}"), F.percentile_approx(x, [0.25, 0.5, 0.75]).alias(f"q{i}"), F.max(x).alias(f"max{i}")]
    r = df.agg(*cells).first()
    out = [(c, r[f"n{i}"], 1 - r[f"n{i}"] / r["rows"] if r["rows"] else None, r[f"mean{i}"], r[f"sd{i}"], r[f"min{i}"], *(r[f"q{i}"] or [None] * 3), r[f"max{i}"]) for i, c in enumerate(columns)]
    return pd.DataFrame(out, columns=["column", "count", "missing", "mean", "sd", "min", "q25", "median", "q75", "max"])


def variance(df, columns=None):
    """Columns by falling variance."""
    s = summary_table(df, columns)
    return s.assign(variance=s["sd"] ** 2)[["column", "variance"]].sort_values("variance", ascending=False, ignore_index=True)


def missing(df, columns=None, over_time=False):
    """The missing share of each column; with ``over_time`` for each as-of date."""
    columns = columns or [c for c in df.columns if c != AS_OF]
    cells = [F.avg(q(c).isNull().cast("int")).alias(c) for c in columns]
    return (df.groupBy(AS_OF).agg(*cells).orderBy(AS_OF) if over_time else df.agg(*cells)).toPandas()


def correlation(df, columns=None):
    """Pearson correlations over rows where both are there: one pass over all pairs."""
    columns = columns or numeric_columns(df)
    cells = []
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            x, y = q(a).cast("double"), q(columns[j]).cast("double")
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            cells.append((F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias(f"{i}_{j}"))
    r = df.agg(*cells).first().asDict() if cells else {}
    out = np.full((len(columns), len(columns)), np.nan)
    for k, v in r.items():
        i, j = map(int, k.split("_"))
        out[i, j] = out[j, i] = math.nan if v is None else v
    return pd.DataFrame(out, columns, columns)


def clustered(corr):
    """The columns in the order of an average-linkage clustering of 1 - |correlation|, and its merges (a, b, distance, size)."""
    d = 1 - np.abs(np.nan_to_num(corr.to_numpy()))
    groups, merges = {i: [i] for i in range(len(d))}, []
    while len(groups) > 1:
        keys = sorted(groups)
        a, b = min(((x, y) for k, x in enumerate(keys) for y in keys[k + 1 :]), key=lambda p: d[np.ix_(groups[p[0]], groups[p[1]])].mean())
        merges.append((a, b, float(d[np.ix_(groups[a], groups[b])].mean()), len(groups[a]) + len(groups[b])))
        groups[len(d) + len(merges) - 1] = groups.pop(a) + groups.pop(b)
    order = next(iter(groups.values()), [])
    return [corr.columns[i] for i in order], merges


def redundancy(corr, threshold=0.9):
    """Pairs of columns whose correlation is at least ``threshold``, either way."""
    names = list(corr.columns)
    return [(a, b, float(corr.loc[a, b])) for i, a in enumerate(names) for b in names[i + 1 :] if abs(corr.loc[a, b]) >= threshold]


def histogram(df, column, bins=20):
    """(lower edge, upper edge, rows) of equal bins between the extremes."""
    x = q(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return []
    width = (hi - lo) / bins or 1.0
    k = F.least(F.lit(bins - 1), F.floor((x - lo) / width).cast("int"))
    counts = {r["k"]: r["n"] for r in df.where(x.isNotNull()).groupBy(k.alias("k")).agg(F.count("*").alias("n")).collect()}
    return [(lo + i * width, lo + (i + 1) * width, counts.get(i, 0)) for i in range(bins)]


def importance(df, target, columns=None, kind="f_regression", bins=10):
    """Columns by what each alone tells of ``target``: f_regression, f_classif, or mutual_info over deciles."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    scores = []
    for c in columns:
        x, y = q(c).cast("double"), q(target)
        d = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
        if kind == "f_regression":
            r = d.agg((F.covar_pop("x", F.col("y").cast("double")) / F.nullif(F.stddev_pop("x") * F.stddev_pop(F.col("y").cast("double")), F.lit(0.0))).alias("r"), F.count("*").alias("n")).first()
            scores.append(None if r["r"] is None or r["n"] < 3 else math.inf if r["r"] ** 2 >= 1 else r["r"] ** 2 / (1 - r["r"] ** 2) * (r["n"] - 2))
        elif kind == "f_classif":
            g = d.groupBy("y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
            rows = g.collect()
            n, k = sum(r["n"] for r in rows), len(rows)
            mean = sum(r["n"] * r["m"] for r in rows) / n if n else 0
            between, within = sum(r["n"] * (r["m"] - mean) ** 2 for r in rows), sum(r["n"] * r["v"] for r in rows)
            scores.append(None if k < 2 or n <= k else math.inf if not within else between / (k - 1) / (within / (n - k)))
        elif kind == "mutual_info":
            edges = d.agg(F.percentile_approx("x", [i / bins for i in range(1, bins)]).alias("e")).first()["e"] or []
            b = sum((F.col("x") > F.lit(e)).cast("int") for e in sorted(set(edges))) if edges else F.lit(0)
            rows = d.groupBy(b.alias("b"), "y").agg(F.count("*").alias("n")).collect()
            n, nb, ny = sum(r["n"] for r in rows), {}, {}
            for r in rows:
                nb[r["b"]] = nb.get(r["b"], 0) + r["n"]
                ny[r["y"]] = ny.get(r["y"], 0) + r["n"]
            scores.append(sum(r["n"] / n * math.log(r["n"] * n / (nb[r["b"]] * ny[r["y"]])) for r in rows) if n else None)
        else:
            raise ValueError(f"unknown measure: {kind}")
    return pd.DataFrame({"column": columns, "score": scores}).sort_values("score", ascending=False, ignore_index=True)


def projection(df, keys, columns=None, dims=2):
    """Rows (keys, p1, p2, ...) of a principal component analysis of the standardised columns, missing values at the mean."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    columns = columns or numeric_columns(df, keys)
    means = df.agg(*(F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(columns))).first()
    filled = df.select(*map(q, keys), *(F.coalesce(q(c).cast("double"), F.lit(means[f"m{i}"] or 0.0)).alias(f"x{i}") for i, c in enumerate(columns)))
    v = VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="v").transform(filled)
    s = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(v).transform(v)
    p = PCA(k=dims, inputCol="s", outputCol="p").fit(s).transform(s)
    from pyspark.ml.functions import vector_to_array

    return p.select(*map(q, keys), *(vector_to_array("p")[i].alias(f"p{i + 1}") for i in range(dims)))


def series(df, column, keys=()):
    """Mean and quartiles of a column at each as-of date, or its values for the given (key column, value) pairs."""
    if keys:
        name, value = keys
        return df.where(q(name) == value).select(AS_OF, q(column)).orderBy(AS_OF).toPandas()
    x = q(column).cast("double")
    return df.groupBy(AS_OF).agg(F.avg(x).alias("mean"), *(F.percentile_approx(x, p).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75))).orderBy(AS_OF).toPandas()
