"""Transformations of an entity's own rows.

Row-wise ones are scalar expressions. Window ones run over the rows of one entity id in the order of its temporal index, with the id's
other columns as tiebreak; all of an entity's transformations are projected in one select, so windows of one order share one sort.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..boundary import AS_OF, q
from .aggregations import micros, nz
from .registry import register_transformer


class Rows:
    """What a transformation sees of an entity: its id, its order, whether its rows depend on the as-of date."""

    def __init__(self, id, ts, asof, tiebreak=()):
        self.id, self.ts, self.asof, self.tiebreak = id, ts, asof, [t for t in tiebreak if t]

    @property
    def scope(self):
        return [q(AS_OF)] if self.asof else []

    @property
    def unordered(self):
        return Window.partitionBy(*self.scope, q(self.id))

    def order(self, ties=True):
        """ties: rows of equal time are told apart; without, they share a frame, as for running totals."""
        extra = [q(c).asc_nulls_last() for c in dict.fromkeys(self.tiebreak) if c != self.ts] if ties else []
        return self.unordered.orderBy(q(self.ts).asc_nulls_last(), *extra)

    def last(self, n):
        return self.order().rowsBetween(-(n - 1), 0)

    @property
    def population(self):
        return Window.partitionBy(*(self.scope or [F.lit(0)]))


@dataclass
class Transformation:
    name: str
    inputs: tuple
    build: object
    output: str = "numeric"
    windowed: bool = False
    suffixes: tuple = ()
    future: bool = False
    doc: str = ""

    def applies(self, feature):
        return feature.type in self.inputs

    def possible(self, rows):
        return not self.windowed or bool(rows.id and rows.ts)

    def output_type(self, feature):
        return feature.type if self.output == "same" else self.output

    def __call__(self, x, rows):
        return self.build(x, rows)


#: The largest number whose exponential is a double.
LARGEST_EXPONENT = 709.782712893384
ANY = ("numeric", "categorical", "text", "boolean", "date", "timestamp", "vector")
N, TEXT, DATES = ("numeric",), ("text",), ("date", "timestamp", "temporal_ix")


def add(name, inputs, build, doc="", **options):
    return register_transformer(name, Transformation(name, inputs, build, doc=doc, **options))


# ---- scalars

add("identity", ANY, lambda x, r: x, "the column itself", output="same")
def exp(x):
    """e to the power of x, infinite beyond what a double holds, from the C library: in one of twelve values Spark's own differs in the last bit, which is all there is to see where results are large."""

    @F.arrow_udf(T.DoubleType())
    def power(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            v = a.to_numpy(zero_copy_only=False)  # nulls are nan here
            y = np.fromiter(map(math.exp, np.minimum(v, LARGEST_EXPONENT).tolist()), float, len(v))
            yield pa.array(np.where(v > LARGEST_EXPONENT, np.inf, y), mask=a.is_null().to_numpy(zero_copy_only=False))

    return power(x.cast("double"))


for _n, _f in {"abs": F.abs, "exp": exp, "cbrt": F.cbrt, "sign": F.signum, "ceil": F.ceil, "floor": F.floor}.items():
    add(_n, N, lambda x, r, f=_f: f(x).cast("double"), _n)
add("trunc", N, lambda x, r: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"), "integer part")
add("ln", N, lambda x, r: F.when(x > 0, F.ln(x)), "natural logarithm, null where there is none")
add("log", N, lambda x, r: F.when(x > 0, F.log10(x)), "decimal logarithm, null where there is none")
add("sqrt", N, lambda x, r: F.when(x >= 0, F.sqrt(x)), "square root, null where there is none")
add("is_null", ("numeric", "categorical", "date"), lambda x, r: x.isNull(), "whether it is missing", output="boolean")


class InArray(Transformation):
    """Whether a value is one of a list; made by in_array(values)."""


def in_array(values, name="in_array"):
    return InArray(name, ANY, lambda x, r: x.isin(list(values)), output="boolean")


add("in_array", (), lambda x, r: x, "membership in a list; in_array(values) gives a usable one", output="boolean")

# ---- text


def _tokens(x):
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda t: t != "")


def _left(x, pattern):
    """Characters that a pattern matches."""
    return F.length(x) - F.length(F.regexp_replace(x, pattern, ""))


add("num_chars", TEXT, lambda x, r: F.length(x).cast("double"), "characters")
add("num_words", TEXT, lambda x, r: F.size(_tokens(x)).cast("double"), "words; 0 for null")
add("num_sentences", TEXT, lambda x, r: _left(x, "[.!?]").cast("double"), "sentence marks")
for _n, _c in (("exclamation_count", "!"), ("question_count", "?")):
    add(_n, TEXT, lambda x, r, c=_c: (F.length(F.coalesce(x, F.lit(""))) - F.length(F.replace(F.coalesce(x, F.lit("")), F.lit(c), F.lit("")))).cast("double"), f"number of {_c}; 0 for null")
add("avg_word_length", TEXT, lambda x, r: F.length(F.regexp_replace(x, r"\s", "")) / nz(F.size(_tokens(x)).cast("double")), "characters a word")
add("unique_word_ratio", TEXT, lambda x, r: F.size(F.array_distinct(_tokens(F.lower(x)))) / nz(F.size(_tokens(x)).cast("double")), "distinct words over words")
add("caps_ratio", TEXT, lambda x, r: _left(x, "[A-Z]") / nz(_left(x, "[A-Za-z]").cast("double")), "capitals over letters")
add("digit_ratio", TEXT, lambda x, r: _left(x, "[0-9]") / nz(F.length(x).cast("double")), "digits over characters")
add("punct_ratio", TEXT, lambda x, r: _left(x, r"[!-/:-@\[-`{-~]") / nz(F.length(x).cast("double")), "punctuation over characters")

# ---- parts of dates

_day = lambda x: F.extract(F.lit("dow_iso"), x)
_PARTS = {
    "day": lambda x: F.lower(F.date_format(x, "EEEE")),
    "dow": _day,
    "dom": lambda x: F.lpad(F.dayofmonth(x).cast("string"), 2, "0"),
    "doy": lambda x: F.lpad(F.dayofyear(x).cast("string"), 3, "0"),
    "month": F.month,
    "year": F.year,
    "century": lambda x: F.ceil(F.year(x) / 100),
    "quarter": F.quarter,
    "week": lambda x: F.floor((F.dayofmonth(x) - 1) / 7) + 1,
    "week_of_year": lambda x: F.lpad((F.floor((F.dayofyear(x) - 1) / 7) + 1).cast("string"), 2, "0"),
    "hour": lambda x: F.lpad(F.hour(x.cast("timestamp")).cast("string"), 2, "0"),
    "tz": lambda x: F.date_format(x.cast("timestamp"), "z"),
    "tz_offset": lambda x: F.date_format(x.cast("timestamp"), "xxx"),
}
for _n, _f in _PARTS.items():
    add(_n, DATES, lambda x, r, f=_f: f(x).cast("string"), f"{_n} of a date", output="categorical")


def _hour(x):
    return F.hour(x.cast("timestamp"))


def _hourly(x, r):
    out = F.when(_hour(x) < 5, "night")
    for top, name in ((8, "early_morning"), (11, "morning"), (14, "midday"), (19, "afternoon"), (22, "evening")):
        out = out.when(_hour(x) < top, name)
    return out.when(_hour(x).isNotNull(), "night")


add("hourly_bin", DATES, _hourly, "time of day", output="categorical")
add("daily_bin", DATES, lambda x, r: F.when(_day(x) <= 5, "weekday").when(_day(x).isNotNull(), "weekend"), "weekday or weekend", output="categorical")
for _n, _f, _of in (("hour", _hour, 24), ("month", lambda x: F.month(x) - 1, 12), ("day", lambda x: F.dayofweek(x) - 1, 7)):
    add(f"cyclic_{_n}", DATES, lambda x, r, f=_f, of=_of: (F.sin(f(x) * (2 * math.pi / of)), F.cos(f(x) * (2 * math.pi / of))), f"sine and cosine of the {_n}", suffixes=("_SIN", "_COS"))

# ---- windows over an id's rows

W = {"windowed": True}
for _n, _f in {"cum_sum": F.sum, "cum_mean": F.avg, "cum_max": F.max, "cum_min": F.min}.items():
    add(_n, N, lambda x, r, f=_f: f(x).over(r.order(ties=False)), f"running {_n[4:]}", **W)
add("cum_count", ("categorical", "index"), lambda x, r: F.count(x).over(r.order(ties=False)).cast("double"), "running count", **W)
add("first", ("categorical", "index", "numeric", "date"), lambda x, r: F.first(x).over(r.order()), "first value", output="same", **W)
add("last", ("categorical", "index", "numeric"), lambda x, r: F.last(x).over(r.order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "last value of all rows", output="same", future=True, **W)
add("previous", N, lambda x, r: F.lag(x).over(r.order()), "value before", **W)
add("diff", N, lambda x, r: x - F.lag(x).over(r.order()), "difference to the value before", **W)
add("diff2", N, lambda x, r: x - 2 * F.lag(x).over(r.order()) + F.lag(x, 2).over(r.order()), "second difference", **W)
add("diff3", N, lambda x, r: x - 3 * F.lag(x).over(r.order()) + 3 * F.lag(x, 2).over(r.order()) - F.lag(x, 3).over(r.order()), "third difference", **W)
add("time_since_previous", ("date", "timestamp"), lambda x, r: (micros(x) - F.lag(micros(x)).over(r.order())) / F.lit(86_400_000_000.0), "days since the value before", **W)
add("cumprod", N, lambda x, r: F.when(F.min(x).over(r.order()) > 0, F.exp(F.sum(F.when(x > 0, F.ln(x))).over(r.order()))), "running product while all are positive", **W)
add("cdf", N, lambda x, r: F.cume_dist().over(r.order()), "share of rows up to this one", future=True, **W)
add("percent_rank", N, lambda x, r: F.percent_rank().over(r.order()), "relative rank in time", future=True, **W)
add("ntile", N, lambda x, r: F.ntile(5).over(r.order()).cast("double"), "fifth of the rows in time", future=True, **W)
for _k in (1, 3, 7):
    add(f"lag_{_k}", ("numeric", "categorical", "date", "timestamp", "index"), lambda x, r, k=_k: F.lag(x, k).over(r.order()), f"value {_k} rows before", output="same", **W)
for _k in (3, 7, 14):
    add(f"rolling_mean_{_k}", N, lambda x, r, k=_k: F.avg(x).over(r.last(k)), f"mean of the last {_k} rows", **W)
    add(f"rolling_std_{_k}", N, lambda x, r, k=_k: F.stddev_samp(x).over(r.last(k)), f"standard deviation of the last {_k} rows", **W)
for _k in (5, 7):
    add(f"rolling_median_{_k}", N, lambda x, r, k=_k: F.percentile(x, F.lit(0.5)).over(r.last(k)), f"median of the last {_k} rows", **W)
for _k in (7, 14):
    add(f"rolling_iqr_{_k}", N, lambda x, r, k=_k: F.percentile(x, F.lit(0.75)).over(r.last(k)) - F.percentile(x, F.lit(0.25)).over(r.last(k)), f"quartile distance of the last {_k} rows", **W)


def _ema(rate, n):
    def build(x, r):
        # weights are relative to the current row's time, so that they can't overflow; the denominator counts rows without a value too
        row = F.struct(x.alias("x"), micros(q(r.ts)).alias("t"))
        rows = F.collect_list(row).over(r.last(n))
        weight = lambda e: F.exp(F.lit(rate) * (e["t"] - micros(q(r.ts))) / F.lit(86_400_000_000.0))
        top = F.aggregate(rows, F.lit(0.0), lambda t, e: t + F.coalesce(e["x"] * weight(e), F.lit(0.0)))
        below = F.aggregate(rows, F.lit(0.0), lambda t, e: t + F.coalesce(weight(e), F.lit(0.0)))
        return F.when(F.count(x).over(r.last(n)) > 0, top / nz(below))

    return build


def _slope(n):
    def build(x, r):
        # times and values count from the current row's: squares of whole epochs would lose the digits that matter
        here = F.coalesce(x, F.lit(0.0))
        row = F.struct(x.alias("x"), micros(q(r.ts)).alias("t"))
        rows = F.collect_list(row).over(r.last(n))
        seconds = lambda e: (e["t"] - micros(q(r.ts))) / F.lit(1e6)
        total = lambda f: F.aggregate(rows, F.lit(0.0), lambda s, e: s + F.coalesce(f(seconds(e), e["x"] - here), F.lit(0.0)))
        size = nz(total(lambda t, v: F.when(t.isNotNull() & v.isNotNull(), 1.0)))
        st, sv = total(lambda t, v: F.when(v.isNotNull(), t)), total(lambda t, v: F.when(t.isNotNull(), v))
        return (total(lambda t, v: t * v) - st * sv / size) / nz(total(lambda t, v: F.when(v.isNotNull(), t * t)) - st * st / size)

    return build


add("ema_7", N, _ema(0.25, 7), "mean of the last 7 rows, weighted exponentially by age", **W)
add("ema_14", N, _ema(0.15, 14), "mean of the last 14 rows, weighted exponentially by age", **W)
for _k in (7, 14):
    add(f"holt_winters_level_{_k}", N, lambda x, r, k=_k: F.avg(x).over(r.last(k)), f"level of the last {_k} rows", **W)
    add(f"holt_winters_trend_{_k}", N, _slope(_k), f"slope a second of the last {_k} rows", **W)
    add(f"mean_shift_ratio_{_k}", N, lambda x, r, k=_k: F.avg(x).over(r.last(k)) / nz(F.avg(x).over(r.order().rowsBetween(-(2 * k - 1), -k))), f"mean of the last {_k} rows over that of the {_k} before", **W)
for _k in (1, 3):
    add(f"pct_change_{_k}", N, lambda x, r, k=_k: (x - F.lag(x, k).over(r.order())) / nz(F.lag(x, k).over(r.order())), f"relative change over {_k} rows", **W)
add("cusum", N, lambda x, r: F.sum(x).over(r.order(ties=False)) - F.row_number().over(r.order()) * F.avg(x).over(r.unordered), "running total less that of the mean", future=True, **W)

# ---- the whole population (of an as-of date)

add("cross_entity_zscore", N, lambda x, r: (x - F.avg(x).over(r.population)) / nz(F.stddev_samp(x).over(r.population)), "standard score among all rows", future=True)
add("cross_entity_percentile", N, lambda x, r: F.percent_rank().over(r.population.orderBy(x.asc_nulls_last())), "relative rank among all rows", future=True)

# ---- two columns; not registered, called with two Columns

BINARY = {
    "add": lambda a, b: a + b,
    "subs": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "mod": lambda a, b: F.try_mod(a, b),
    "exponentiation": lambda a, b: F.pow(a, b),
    "bitwise_and": lambda a, b: a.cast("long").bitwiseAND(b.cast("long")),
    "bitwise_or": lambda a, b: a.cast("long").bitwiseOR(b.cast("long")),
    "bitwise_xor": lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")),
    "bitwise_shift_left": lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")),
    "bitwise_shift_right": lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "gt": lambda a, b: a > b,
    "le": lambda a, b: a <= b,
    "ge": lambda a, b: a >= b,
    "time_since": lambda a, b: F.datediff(a, b),
}


def binary(name, a, b):
    """The Column of a two-column operation, by name."""
    if name not in BINARY:
        raise KeyError(f"unknown operation: {name}")
    return BINARY[name](F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
