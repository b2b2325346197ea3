"""Aggregations of child rows.

An aggregation is one of two things. A *plain* one is an aggregate Column over the causally cut child rows; all plain aggregations of a
child share one groupBy. Those that look at the order of a key's rows read lag columns that are computed once per child, before the as-of
dates are joined: the cut and the look-back windows keep runs of consecutive rows, so a previous row counts only if it is in the window as
well. A *counted* one is a formula over counts of values or transitions, from a groupBy of its own on finer keys. All of them are hash
partitioned on the child key alone, so one shuffle serves them all.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..boundary import AS_OF, back, baseline, q, within
from .registry import register_aggregation

EARTH_M = 6_371_000.0
DAY_US = 86_400_000_000.0


def nz(x):
    """Null instead of 0, for divisors."""
    return F.nullif(x, F.lit(0).cast("double"))


def ratio(a, b):
    return a.cast("double") / nz(b.cast("double"))


def micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def days_between(a, b):
    """Fractional days from b to a."""
    return (micros(a) - micros(b)) / F.lit(DAY_US)


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # not least(), which would make 1 of a missing point
    return F.lit(2 * EARTH_M) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


class Child:
    """The child rows of one relationship, and the helper columns that aggregations ask for."""

    def __init__(self, key, ts=None, lat=None, lon=None, tiebreak=(), mode="inclusive", columns=()):
        self.key, self.ts, self.lat, self.lon, self.mode = key, ts, lat, lon, mode
        self.tiebreak = [t for t in tiebreak if t]
        self.helpers = {}
        self.asof = AS_OF in columns

    def window(self, *more, partition=()):
        parts = [q(self.key), *([q(AS_OF)] if self.asof else []), *partition]
        return Window.partitionBy(*parts).orderBy(*(q(c).asc_nulls_last() for c in dict.fromkeys([self.ts, *self.tiebreak])), *more)

    def helper(self, name, build):
        """A column computed on the child before the as-of dates are joined."""
        name = f"__{name}"
        if name not in self.helpers:
            self.helpers[name] = build
        return q(name)

    def lag(self, column, n=1):
        return self.helper(f"lag{n}|{column}", lambda: F.lag(q(column), n).over(self.window(q(column).asc_nulls_last())))

    def lag_ts(self, column, n=1):
        """The time of the row n before, in the order that lag() of that column has."""
        return self.helper(f"lagts{n}|{column}", lambda: F.lag(q(self.ts), n).over(self.window(q(column).asc_nulls_last())))


@dataclass
class Scope:
    """What an aggregation sees: its child, the input column's name and type, the interval."""

    child: Child
    column: str
    type: str
    interval: str | None = None
    predicates: dict | None = None

    @property
    def x(self):
        c = q(self.column)
        return c.cast("double") if self.type == "numeric" else c

    @property
    def ts(self):
        return q(self.child.ts)

    @property
    def inside(self):
        """Whether a row is in the window; all rows were cut at the as-of date already."""
        return q(f"__in|{self.interval}") if self.interval and self.child.ts else F.lit(True)

    def at(self, ts):
        """Whether another time is in the window, or known."""
        cut = within(ts, None, mode=self.child.mode)
        if not self.interval:
            return cut
        day, last = F.to_date(ts), F.to_date(q(AS_OF))
        return cut & (day >= q(f"__from|{self.interval}")) & (day <= last if self.child.mode == "inclusive" else day < last)

    @property
    def older(self):
        """Whether a row is in the window of the same length before the window."""
        return q(f"__old|{self.interval}")

    def when(self, x, condition=None):
        cond = self.inside if condition is None else self.inside & condition
        return x if not self.interval and condition is None else F.when(cond, x)

    def previous(self, n=1):
        """(lag of the input, whether that row is in the window too, lag of the time)."""
        t = self.child.lag_ts(self.column, n)
        return self.child.lag(self.column, n), (t.isNotNull() & self.at(t)) if self.interval else t.isNotNull(), t


@dataclass
class Aggregation:
    name: str
    inputs: tuple
    build: object
    needs_ts: bool = False
    output: str = "numeric"
    only_interval: bool = False
    predicate: tuple = ()
    spatial: bool = False
    counted: str | None = None
    doc: str = ""

    def __call__(self, scope):
        return self.build(scope)

    def applies(self, feature, child, interval):
        """Whether the aggregation takes a feature of a child entity."""
        if feature.type == "key" or self.only_interval and not interval:
            return False
        if self.inputs == ("temporal",):
            if feature.type != "index" or feature.name != child.temporal_ix:
                return False
        elif feature.type not in self.inputs:
            return False
        if self.needs_ts and not child.temporal_ix or self.spatial and not (child.lat and child.lon):
            return False
        return all(k in feature.predicate for k in self.predicate)

    def output_type(self, feature):
        return feature.type if self.output == "same" else self.output


def plain(name, inputs, build, doc="", **options):
    return register_aggregation(name, Aggregation(name, inputs, build, doc=doc, **options))


def counted(name, table, build, inputs=("categorical",), doc="", **options):
    return register_aggregation(name, Aggregation(name, inputs, build, counted=table, doc=doc, needs_ts=table != "values", **options))


N, CI, C, B, TS = ("numeric",), ("categorical", "index"), ("categorical",), ("boolean",), ("temporal",)

# ---- moments, extremes, counts

plain("sum", N, lambda s: F.sum(s.when(s.x)), "sum")
plain("min", N, lambda s: F.min(s.when(s.x)), "least value")
plain("max", N, lambda s: F.max(s.when(s.x)), "greatest value")
plain("mean", N, lambda s: F.avg(s.when(s.x)), "mean")
plain("stddev", N, lambda s: F.stddev_samp(s.when(s.x)), "sample standard deviation; null for one row")
plain("variance", N, lambda s: F.var_samp(s.when(s.x)), "sample variance")
plain("count", CI, lambda s: F.count(s.when(s.x)), "rows with a value")
plain("all", B, lambda s: F.bool_and(s.when(s.x)), "whether all hold", output="boolean")
plain("any", B, lambda s: F.bool_or(s.when(s.x)), "whether any holds", output="boolean")
# collect_set instead of count(distinct): many distinct counts in one groupBy would each multiply the rows
plain("nunique", CI, lambda s: F.size(F.collect_set(s.when(s.x))).cast("long"), "distinct values")
plain("skewness", N, lambda s: F.skewness(s.when(s.x)), "population skewness; null without variance")
plain("kurtosis", N, lambda s: F.kurtosis(s.when(s.x)) + 3, "population kurtosis, 3 for the normal distribution")


def _guarded(s, value):
    x = s.when(s.x)
    return F.when(F.min(x) > 0, value(F.when(x > 0, x)))


plain("harmonic_mean", N, lambda s: _guarded(s, lambda x: F.count(x) / F.sum(1 / x)), "harmonic mean of positive values, null if any isn't")
plain("geometric_mean", N, lambda s: _guarded(s, lambda x: F.exp(F.avg(F.ln(x)))), "geometric mean of positive values, null if any isn't")

# ---- order statistics


def _quantile(p):
    return lambda s: F.percentile(s.when(s.x), F.lit(p))


plain("median", N, _quantile(0.5), "median, interpolated")
plain("mode", C, lambda s: F.mode(s.when(s.x), True), "most frequent value, the smallest on ties", output="categorical")
for _p in (10, 25, 75, 90, 95, 99):
    plain(f"p{_p}", N, _quantile(_p / 100), f"{_p}th percentile, interpolated")
plain("iqr", N, lambda s: _quantile(0.75)(s) - _quantile(0.25)(s), "distance of the quartiles")
plain("cv", N, lambda s: ratio(F.stddev_samp(s.when(s.x)), F.avg(s.when(s.x))), "standard deviation over mean")
plain("range", N, lambda s: F.max(s.when(s.x)) - F.min(s.when(s.x)), "greatest less least value")


def _listed(s, f):
    """A function of the array of a key's values (nulls left out), null for the empty one."""
    values = F.collect_list(s.when(s.x))
    return F.when(F.size(values) > 0, f(values))


def _mean(a):
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / nz(F.size(a).cast("double"))


def _median(a):
    a = F.sort_array(a)
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def _mean_deviation(s):
    m = F.avg(s.when(s.x))
    return _listed(s, lambda a: F.aggregate(a, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("m")), lambda t, v: F.struct((t["t"] + F.abs(v - m)).alias("t"), t["m"].alias("m")), lambda t: t["t"]) / F.size(a))


plain("mean_deviation", N, _mean_deviation, "mean distance from the mean")
plain("median_absolute_deviation", N, lambda s: _listed(s, lambda a: _median(F.transform(a, lambda v: F.abs(v - F.percentile(s.when(s.x), F.lit(0.5)))))), "median distance from the median")


def _trimmed(s):
    lo, hi = (F.percentile(s.when(s.x), F.lit(p)) for p in (0.1, 0.9))
    return _listed(s, lambda a: _mean(F.filter(a, lambda v: (v >= lo) & (v <= hi))))


plain("trimmed_mean_10", N, _trimmed, "mean of the values between the 10th and 90th percentiles")


def _gini(s):
    # a null value takes the last ranks and counts as a row, but adds nothing
    n = F.sum(s.when(F.lit(1), None) if not s.interval else F.when(s.inside, 1)).cast("double")
    a = F.sort_array(F.collect_list(s.when(s.x)))
    weighted = F.aggregate(F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    return 2 * weighted / nz(n * F.sum(s.when(s.x))) - (n + 1) / nz(n)


plain("gini", N, _gini, "Gini coefficient")


def _theil(s):
    x = F.when(s.inside & (s.x > 0), s.x)
    return ratio(F.sum(x * F.ln(x)), F.sum(x)) - F.ln(F.avg(x))


plain("theil", N, _theil, "Theil index of the positive values")

# ---- time

T = {"needs_ts": True}
plain("event_rate", TS, lambda s: ratio(F.count(s.when(s.ts)), days_between(F.max(s.when(s.ts)), F.min(s.when(s.ts)))), "events a day between the first and the last", **T)
plain("time_span", TS, lambda s: days_between(F.max(s.when(s.ts)), F.min(s.when(s.ts))), "days from the first to the last event", **T)
plain("recency", TS, lambda s: F.datediff(q(AS_OF), F.max(s.when(s.ts))), "days since the last event", **T)
for _n in ("tenure", "age_in_system"):
    plain(_n, TS, lambda s: F.datediff(q(AS_OF), F.min(s.when(s.ts))), "days since the first event", **T)
plain("inter_event_hazard_proxy", TS, lambda s: ratio(F.count(s.when(s.ts)), F.datediff(q(AS_OF), F.min(s.when(s.ts)))), "events a day since the first event", **T)


def _gap(s):
    t = s.child.lag_ts(s.column)
    return F.when(s.inside & s.at(t) if s.interval else F.lit(True), days_between(s.ts, t))


plain("gap_mean", TS, lambda s: F.avg(_gap(s)), "mean days between consecutive events", **T)
plain("gap_stddev", TS, lambda s: F.stddev_samp(_gap(s)), "standard deviation of the gaps", **T)
plain("gap_min", TS, lambda s: F.min(_gap(s)), "least gap", **T)
plain("gap_max", TS, lambda s: F.max(_gap(s)), "greatest gap", **T)
plain("gap_cv", TS, lambda s: ratio(F.stddev_samp(_gap(s)), F.avg(_gap(s))), "standard deviation of the gaps over their mean", **T)
plain("burstiness", TS, lambda s: ratio(F.stddev_samp(_gap(s)) - F.avg(_gap(s)), F.stddev_samp(_gap(s)) + F.avg(_gap(s))), "(sd - mean) / (sd + mean) of the gaps", **T)

# ---- order of states


def _moves(s, equal):
    prev, there, _ = s.previous()
    same = s.x.eqNullSafe(prev)
    return F.count_if(s.inside & there & prev.isNotNull() & (same if equal else ~same))


def _as_null(s, count):
    """0 for a key with rows in the window, as for all its counts; null without."""
    return F.when(F.count_if(s.inside) > 0, count)


plain("state_volatility", C, lambda s: _as_null(s, _moves(s, False)), "changes of state", **T)
plain("rework_count", C, lambda s: _as_null(s, _moves(s, True)), "repetitions of the state before", **T)


def _time_in_state(s):
    prev, there, _ = s.previous()
    changed = ~F.coalesce(there, F.lit(False)) | ~s.x.eqNullSafe(prev)
    return F.datediff(q(AS_OF), F.max(F.when(s.inside & changed, s.ts)))


plain("time_in_current_state", C, _time_in_state, "days since the state last changed", **T)


def _recurrence(s):
    c = s.child
    t = c.helper(f"same|{s.column}", lambda: F.lag(q(c.ts)).over(c.window(partition=[q(s.column)])))
    ok = s.inside & s.at(t) if s.interval else F.lit(True)
    return F.avg(F.when(ok, F.datediff(s.ts, t)))


plain("recurrence_interval", C, _recurrence, "mean days between events of the same state", **T)


def _series(s, f):
    prev, there, _ = s.previous()
    return f(F.when(s.inside & there & s.x.isNotNull() & prev.isNotNull(), s.x), prev.cast("double"))


def _acf(s):
    def f(x, y):
        y = F.when(x.isNotNull(), y)
        return F.covar_pop(x, y) / nz(F.stddev_pop(x) * F.stddev_pop(y))

    return _series(s, f)


plain("acf_1", N, _acf, "correlation with the value before", **T)
plain("variance_ratio", N, lambda s: ratio(F.var_samp(s.when(s.x)), _series(s, lambda x, y: F.var_samp(x - y))), "variance over that of the differences", **T)


def _cosinor(s):
    w = F.lit(2 * math.pi / 604_800) * (micros(s.ts) / F.lit(1e6))
    x = s.when(s.x)
    # events that all fall on one phase of the week have no slope, whatever the rounding of sin and cos
    slope = lambda y: F.when(F.var_pop(F.when(x.isNotNull(), y)) > 1e-9, F.regr_slope(x, y))
    return F.sqrt(F.pow(slope(F.sin(w)), 2) + F.pow(slope(F.cos(w)), 2))


plain("cosinor_amplitude_weekly", N, _cosinor, "amplitude of a weekly cycle", **T)


def _wasserstein(s):
    old = s.older
    parts = [F.abs(F.percentile(s.when(s.x), F.lit(p)) - F.percentile(F.when(old, s.x), F.lit(p))) for p in (0.1, 0.5, 0.9)]
    return parts[0] + parts[1] + parts[2]


plain("wasserstein_drift", N, _wasserstein, "distance of three quantiles from the window before", only_interval=True, **T)

# ---- predicates


def _is(s, key):
    return s.x == F.lit(s.predicates[key])


plain("right_censoring_indicator", C, lambda s: _as_null(s, (F.count_if(s.inside & _is(s, "terminal")) == 0).cast("int")), "1 if the terminal state was never seen", predicate=("terminal",))
plain("first_passage_time", C, lambda s: F.datediff(F.min(s.when(s.ts, _is(s, "target"))), F.min(s.when(s.ts))), "days from the first event to the first target", predicate=("target",), **T)


def _latency(s):
    c, a, b = s.child, s.predicates["a"], s.predicates["b"]
    parts = [q(c.key), *([q(AS_OF)] if c.asof else [])]

    def next_b():
        w = Window.partitionBy(*parts).orderBy(micros(q(c.ts))).rangeBetween(1, Window.unboundedFollowing)
        return F.min(F.when(q(s.column) == F.lit(b), q(c.ts))).over(w)

    def first():
        w = Window.partitionBy(*parts, q(c.ts), q(s.column)).orderBy(*(q(t).asc_nulls_last() for t in c.tiebreak), q(c.ts))
        return F.row_number().over(w) == 1

    t = c.helper(f"next|{s.column}|{b}", next_b)
    once = c.helper(f"once|{s.column}", first)
    return F.avg(F.when(s.inside & s.at(t) & once & (s.x == F.lit(a)), days_between(t, s.ts)))


plain("cross_type_latency", C, _latency, "mean days from an a to the next b", predicate=("a", "b"), **T)

# ---- space


def _travel(s):
    c = s.child
    lat, lon = (F.lag(q(z)).over(c.window()) for z in (c.lat, c.lon))
    d = c.helper("step", lambda: haversine(lat, lon, q(c.lat), q(c.lon)))
    t = c.helper("step_ts", lambda: F.lag(q(c.ts)).over(c.window()))
    return F.sum(F.when(s.inside & s.at(t) if s.interval else F.lit(True), d))


def _located(s):
    there = s.inside & q(s.child.lat).isNotNull() & q(s.child.lon).isNotNull()
    return [F.when(there, q(z).cast("double")) for z in (s.child.lat, s.child.lon)]


def _gyration(s):
    lat, lon = _located(s)
    points = F.collect_list(F.when(lat.isNotNull(), F.struct(lat.alias("a"), lon.alias("b"))))
    squares = F.transform(points, lambda p: F.pow(haversine(p["a"], p["b"], F.avg(lat), F.avg(lon)), 2))
    return F.when(F.size(points) > 0, F.sqrt(_mean(squares)))


def _bbox(s):
    lat, lon = _located(s)
    return (F.max(lat) - F.min(lat)) * (F.max(lon) - F.min(lon)) * F.cos(F.radians(F.avg(lat))) * F.lit(111_320.0**2)


S = {"needs_ts": True, "spatial": True}
plain("distance_travelled", TS, _travel, "metres between consecutive points, added up", **S)
plain("radius_of_gyration", TS, _gyration, "root mean square distance from the centroid, in metres", **S)
plain("spatial_std", TS, lambda s: F.sqrt(F.var_samp(_located(s)[0]) + F.var_samp(_located(s)[1])), "standard distance in degrees", **S)
plain("bbox_area", TS, _bbox, "square metres of the bounding box", **S)

# ---- formulas over counts: build(n) gets the counts' column (of an interval) and returns an aggregate


def _sums(c):
    some = F.when(c > 0, c)
    return F.sum(some), F.sum(some * F.ln(some))


def _entropy(c, _=None):
    n, nlogn = _sums(c)
    return F.ln(n) - nlogn / nz(n.cast("double"))


counted("entropy", "values", _entropy, doc="entropy of the values; null is one of them")
counted("hhi", "values", lambda c, _=None: F.sum(c * c) / nz(F.pow(F.sum(c), 2)), doc="concentration: sum of squared shares")


def _kl(c, b):
    p, r = F.sum(c), F.sum(b)
    shared = (c > 0) & (b > 0)
    own = F.when(shared, c)
    # sum of (c/p) ln((c/p) / (b/r)) over the shared values
    return F.coalesce((F.sum(own * F.ln(own / F.when(shared, b))) + F.sum(own) * F.ln(r / nz(p.cast("double")))) / nz(p.cast("double")), F.lit(0.0))


counted("kl_drift", "values", _kl, doc="divergence of the values from the window before", only_interval=True)
counted("ngram_2_freq", "pairs", lambda r: F.max(r["most"]), doc="most frequent pair of consecutive states")
counted("ngram_3_freq", "triples", lambda c, _=None: F.max(F.when(c > 0, c)), doc="most frequent triple of consecutive states")
counted("sequence_entropy", "pairs", lambda r: F.ln(F.sum(r["n"])) - F.sum(r["nlogn"]) / nz(F.sum(r["n"]).cast("double")), doc="entropy of the transitions")
counted("transition_matrix_summary", "pairs", lambda r: F.sum(r["kinds"]), doc="distinct transitions")
counted("markov_conditional_entropy", "pairs", lambda r: (F.sum(r["n"] * F.ln(r["n"])) - F.sum(r["nlogn"])) / nz(F.sum(r["n"]).cast("double")), doc="entropy of the next state given the state")
counted("max_transition_prob", "pairs", lambda r: F.max(r["most"] / nz(r["n"].cast("double"))), doc="greatest probability of a transition")
counted("longest_streak", "streaks", lambda c, _=None: F.max(F.when(c > 0, c)), doc="longest run of one state")

ZERO_IF_NONE = ("transition_matrix_summary",)


def aggregate(rows, child, wanted):
    """The aggregates of the causally cut rows: one row for each (as_of_date, key), or each key where nothing has a time.

    rows: the child's rows joined with the as-of dates and cut, with the helper columns. wanted: (name, Aggregation, Scope) triples.
    """
    keys = [*([q(AS_OF)] if AS_OF in rows.columns else []), q(child.key)]
    flat = [a(s).alias(n) for n, a, s in wanted if not a.counted]
    tables = {}
    for n, a, s in wanted:
        if a.counted:
            # what counts as the state before the last depends on the window, so each has a groupBy of its own
            tables.setdefault((a.counted, s.column, s.interval if a.counted == "triples" else None), []).append((n, a, s))
    base = rows.groupBy(*keys).agg(*flat) if flat or not tables else None
    for (kind, column, _), own in tables.items():
        part = _counted(rows, child, keys, kind, column, own)
        base = part if base is None else base.join(part, [c for c in (AS_OF, child.key) if c in rows.columns], "full_outer" if not flat else "left")
    zero = [n for n, a, _ in wanted if a.name in ZERO_IF_NONE]
    return base.select(*(F.coalesce(q(c), F.lit(0)).alias(c) if c in zero else q(c) for c in base.columns))


def _counted(rows, child, keys, kind, column, own):
    scope = own[0][2]
    prev, there, _ = scope.previous() if kind != "values" else (None, None, None)
    spans = list(dict.fromkeys(s.interval for _, _, s in own))

    def inside(i):
        s = Scope(child, column, scope.type, i)
        cond = s.inside
        if kind in ("pairs", "triples"):
            prev, there, _ = s.previous()
            cond = cond & there & prev.isNotNull()
        return F.coalesce(cond, F.lit(False))

    counts = [F.count_if(inside(i)).alias(f"n{k}") for k, i in enumerate(spans)]
    if kind == "values":
        counts += [F.count_if(q(f"__old|{i}")).alias(f"b{k}") for k, i in enumerate(spans) if any(a.only_interval and s.interval == i for _, a, s in own)]
    fine = {"values": lambda: [q(column)], "pairs": lambda: [prev, q(column)], "triples": lambda: [F.when(scope.previous(2)[1], child.lag(column, 2)), prev, q(column)], "streaks": lambda: [q(column), _island(child, column)]}[kind]()
    fine = [c.alias(f"__k{i}") for i, c in enumerate(fine)]
    g = rows.groupBy(*keys, *fine).agg(*counts)
    at = {i: k for k, i in enumerate(spans)}
    if kind != "pairs":
        return g.groupBy(*keys).agg(*(a.build(q(f"n{at[s.interval]}"), q(f"b{at[s.interval]}") if a.only_interval else None).alias(n) for n, a, s in own))
    per = []
    for k in range(len(spans)):
        c = F.when(q(f"n{k}") > 0, q(f"n{k}"))
        per += [F.sum(c).alias(f"s{k}"), F.sum(c * F.ln(c)).alias(f"l{k}"), F.max(c).alias(f"m{k}"), F.count(c).alias(f"d{k}")]
    r = g.groupBy(*keys, q("__k0")).agg(*per)
    return r.groupBy(*keys).agg(*(a.build({"n": q(f"s{k}"), "nlogn": q(f"l{k}"), "most": q(f"m{k}"), "kinds": q(f"d{k}")}).alias(n) for n, a, s in own for k in [at[s.interval]]))


def _island(child, column):
    """The same number for all rows of one run of a state: rank less rank within the state."""
    def build():
        order = child.window(q(column).asc_nulls_last())
        return F.row_number().over(order) - F.row_number().over(child.window(q(column).asc_nulls_last(), partition=[q(column)]))

    return child.helper(f"island|{column}", build)


def flagged(rows, child, wanted):
    """Dated rows with, for each interval, the window's first day and whether a row is in it or in the window before: computed once a row."""
    spans = list(dict.fromkeys(s.interval for _, _, s in wanted if s.interval))
    if not spans or not child.ts:
        return rows
    rows = rows.select("*", *(F.to_date(back(q(AS_OF), i)).alias(f"__from|{i}") for i in spans))
    day = F.to_date(q(child.ts))
    last = F.to_date(q(AS_OF))
    inside = {i: (day >= q(f"__from|{i}")) & (day <= last if child.mode == "inclusive" else day < last) for i in spans}
    drifting = list(dict.fromkeys(s.interval for _, a, s in wanted if a.only_interval))
    return rows.select("*", *(c.alias(f"__in|{i}") for i, c in inside.items()), *(baseline(q(child.ts), i).alias(f"__old|{i}") for i in drifting))


def prepare(wanted, child):
    """Asks all aggregations for their helper columns; returns [Column]."""
    for _, a, s in wanted:
        if not a.counted:
            a(s)
        elif a.counted != "values":
            s.previous()
            if a.counted == "triples":
                s.previous(2)
            if a.counted == "streaks":
                _island(child, s.column)
    return [build().alias(name) for name, build in child.helpers.items()]
