"""agg_<name>: one aggregation of orders by customer, over all history and over a year, at three as-of dates."""

from pyspark.sql import functions as F

from ..boundary import q
from .common import dates_sql, loom, r, read, tidy

INTERVAL, SQL_INTERVAL, SQL_TWICE = "P1Y", "interval 1 year", "interval 2 year"
LAT, LON = "40 + (o_orderkey * 37 % 1000) / 1000.0", "-87 + (o_orderkey * 91 % 1000) / 1000.0"
PREDICATES = {"terminal": "F", "target": "F", "a": "O", "b": "F"}
TIMED = "event_rate time_span recency tenure age_in_system inter_event_hazard_proxy gap_mean gap_stddev gap_min gap_max gap_cv burstiness distance_travelled radius_of_gyration spatial_std bbox_area".split()

#: name -> (column, a groupBy of the rows r as SQL, the value of an empty window). {r} has as_of_date, k, ts, id, x, c, b, lat, lon.
_SQL = {}


def plain(column, empty="null", **expressions):
    for name, e in expressions.items():
        _SQL[name] = (column, f"select as_of_date, k, {e} as v from {{r}} group by 1, 2", empty)


def over(column, rows, empty="null", **expressions):
    """Expressions over rows with window columns."""
    for name, e in expressions.items():
        _SQL[name] = (column, f"select as_of_date, k, {e} as v from ({rows}) group by 1, 2", empty)


P, W = "partition by as_of_date, k", "partition by as_of_date, k order by ts, id"
DAYS = "(epoch({}) - epoch({})) / 86400.0"

plain("x", sum="sum(x)", min="min(x)", max="max(x)", mean="avg(x)", stddev="stddev_samp(x)", variance="var_samp(x)")
plain("c", "0", count="count(c)", nunique="count(distinct c)")
plain("b", all="bool_and(b)::int", any="bool_or(b)::int")
MOMENTS = f"select *, x - avg(x) over ({P}) as d from {{r}}"
over("x", MOMENTS, skewness="avg(d * d * d) / nullif(pow(avg(d * d), 1.5), 0)", kurtosis="avg(d * d * d * d) / nullif(pow(avg(d * d), 2), 0)", mean_deviation="avg(abs(d))")
plain("x", harmonic_mean="case when min(x) > 0 then count(x) / sum(1 / x) end", geometric_mean="case when min(x) > 0 then exp(avg(ln(x))) end")
plain("x", median="quantile_cont(x, 0.5)", p10="quantile_cont(x, 0.1)", p25="quantile_cont(x, 0.25)", p75="quantile_cont(x, 0.75)", p90="quantile_cont(x, 0.9)", p95="quantile_cont(x, 0.95)", p99="quantile_cont(x, 0.99)", iqr="quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", cv="stddev_samp(x) / nullif(avg(x), 0)", range="max(x) - min(x)")
COUNTS = "select as_of_date, k, c, n, sum(n) over (partition by as_of_date, k) as total from (select as_of_date, k, c, count(*) as n from {r} group by 1, 2, 3)"
over("c", COUNTS, mode="first(c order by n desc, c)", entropy="-sum(n / total * ln(n / total))", hhi="sum(pow(n / total, 2))")
SPAN = DAYS.format("max(ts)", "min(ts)")
SINCE = "date_diff('day', min(ts)::date, as_of_date)"
plain("t", event_rate=f"count(*) / nullif({SPAN}, 0)", time_span=SPAN, recency="date_diff('day', max(ts)::date, as_of_date)", tenure=SINCE, age_in_system=SINCE, inter_event_hazard_proxy=f"count(*) / nullif({SINCE}, 0)")
GAPS = f"select *, {DAYS.format('ts', f'lag(ts) over ({W})')} as gap from {{r}}"
over("t", GAPS, gap_mean="avg(gap)", gap_stddev="stddev_samp(gap)", gap_min="min(gap)", gap_max="max(gap)", gap_cv="stddev_samp(gap) / nullif(avg(gap), 0)", burstiness="(stddev_samp(gap) - avg(gap)) / nullif(stddev_samp(gap) + avg(gap), 0)")
over("x", f"select *, row_number() over ({P} order by x) as i from {{r}}", gini="2 * sum(i * x) / nullif(count(*) * sum(x), 0) - (count(*) + 1) / count(*)")
PREVIOUS = f"select *, lag(c) over ({W}) as prev, lag(c, 2) over ({W}) as prev2, lag(x) over ({W}) as y, row_number() over ({W}) as i from {{r}}"
PAIRS = f"select as_of_date, k, prev, c, n, sum(n) over (partition by as_of_date, k, prev) as out, sum(n) over (partition by as_of_date, k) as total from (select as_of_date, k, prev, c, count(*) as n from ({PREVIOUS}) where prev is not null group by 1, 2, 3, 4)"
over("c", PAIRS, ngram_2_freq="max(n)", sequence_entropy="-sum(n / total * ln(n / total))", markov_conditional_entropy="-sum(n / total * ln(n / out))", max_transition_prob="max(n / out)")
over("c", PAIRS, "0", transition_matrix_summary="count(*)")
over("c", f"select as_of_date, k, prev2, prev, c, count(*) as n from ({PREVIOUS}) where prev is not null group by 1, 2, 3, 4, 5", ngram_3_freq="max(n)")
over("c", f"select as_of_date, k, c, i, count(*) as n from (select *, row_number() over ({W}) - row_number() over (partition by as_of_date, k, c order by ts, id) as i from {{r}}) group by 1, 2, 3, 4", longest_streak="max(n)")
over("x", f"select as_of_date, k, x / avg(x) over ({P}) as q from {{r}} where x > 0", theil="avg(q * ln(q))")
over("x", f"select as_of_date, k, x from (select *, quantile_cont(x, 0.1) over ({P}) as lo, quantile_cont(x, 0.9) over ({P}) as hi from {{r}}) where x >= lo and x <= hi", trimmed_mean_10="avg(x)")
over("x", f"select *, abs(x - quantile_cont(x, 0.5) over ({P})) as d from {{r}}", median_absolute_deviation="quantile_cont(d, 0.5)")
over("c", PREVIOUS, state_volatility="sum((prev is not null and prev <> c)::int)", rework_count="sum((prev is not null and prev = c)::int)", time_in_current_state="date_diff('day', max(case when i = 1 or prev is distinct from c then ts end)::date, as_of_date)")
over("c", "select *, date_diff('day', lag(ts) over (partition by as_of_date, k, c order by ts, id), ts) as d from {r}", recurrence_interval="avg(d)")
over("x", PREVIOUS, acf_1="case when stddev_pop(x) filter (y is not null) * stddev_pop(y) > 0 then covar_pop(x, y) / (stddev_pop(x) filter (y is not null) * stddev_pop(y)) end", variance_ratio="var_samp(x) / nullif(var_samp(x - y), 0)")
over("x", "select *, 2 * pi() / 604800 * epoch(ts) as w from {r}", cosinor_amplitude_weekly="sqrt(pow(case when var_pop(sin(w)) > 1e-9 then regr_slope(x, sin(w)) end, 2) + pow(case when var_pop(cos(w)) > 1e-9 then regr_slope(x, cos(w)) end, 2))")
plain("c", right_censoring_indicator="(count(*) filter (c = 'F') = 0)::int", first_passage_time="date_diff('day', min(ts), min(ts) filter (c = 'F'))")
over("c", "select as_of_date, k, (epoch(min(n.ts)) - epoch(ts)) / 86400.0 as d from (select distinct as_of_date, k, ts from {r} where c = 'O') as o left join (select as_of_date, k, ts from {r} where c = 'F') as n using (as_of_date, k) where n.ts > o.ts group by as_of_date, k, o.ts".replace("as_of_date, k, (epoch(min(n.ts)) - epoch(ts))", "as_of_date, k, (epoch(min(n.ts)) - epoch(o.ts))"), cross_type_latency="avg(d)")


def haversine_sql(a, b, c, d):
    return f"2 * 6371000.0 * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


over("t", f"select *, lag(lat) over ({W}) as plat, lag(lon) over ({W}) as plon from {{r}}", distance_travelled=f"sum({haversine_sql('plat', 'plon', 'lat', 'lon')})")
over("t", f"select *, avg(lat) over ({P}) as mlat, avg(lon) over ({P}) as mlon from {{r}}", radius_of_gyration=f"sqrt(avg(pow({haversine_sql('lat', 'lon', 'mlat', 'mlon')}, 2)))")
plain("t", spatial_std="sqrt(var_samp(lat) + var_samp(lon))", bbox_area="(max(lat) - min(lat)) * (max(lon) - min(lon)) * cos(radians(avg(lat))) * 111320.0 * 111320.0")

_SOURCE = f"""{dates_sql()},
o as (select o_custkey as k, o_orderkey as id, o_orderdate as ts, o_totalprice as x, o_orderstatus as c, o_totalprice > 150000 as b, {LAT} as lat, {LON} as lon from orders),
r as (select * from a join o on ts <= as_of_date),
w as (select * from r where ts::date >= (as_of_date - {SQL_INTERVAL})::date and ts::date <= as_of_date),
old as (select * from r where ts::date >= (as_of_date - {SQL_TWICE})::date and ts::date < (as_of_date - {SQL_INTERVAL})::date)"""

#: Square metres and the like are large: fewer digits, as the last ones depend on the order of additions.
DIGITS = {"variance": 2, "bbox_area": 0, "sum": 3, "distance_travelled": 3, "radius_of_gyration": 3, "cosinor_amplitude_weekly": 4, "stddev": 4}


def _text(column, name):
    """A value that isn't a rounded number."""
    return name == "mode"


def sql(name):
    column, body, empty = _SQL[name]
    value = (lambda e: e) if _text(column, name) else (lambda e: r(e, DIGITS.get(name, 6)))
    return f"""with {_SOURCE},
g as ({body.format(r='r')}), h as ({body.format(r='w')}), seen as (select distinct as_of_date, k from r)
select a.as_of_date, c_custkey, {value('case when seen.k is not null then coalesce(g.v, ' + empty + ') end')} as value,
  {value('case when seen.k is not null then coalesce(h.v, ' + empty + ') end')} as value_1y
from a cross join customer left join seen on seen.as_of_date = a.as_of_date and seen.k = c_custkey
left join g on g.as_of_date = a.as_of_date and g.k = c_custkey left join h on h.as_of_date = a.as_of_date and h.k = c_custkey"""


def _drift(body):
    return f"""with {_SOURCE}, h as ({body}), seen as (select distinct as_of_date, k from r)
select a.as_of_date, c_custkey, {r('h.v')} as value_1y
from a cross join customer left join h on h.as_of_date = a.as_of_date and h.k = c_custkey"""


SQL = {f"agg_{n}": sql(n) for n in _SQL}
SQL["agg_kl_drift"] = _drift("""
select as_of_date, seen.k, coalesce((select sum(p.n / p.total * ln((p.n / p.total) / (b.n / b.total)))
  from (select as_of_date, k, c, count(*) as n, sum(count(*)) over (partition by as_of_date, k) as total from w group by 1, 2, 3) p
  join (select as_of_date, k, c, count(*) as n, sum(count(*)) over (partition by as_of_date, k) as total from old group by 1, 2, 3) b
    on p.as_of_date = b.as_of_date and p.k = b.k and p.c = b.c
  where p.as_of_date = seen.as_of_date and p.k = seen.k), 0) as v
from (select distinct as_of_date, k from r) seen""")
SQL["agg_wasserstein_drift"] = _drift("""
select as_of_date, k, abs(a1 - b1) + abs(a5 - b5) + abs(a9 - b9) as v
from (select as_of_date, k, quantile_cont(x, 0.1) as a1, quantile_cont(x, 0.5) as a5, quantile_cont(x, 0.9) as a9 from w group by 1, 2)
join (select as_of_date, k, quantile_cont(x, 0.1) as b1, quantile_cont(x, 0.5) as b5, quantile_cont(x, 0.9) as b9 from old group by 1, 2) using (as_of_date, k)""")

COLUMN = {n: c for n, (c, _, _) in _SQL.items()} | {"kl_drift": "c", "wasserstein_drift": "x"}
FEATURE = {"x": "o_totalprice", "c": "o_orderstatus", "b": "large", "t": "o_orderdate"}


def orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").withColumns({"large": F.col("o_totalprice") > 150000, "lat": F.expr(LAT.replace("1000.0", "1000d")), "lon": F.expr(LON.replace("1000.0", "1000d"))})


def config(names, intervals=(INTERVAL,)):
    return {
        "target": "customer",
        "max_depth": 2,
        "intervals": list(intervals),
        "aggregations": list(names),
        "transformations": ["identity"],
        "entities": [
            {"alias": "customer", "table": "customer", "id": "c_custkey"},
            {
                "alias": "orders",
                "table": "orders",
                "id": "o_orderkey",
                "temporal_ix": "o_orderdate",
                "spatial_ix": {"lat": "lat", "lon": "lon"},
                "variables": {"o_totalprice": "numeric", "o_orderstatus": {"type": "categorical", "predicates": PREDICATES}, "large": "boolean"},
            },
        ],
        "relationships": [{"parent": {"entity": "customer", "key": "c_custkey"}, "child": {"entity": "orders", "key": "o_custkey"}}],
    }


def query(name):
    def run(spark, sf_dir):
        f = loom(spark, sf_dir, config([name]), tables={"orders": orders(spark, sf_dir)})
        column = f"{name.upper()}(orders.{FEATURE[COLUMN[name]]}"
        wanted = {f"{column})": "value", f"{column}|interval={INTERVAL})": "value_1y"}
        wanted = {c: n for c, n in wanted.items() if c in f.features}
        df = f.to_spark([c.replace("[", "[[]") for c in wanted])
        df = df.select("as_of_date", "c_custkey", *(q(c).alias(n) if _text(None, name) else q(c).cast("double").alias(n) for c, n in wanted.items()))
        return tidy(df, DIGITS.get(name, 6))

    return run


QUERIES = {f"agg_{n}": query(n) for n in COLUMN}
