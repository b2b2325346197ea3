"""xf_<name>: one transformation of a panel of events, of the dates of orders, or of the texts of documents."""

from pyspark.sql import functions as F

from ..boundary import q
from ..functions.transformations import BINARY, Rows, binary, in_array
from .common import loom, r, read, tidy

DATE = ["2024-01-31"]
W = "partition by user_id order by ts"


def frame(n, to=0):
    return f"({W} rows between {n - 1} preceding and {to or 'current row'}{' preceding' if to else ''})"


def before(n):
    return f"({W} rows between {2 * n - 1} preceding and {n} preceding)"


#: name -> SQL over events with the numeric column x.
_EVENTS = {
    "identity": "x",
    "abs": "abs(x)",
    "exp": "exp(x)",
    "cbrt": "cbrt(x)",
    "sign": "sign(x)",
    "ceil": "ceil(x)",
    "floor": "floor(x)",
    "trunc": "trunc(x)",
    "ln": "case when x > 0 then ln(x) end",
    "log": "case when x > 0 then log10(x) end",
    "sqrt": "case when x >= 0 then sqrt(x) end",
    "is_null": "(x is null)::int",
    "cum_sum": f"sum(x) over ({W})",
    "cum_mean": f"avg(x) over ({W})",
    "cum_max": f"max(x) over ({W})",
    "cum_min": f"min(x) over ({W})",
    "first": f"first_value(x) over ({W})",
    "last": f"last_value(x) over ({W} rows between unbounded preceding and unbounded following)",
    "previous": f"lag(x) over ({W})",
    "diff": f"x - lag(x) over ({W})",
    "diff2": f"x - 2 * lag(x) over ({W}) + lag(x, 2) over ({W})",
    "diff3": f"x - 3 * lag(x) over ({W}) + 3 * lag(x, 2) over ({W}) - lag(x, 3) over ({W})",
    "cumprod": f"case when min(x) over ({W}) > 0 then exp(sum(ln(case when x > 0 then x end)) over ({W})) end",
    "cdf": f"cume_dist() over ({W})",
    "percent_rank": f"percent_rank() over ({W})",
    "ntile": f"ntile(5) over ({W})",
    "cusum": f"sum(x) over ({W}) - row_number() over ({W}) * avg(x) over (partition by user_id)",
    "cross_entity_zscore": "(x - avg(x) over ()) / nullif(stddev_samp(x) over (), 0)",
    "cross_entity_percentile": "percent_rank() over (order by x)",
}
_EVENTS |= {f"lag_{k}": f"lag(x, {k}) over ({W})" for k in (1, 3, 7)}
_EVENTS |= {f"pct_change_{k}": f"(x - lag(x, {k}) over ({W})) / nullif(lag(x, {k}) over ({W}), 0)" for k in (1, 3)}
for _k in (3, 7, 14):
    _EVENTS |= {f"rolling_mean_{_k}": f"avg(x) over {frame(_k)}", f"rolling_std_{_k}": f"stddev_samp(x) over {frame(_k)}"}
_EVENTS |= {f"rolling_median_{k}": f"quantile_cont(x, 0.5) over {frame(k)}" for k in (5, 7)}
for _k in (7, 14):
    _EVENTS |= {
        f"rolling_iqr_{_k}": f"quantile_cont(x, 0.75) over {frame(_k)} - quantile_cont(x, 0.25) over {frame(_k)}",
        f"holt_winters_level_{_k}": f"avg(x) over {frame(_k)}",
        f"holt_winters_trend_{_k}": f"1e6 * regr_slope(x, epoch(ts) - 1704067200) over {frame(_k)}",
        f"mean_shift_ratio_{_k}": f"avg(x) over {frame(_k)} / nullif(avg(x) over {before(_k)}, 0)",
    }
for _k, _rate in ((7, 0.25), (14, 0.15)):
    _weight = f"exp({_rate} * (epoch(ts) - 1704067200) / 86400.0)"
    _EVENTS[f"ema_{_k}"] = f"sum(x * {_weight}) over {frame(_k)} / nullif(sum({_weight}) over {frame(_k)}, 0)"
#: An average slope a second is tiny; both sides give it per million seconds.
SCALE = {"holt_winters_trend_7": 1e6, "holt_winters_trend_14": 1e6}
#: On the state instead of the value.
_STATES = {"cum_count": (f"count(event_type) over ({W})", True)}

#: Means of two-digit values over 32 or 64 rows end in a 5 at fewer digits.
DIGITS = {"cum_mean": 10}
SQL = {f"xf_{n}": f"select event_id, {r(e, DIGITS.get(n, 6))} as value from (select *, value as x from events)" for n, e in _EVENTS.items()}
SQL |= {f"xf_{n}": f"select event_id, {r(e)} as value from events" for n, (e, _) in _STATES.items()}


def panel(name):
    column = "event_type" if name in _STATES else "value"

    def run(spark, sf_dir):
        config = {
            "target": "events",
            "max_depth": 1,
            "transformations": ["identity"] + ([name] if name != "identity" else []),
            "entities": [{"alias": "events", "table": "events", "id": "user_id", "temporal_ix": "ts", "variables": {"value": "numeric", "event_type": "categorical", "event_id": "numeric"}}],
        }
        out = "value" if name == "identity" else f"{name.upper()}(events.{column})"
        df = loom(spark, sf_dir, config, DATE).to_spark(["event_id", out])
        value = q(out).cast("double") * SCALE.get(name, 1.0)
        return tidy(df.select(q("event_id").cast("bigint").alias("event_id"), value.alias("value")), DIGITS.get(name, 6))

    return run


QUERIES = {f"xf_{n}": panel(n) for n in [*_EVENTS, *_STATES]}

# ---- texts

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '')"


def _without(pattern, of="text"):
    return f"(length({of}) - length(regexp_replace({of}, '{pattern}', '', 'g')))"


_TEXTS = {
    "num_chars": "length(text)",
    "num_words": f"len({WORDS})",
    "num_sentences": _without("[.!?]"),
    "exclamation_count": f"coalesce({_without('!')}, 0)",
    "question_count": f"coalesce({_without('[?]')}, 0)",
    "avg_word_length": rf"length(regexp_replace(text, '\s', '', 'g')) / nullif(len({WORDS}), 0)",
    "unique_word_ratio": f"len(list_distinct({WORDS.replace('coalesce(text', 'coalesce(lower(text)')})) / nullif(len({WORDS}), 0)",
    "caps_ratio": f"{_without('[A-Z]')} / nullif({_without('[A-Za-z]')}, 0)",
    "digit_ratio": f"{_without('[0-9]')} / nullif(length(text), 0)",
    "punct_ratio": f"{_without('[!-/:-@\\[-`{-~]')} / nullif(length(text), 0)",
}
SQL |= {f"xf_{n}": f"select doc_id, {r(e)} as value from documents" for n, e in _TEXTS.items()}


def text(name):
    def run(spark, sf_dir):
        config = {"target": "documents", "max_depth": 1, "transformations": [name], "entities": [{"alias": "documents", "table": "documents", "id": "doc_id", "variables": {"text": "text"}}]}
        df = loom(spark, sf_dir, config, DATE).to_spark([f"{name.upper()}(documents.text)"])
        return tidy(df.select("doc_id", q(f"{name.upper()}(documents.text)").alias("value")))

    return run


QUERIES |= {f"xf_{n}": text(n) for n in _TEXTS}

# ---- dates

_DATES = {
    "day": "lower(dayname(moment))",
    "dow": "isodow(moment)::varchar",
    "dom": "lpad(day(moment)::varchar, 2, '0')",
    "doy": "lpad(dayofyear(moment)::varchar, 3, '0')",
    "month": "month(moment)::varchar",
    "year": "year(moment)::varchar",
    "century": "ceil(year(moment) / 100)::int::varchar",
    "quarter": "quarter(moment)::varchar",
    "week": "((day(moment) - 1) // 7 + 1)::varchar",
    "week_of_year": "lpad(((dayofyear(moment) - 1) // 7 + 1)::varchar, 2, '0')",
    "hour": "lpad(hour(moment)::varchar, 2, '0')",
    "tz": "'UTC'",
    "tz_offset": "'+00:00'",
    "hourly_bin": "case when hour(moment) < 5 then 'night' when hour(moment) < 8 then 'early_morning' when hour(moment) < 11 then 'morning' when hour(moment) < 14 then 'midday' when hour(moment) < 19 then 'afternoon' when hour(moment) < 22 then 'evening' else 'night' end",
    "daily_bin": "case when isodow(moment) <= 5 then 'weekday' else 'weekend' end",
    "time_since_previous": f"round((epoch(moment) - epoch(lag(moment) over ({W}))) / 86400.0, 6)",
}
_CYCLES = {"cyclic_hour": "hour(moment) * 2 * pi() / 24", "cyclic_month": "(month(moment) - 1) * 2 * pi() / 12", "cyclic_day": "dayofweek(moment) * 2 * pi() / 7"}
SQL |= {f"xf_{n}": f"select event_id, {e} as value from (select *, ts as moment from events)" for n, e in _DATES.items()}
SQL |= {f"xf_{n}": f"select event_id, {r(f'sin({e})')} as value_sin, {r(f'cos({e})')} as value_cos from (select *, ts as moment from events)" for n, e in _CYCLES.items()}


def date(name):
    def run(spark, sf_dir):
        config = {
            "target": "events",
            "max_depth": 1,
            "transformations": ["identity", name],
            "entities": [{"alias": "events", "table": "events", "id": "user_id", "temporal_ix": "ts", "variables": {"moment": "timestamp", "event_id": "numeric"}}],
        }
        tables = {"events": read(spark, sf_dir, "events").withColumn("moment", F.col("ts"))}
        wanted = {f"{name.upper()}{s}(events.moment)": f"value{s.lower()}" for s in (("_SIN", "_COS") if name in _CYCLES else ("",))}
        df = loom(spark, sf_dir, config, DATE, tables).to_spark(["event_id", *wanted])
        return tidy(df.select(q("event_id").cast("bigint").alias("event_id"), *(q(c).alias(n) for c, n in wanted.items())))

    return run


QUERIES |= {f"xf_{n}": date(n) for n in [*_DATES, *_CYCLES]}

# ---- two columns, and lists

_BINARY = {
    "add": "a + b", "subs": "a - b", "mul": "a * b", "div": "a / nullif(b, 0)", "mod": "fmod(a, nullif(b, 0))", "exponentiation": "pow(a, b / 10)",
    "bitwise_and": "a::bigint & b::bigint", "bitwise_or": "a::bigint | b::bigint", "bitwise_xor": "xor(a::bigint, b::bigint)",
    "bitwise_shift_left": "a::bigint << (b::int % 8)", "bitwise_shift_right": "a::bigint >> (b::int % 8)",
    "and": "(a > 20 and b > 5)::int", "or": "(a > 20 or b > 5)::int", "eq": "(a = b)::int", "neq": "(a <> b)::int", "lt": "(a < b)::int", "gt": "(a > b)::int", "le": "(a <= b)::int", "ge": "(a >= b)::int",
}
SQL |= {f"bin_{n}": f"select p_partkey, {r(e)} as value from (select p_partkey, p_size::double as a, (p_partkey % 11)::double as b from part)" for n, e in _BINARY.items()}
SQL["bin_time_since"] = "select l_orderkey, date_diff('day', o_orderdate, max(l_shipdate))::bigint as value from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, o_orderdate"
SQL["xf_in_array"] = "select event_id, (event_type in ('view', 'click'))::bigint as value from events"


def pair(name):
    def run(spark, sf_dir):
        df = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 11).cast("double").alias("b"))
        a, b = F.col("a"), F.col("b")
        if name in ("and", "or"):
            a, b = a > 20, b > 5
        elif "shift" in name:
            b = b % 8
        elif name == "exponentiation":
            b = b / 10
        return tidy(df.select("p_partkey", binary(name, a, b).cast("double").alias("value")))

    return run


def time_since(spark, sf_dir):
    last = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    df = last.join(read(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    return tidy(df.select("l_orderkey", binary("time_since", "last", "o_orderdate").alias("value")))


def listed(spark, sf_dir):
    rows = Rows("user_id", "ts", False)
    return read(spark, sf_dir, "events").select("event_id", in_array(["view", "click"])(F.col("event_type"), rows).cast("bigint").alias("value"))


QUERIES |= {f"bin_{n}": pair(n) for n in BINARY if n != "time_since"} | {"bin_time_since": time_since, "xf_in_array": listed}
