"""Bridges over events, embeddings, documents and the customers' graph. The iterative ones have no SQL and are tested on fixtures."""

from pyspark.sql import functions as F

from .. import bridges as b
from .common import r, read, tidy

QUERIES, SQL = {}, {}


def add(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


_MOVES = "select event_id, user_id, event_type as s, lag(event_type) over w as p, row_number() over w = 1 as first from events window w as (partition by user_id order by ts, event_id)"


@add(
    "bridge_markov_surprisal",
    f"""with m as ({_MOVES}), n as (select s, count(*) as n from m group by 1), c as (select p, s, count(*) as c from m where not first group by 1, 2),
o as (select p, sum(c) as o from c group by 1), t as (select count(*) as v, sum(n) as t from n)
select event_id, {r('-ln(case when first then (n + 1) / (t + v) else (coalesce(c, 0) + 1) / (coalesce(o, 0) + v) end)')} as surprisal
from m cross join t left join n on n.s = m.s left join c on c.p = m.p and c.s = m.s left join o on o.p = m.p""",
)
def markov(spark, sf_dir):
    return tidy(b.MarkovSurprisal("event_id", "user_id", "ts", "event_type").run(read(spark, sf_dir, "events")))


@add(
    "bridge_change_point",
    f"""with x as (select user_id, row_number() over w as i, sum(value) over w as l, sum(value) over u as t, count(*) over u as n, stddev_pop(value) over u as sd from events where value is not null window w as (partition by user_id order by ts), u as (partition by user_id)),
s as (select *, case when i >= 2 and i <= n - 2 then abs(l / i - (t - l) / nullif(n - i, 0)) / nullif(sd, 0) end as g from x)
select user_id, {r('case when n >= 4 then case when sd = 0 then 0 else coalesce(max(g), 0) end end')} as change_score, {r('case when n >= 4 and max(g) > 0 then arg_max(i, (g, -i)) filter (g > 0) / n end')} as change_position from s group by user_id, n, sd""",
)
def change_point(spark, sf_dir):
    return tidy(b.ChangePoint("user_id", "ts", "value").run(read(spark, sf_dir, "events")))


_BINS = "select user_id, floor(epoch(ts) / 86400.0 - min(epoch(ts) / 86400.0) over (partition by user_id))::int as b from events"
_WAVE = "sum((coalesce(c, 0) - mean) * {}(2 * pi() * k * b / n))"


@add(
    "bridge_periodicity",
    f"""with e as ({_BINS}), size as (select user_id, max(b) + 1 as n, count(*) / (max(b) + 1) as mean from e group by 1), c as (select user_id, b, count(*) as c from e group by 1, 2),
g as (select user_id, n, mean, unnest(range(n)) as b from size), f as (select g.*, c from g left join c using (user_id, b)), k as (select user_id, unnest(range(1, n // 2 + 1)) as k from size where n >= 8),
p as (select user_id, k, n, pow({_WAVE.format('cos')}, 2) + pow({_WAVE.format('sin')}, 2) as power from f join k using (user_id) group by user_id, k, n)
select size.user_id, {r('max(power) / nullif(sum(power), 0)', 4)} as period_strength, {r('size.n / arg_max(k, power)', 4)} as period_bins from size left join p using (user_id) group by size.user_id, size.n""",
)
def periodicity(spark, sf_dir):
    return tidy(b.Periodicity("user_id", "ts").run(read(spark, sf_dir, "events")), 4)


_COS = "list_inner_product({0}, {1}) / nullif(sqrt(list_inner_product({0}, {0}) * list_inner_product({1}, {1})), 0)"


@add(
    "bridge_embedding_trajectory",
    f"""with v as (select vec_id, label, embedding::double[] as e, row_number() over (partition by label order by vec_id) as i from embeddings where embedding is not null),
n as (select x.vec_id, 1 - max({_COS.format('x.e', 'y.e')}) as novelty, max(case when y.i = x.i - 1 then 1 - {_COS.format('x.e', 'y.e')} end) as volatility from v x join v y on y.label = x.label and y.i < x.i group by 1),
m as (select x.vec_id, j, avg(y.e[j]) as c from v x join v y on y.label = x.label and y.i < x.i, range(1, 65) t(j) group by 1, 2),
c as (select vec_id, list(c order by j) as c from m group by 1)
select v.vec_id, {r('novelty', 5)} as novelty, {r(f"1 - {_COS.format('v.e', 'c.c')}", 5)} as drift, {r('volatility', 5)} as volatility from v left join n using (vec_id) left join c using (vec_id)""",
)
def trajectory(spark, sf_dir):
    return tidy(b.EmbeddingTrajectory("vec_id", "label", "vec_id", "embedding").run(read(spark, sf_dir, "embeddings")), 5)


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"


def _lexicon_sql():
    from ..bridges.texts import LEXICONS

    values = ", ".join(f"('{w}', {v}::double)" for w, v in sorted(LEXICONS["xx"].items()))
    return f"""with w as (select doc_id, unnest({_WORDS}) as w from documents), l as (select * from (values {values}) t(w, v)), s as (select doc_id, avg(v) as v from w join l using (w) group by 1)
select doc_id, {r('v')} as sentiment from documents left join s using (doc_id)"""


@add("bridge_sentiment", _lexicon_sql())
def sentiment(spark, sf_dir):
    return tidy(b.Sentiment("doc_id", "text", "xx").run(read(spark, sf_dir, "documents")))



@add(
    "bridge_readability",
    f"""with d as (select doc_id, greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: trim(s, ' ') <> ''))) as s, {_WORDS} as ws from documents),
x as (select doc_id, s, len(ws) as n, list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - (len(regexp_extract_all(w, '[aeiouy]+')) > 1 and w like '%e' and w not like '%le')::int))) as y from d)
select doc_id, {r('206.835 - 1.015 * (n / s) - 84.6 * (y / n)', 4)} as readability from x""".replace("(n / s)", "(nullif(n, 0) / s)").replace("(y / n)", "(y / nullif(n, 0))"),
)
def readability(spark, sf_dir):
    return tidy(b.Readability("doc_id", "text", "en").run(read(spark, sf_dir, "documents")), 4)


def _language_sql():
    from ..bridges.texts import PROFILES

    hits = ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in words)}))) as n_{k}" for k, words in PROFILES.items())
    best = "greatest(" + ", ".join(f"n_{k}" for k in PROFILES) + ")"
    cases = " ".join(f"when n_{k} = {best} then '{k}'" for k in PROFILES)
    return f"select doc_id, case when {best} = 0 then null {cases} end as language from (select doc_id, {hits} from (select doc_id, {_WORDS} as w from documents))"


@add("bridge_language_id", _language_sql())
def language_id(spark, sf_dir):
    return b.LanguageId("doc_id", "text").run(read(spark, sf_dir, "documents"))


_NAMES = r"list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '\p{Lu}[\p{L}\p{N}_]+(?:\s+\p{Lu}[\p{L}\p{N}_]+)*')))"


@add("bridge_co_mention_edges", f"with m as (select conv_id, turn, unnest(n) as src, generate_subscripts(n, 1) as i, n from (select conv_id, turn, {_NAMES} as n from conversations)) select turn as ts, src, unnest(n[i + 1:]) as dst from m")
def co_mentions(spark, sf_dir):
    return b.CoMentionEdges("text", "turn").compute(read(spark, sf_dir, "conversations"))


_GRAMS = f"select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) else [array_to_string(w, ' ')] end) as g from (select doc_id, {_WORDS} as w from documents) where len(w) > 0"


@add(
    "bridge_near_duplicate_edges",
    f"""with s as ({_GRAMS}), m as (select doc_id, g, min(doc_id) over (partition by list_sort(g)) as first from s), r as (select doc_id, g from m where doc_id = first),
t as (select doc_id, unnest(g) as g from r), n as (select doc_id, len(g) as n from r),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from t x join t y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2)
select a as src, b as dst, b as ts, false as same from c join n x on x.doc_id = a join n y on y.doc_id = b where c / (x.n + y.n - c) >= 0.8
union all select first, doc_id, doc_id, true from m where doc_id <> first""",
)
def near_duplicates(spark, sf_dir):
    return b.NearDuplicateEdges("doc_id", "text", "doc_id").condensed(read(spark, sf_dir, "documents"))


def _edges(spark, sf_dir):
    return read(spark, sf_dir, "orders").selectExpr("o_custkey as s", "(o_orderkey * 7919 + 13) % 1500 as t", "o_totalprice as w")


@add("bridge_tfidf_topic_share")
def topic_share(spark, sf_dir):
    return tidy(b.TfidfTopicShare("conv_id", "text").run(read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))), 4)


@add("bridge_pagerank")
def pagerank(spark, sf_dir):
    return tidy(b.PageRank("s", "t").run(_edges(spark, sf_dir)))



@add("bridge_centrality")
def centrality(spark, sf_dir):
    return tidy(b.Centrality("s", "t", weight="w").run(_edges(spark, sf_dir)), 3)


@add("bridge_community")
def community(spark, sf_dir):
    return tidy(b.Community("s", "t").run(_edges(spark, sf_dir)))


@add(
    "bridge_snapshots",
    "select as_of_date, o_custkey as k, count(*)::bigint as n from (select unnest([date '1997-01-01', date '1999-01-01']) as as_of_date) join orders on o_orderdate <= as_of_date group by 1, 2",
)
def snapshots(spark, sf_dir):
    class Count(b.Bridge):
        values = {"n": "numeric"}

        def compute(self, rows, fit_rows):
            return rows.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))

    return tidy(Count().snapshots(read(spark, sf_dir, "orders"), ["1997-01-01", "1999-01-01"], "o_orderdate"))
