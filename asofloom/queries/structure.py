"""Spines, joins, roles, graph, peer, spatial and neighbour features, outputs."""

from pyspark.sql import functions as F

from ..boundary import q
from ..output import imputation, manifest
from .aggregations import config as orders_config
from .common import DATES, dates_sql, loom, r, read, tidy

QUERIES, SQL = {}, {}


def add(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def relation(parent, key, child, child_key, **more):
    return {"parent": {"entity": parent, "key": key}, "child": {"entity": child, "key": child_key}} | more


CUSTOMER = {"alias": "customer", "table": "customer", "id": "c_custkey", "variables": {"c_acctbal": "numeric"}}
ORDERS = {"alias": "orders", "table": "orders", "id": "o_orderkey", "temporal_ix": "o_orderdate", "variables": {"o_totalprice": "numeric"}}


def renamed(df, names, keys=("as_of_date", "c_custkey"), doubles=()):
    """doubles: whole numbers that may be missing, which the SQL gives as doubles."""
    return tidy(df.select(*map(q, keys), *((q(a).cast("double") if b in doubles else q(a)).alias(b) for a, b in names.items())))


# ---- the flagship: a spine of customers and dates with plain aggregations of orders

_FLAGSHIP = {f"{a.upper()}(orders.o_totalprice{i})": f"{a}{s}" for a in ("sum", "mean", "min", "max", "stddev", "median") for i, s in (("", ""), ("|interval=P6M", "_6m"), ("|interval=P1Y", "_1y"))}
_FLAGSHIP |= {f"{a.upper()}({c}{i})": f"{n}{s}" for a, c, n in (("count", "orders.o_orderkey", "orders"), ("recency", "orders.o_orderdate", "recency")) for i, s in (("", ""), ("|interval=P6M", "_6m"), ("|interval=P1Y", "_1y"))}
_X = "case when {0} then o_totalprice end"
_PLAIN = {"sum": "sum({})", "mean": "avg({})", "min": "min({})", "max": "max({})", "stddev": "stddev_samp({})", "median": "quantile_cont({}, 0.5)"}


def _flagship_sql():
    day = "o_orderdate::date"
    windows = {"": "true", "_6m": f"{day} >= (as_of_date - interval 6 month)::date", "_1y": f"{day} >= (as_of_date - interval 1 year)::date"}
    cells = []
    for s, w in windows.items():
        cells += [f"{r(e.format(_X.format(w)))} as {n}{s}" for n, e in _PLAIN.items()]
        cells += [f"count(case when {w} then 1 end)::double as orders{s}", f"date_diff('day', max(case when {w} then o_orderdate end)::date, as_of_date)::double as recency{s}"]
    names = [c.rpartition(" as ")[2] for c in cells]
    return f"""with {dates_sql()}, g as (select as_of_date, o_custkey, {', '.join(cells)} from a join orders on o_orderdate <= as_of_date group by 1, 2)
select a.as_of_date, c_custkey, {', '.join(names)} from a cross join customer left join g on g.as_of_date = a.as_of_date and g.o_custkey = c_custkey"""


@add("spine_customer_orders", _flagship_sql())
def spine_customer_orders(spark, sf_dir):
    config = {"target": "customer", "max_depth": 2, "intervals": ["P6M", "P1Y"], "aggregations": ["count", "sum", "mean", "min", "max", "stddev", "median", "recency"], "transformations": ["identity"], "entities": [{"alias": "customer", "table": "customer", "id": "c_custkey"}, ORDERS], "relationships": [relation("customer", "c_custkey", "orders", "o_custkey")]}
    return renamed(loom(spark, sf_dir, config).to_spark(list(_FLAGSHIP)), _FLAGSHIP, doubles=[n for n in _FLAGSHIP.values() if n.startswith(("orders", "recency"))])


@add(
    "spine_exclusive_boundary",
    f"""with {dates_sql()}, g as (select as_of_date, o_custkey, count(*) as n, count(case when o_orderdate::date >= (as_of_date - interval 6 month)::date then 1 end) as n6 from a join orders on o_orderdate < as_of_date group by 1, 2)
select a.as_of_date, c_custkey, n::double as orders, n6::double as orders_6m from a cross join customer left join g on g.as_of_date = a.as_of_date and g.o_custkey = c_custkey""",
)
def spine_exclusive_boundary(spark, sf_dir):
    config = {"target": "customer", "max_depth": 2, "intervals": ["P6M"], "as_of_boundary": "exclusive", "aggregations": ["count"], "transformations": ["identity"], "entities": [{"alias": "customer", "table": "customer", "id": "c_custkey"}, ORDERS], "relationships": [relation("customer", "c_custkey", "orders", "o_custkey")]}
    return renamed(loom(spark, sf_dir, config).to_spark(["COUNT(orders.o_orderkey*"]), {"COUNT(orders.o_orderkey)": "orders", "COUNT(orders.o_orderkey|interval=P6M)": "orders_6m"}, doubles=("orders", "orders_6m"))


@add(
    "spine_depth_3",
    f"""with {dates_sql()}, l as (select as_of_date, l_orderkey, sum(l_quantity) as qty, count(*) as n from a join lineitem on l_shipdate <= as_of_date group by 1, 2),
g as (select a.as_of_date, o_custkey, sum(qty) as sum_qty, avg(qty) as mean_qty, max(n) as max_lines from a join orders on o_orderdate <= a.as_of_date left join l on l.as_of_date = a.as_of_date and l_orderkey = o_orderkey group by 1, 2)
select a.as_of_date, c_custkey, {r('sum_qty')} as sum_qty, {r('mean_qty')} as mean_qty, {r('max_lines')} as max_lines from a cross join customer left join g on g.as_of_date = a.as_of_date and g.o_custkey = c_custkey""",
)
def spine_depth_3(spark, sf_dir):
    lines = {"alias": "lines", "table": "lineitem", "temporal_ix": "l_shipdate", "variables": {"l_quantity": "numeric"}}
    config = {"target": "customer", "max_depth": 3, "aggregations": ["sum", "mean", "max", "count"], "transformations": ["identity"], "entities": [{"alias": "customer", "table": "customer", "id": "c_custkey"}, ORDERS, lines], "relationships": [relation("customer", "c_custkey", "orders", "o_custkey"), relation("orders", "o_orderkey", "lines", "l_orderkey")]}
    names = {"SUM(orders.SUM(lines.l_quantity))": "sum_qty", "MEAN(orders.SUM(lines.l_quantity))": "mean_qty", "MAX(orders.COUNT(lines.l_shipdate))": "max_lines"}
    df = loom(spark, sf_dir, config).to_spark(list(names))
    return tidy(df.select("as_of_date", "c_custkey", *(q(a).cast("double").alias(b) for a, b in names.items())))


@add("join_direct", f"with {dates_sql(DATES[:1])} select as_of_date, c_custkey, n_name, r_name, {r('c_acctbal')} as c_acctbal from a, customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey")
def join_direct(spark, sf_dir):
    entities = [CUSTOMER, {"alias": "nation", "table": "nation", "id": "n_nationkey", "variables": {"n_name": "categorical"}}, {"alias": "region", "table": "region", "id": "r_regionkey", "variables": {"r_name": "categorical"}}]
    config = {"target": "customer", "max_depth": 4, "aggregations": ["count"], "transformations": ["identity"], "entities": entities, "relationships": [relation("nation", "n_nationkey", "customer", "c_nationkey"), relation("region", "r_regionkey", "nation", "n_regionkey")]}
    return renamed(loom(spark, sf_dir, config, DATES[:1]).to_spark(["n_name", "r_name", "c_acctbal"]), {"n_name": "n_name", "r_name": "r_name", "c_acctbal": "c_acctbal"})


_TRADES = "select o_orderkey, o_custkey as buyer, (o_custkey * 7 + 3) % (select count(*) from customer) as seller, o_orderdate, o_totalprice from orders"


@add(
    "join_named_parallel",
    f"""with {dates_sql(DATES[:1])}, t as ({_TRADES}), b as (select buyer, sum(o_totalprice) as s, count(*) as n from t, a where o_orderdate <= as_of_date group by 1), s as (select seller, sum(o_totalprice) as s, count(*) as n from t, a where o_orderdate <= as_of_date group by 1)
select as_of_date, c_custkey, {r('b.s')} as bought, b.n::double as buys, {r('s.s')} as sold, s.n::double as sales from a cross join customer left join b on buyer = c_custkey left join s on seller = c_custkey""",
)
def join_named_parallel(spark, sf_dir):
    n = read(spark, sf_dir, "customer").count()
    trades = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("buyer"), ((F.col("o_custkey") * 7 + 3) % n).alias("seller"), "o_orderdate", "o_totalprice")
    entities = [{"alias": "customer", "table": "customer", "id": "c_custkey"}, ORDERS | {"alias": "trades", "table": "trades"}]
    config = {"target": "customer", "max_depth": 2, "aggregations": ["sum", "count"], "transformations": ["identity"], "entities": entities, "relationships": [relation("customer", "c_custkey", "trades", "buyer", name="bought"), relation("customer", "c_custkey", "trades", "seller", name="sold")]}
    names = {"SUM(bought.o_totalprice)": "bought", "COUNT(bought.o_orderkey)": "buys", "SUM(sold.o_totalprice)": "sold", "COUNT(sold.o_orderkey)": "sales"}
    return renamed(loom(spark, sf_dir, config, DATES[:1], {"trades": trades}).to_spark(list(names)), names, doubles=("buys", "sales"))


@add(
    "join_diamond",
    f"""with {dates_sql(DATES[:1])} select as_of_date, l_orderkey, l_partkey, {r('l_quantity')} as l_quantity, {r('s_acctbal')} as s_acctbal, {r('c_acctbal')} as c_acctbal, n1.n_name as supplier_nation, n2.n_name as customer_nation
from a, lineitem left join supplier on s_suppkey = l_suppkey left join nation n1 on n1.n_nationkey = s_nationkey left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation n2 on n2.n_nationkey = c_nationkey""",
)
def join_diamond(spark, sf_dir):
    nation = {"alias": "nation", "table": "nation", "id": "n_nationkey", "variables": {"n_name": "categorical"}}
    entities = [
        {"alias": "lines", "table": "lineitem", "variables": {"l_quantity": "numeric", "l_partkey": "index"}},
        {"alias": "supplier", "table": "supplier", "id": "s_suppkey", "variables": {"s_acctbal": "numeric"}},
        {"alias": "orders", "table": "orders", "id": "o_orderkey"},
        CUSTOMER,
        nation,
    ]
    relations = [relation("supplier", "s_suppkey", "lines", "l_suppkey"), relation("orders", "o_orderkey", "lines", "l_orderkey"), relation("customer", "c_custkey", "orders", "o_custkey"), relation("nation", "n_nationkey", "supplier", "s_nationkey", name="sn"), relation("nation", "n_nationkey", "customer", "c_nationkey", name="cn")]
    config = {"target": "lines", "max_depth": 4, "aggregations": [], "transformations": ["identity"], "entities": entities, "relationships": relations}
    f = loom(spark, sf_dir, config, DATES[:1])
    keys = spark_keys(f, ["l_orderkey", "l_partkey"])
    return tidy(keys.select("as_of_date", "l_orderkey", "l_partkey", *(q(a).alias(b) for a, b in {"l_quantity": "l_quantity", "s_acctbal": "s_acctbal", "c_acctbal": "c_acctbal", "sn.n_name": "supplier_nation", "cn.n_name": "customer_nation"}.items())))


def spark_keys(f, keys):
    """A target without an id: its matrix with other identifier columns."""
    from ..plans.compile import Compiler, as_of_frame

    c = Compiler(f.planner, f.tables, as_of_frame(f.spark, f._as_of), f.config.get("as_of_boundary", "inclusive"))
    c.matrix()
    df = c.dated(c.frames[f.planner.target])
    return df.select("as_of_date", *keys, *(q(n) for n in f.features))


def _as_of(grace):
    config = {
        "target": "buys",
        "max_depth": 2,
        "aggregations": [],
        "transformations": ["identity"],
        "entities": [
            {"alias": "buys", "table": "buys", "id": "event_id", "temporal_ix": "ts", "variables": {"value": "numeric"}},
            {"alias": "views", "table": "views", "id": "view_id", "temporal_ix": "view_ts", "variables": {"viewed": "numeric", "props": "categorical"}},
        ],
        "relationships": [relation("views", "viewer", "buys", "user_id", name="last", temporal={"mode": "as_of"} | ({"grace": grace} if grace else {}))],
    }

    def run(spark, sf_dir):
        events = read(spark, sf_dir, "events")
        views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("view_ts"), F.col("value").alias("viewed"), "props")
        tables = {"buys": events.where("event_type = 'purchase'"), "views": views}
        df = loom(spark, sf_dir, config, ["2024-01-31"], tables).to_spark()
        return renamed(df, {"value": "value", "last.viewed": "viewed", "last.props": "props"}, ("event_id",))

    return run


def _as_of_sql(grace):
    bound = f" and v.ts >= b.ts - interval '{grace}'" if grace else ""
    return f"""select b.event_id, {r('b.value')} as value, {r('v.value')} as viewed, v.props from (select * from events where event_type = 'purchase') b
left join lateral (select * from events v where v.event_type = 'view' and v.user_id = b.user_id and v.ts <= b.ts{bound} order by v.ts desc, v.event_id desc limit 1) v on true"""


QUERIES |= {"join_asof": _as_of(None), "join_asof_grace": _as_of("P1D")}
SQL |= {"join_asof": _as_of_sql(None), "join_asof_grace": _as_of_sql("1 day")}


@add("one_hot", f"with {dates_sql(DATES[:1])} select as_of_date, c_custkey, (c_mktsegment = 'BUILDING')::bigint as building, (c_mktsegment = 'MACHINERY')::bigint as machinery, 0::bigint as other from a, customer")
def one_hot(spark, sf_dir):
    entity = CUSTOMER | {"variables": {"c_mktsegment": {"type": "categorical", "role": "categorical", "vocabulary": ["MACHINERY", "BUILDING", "OTHER"]}, "c_name": {"type": "text", "role": "identifier"}}}
    config = {"target": "customer", "max_depth": 1, "transformations": ["identity"], "entities": [entity]}
    f = loom(spark, sf_dir, config, DATES[:1])
    return renamed(f.to_spark(), {f"customer.c_mktsegment={v}": v.lower() for v in ("BUILDING", "MACHINERY", "OTHER")})


# ---- graph: customers, with an edge for each order

_EDGES = "select o_custkey as s, (o_orderkey * 7919 + 13) % 1500 as t, o_orderdate as ts, o_totalprice as w from orders"
_GRAPH_DATES = ["1998-01-01", "2001-08-01"]
_E = f"""{dates_sql(_GRAPH_DATES)}, e as (select as_of_date, s, t, w from a, ({_EDGES}) where ts <= as_of_date),
n as (select distinct as_of_date, s as a, t as b from e where s <> t union select as_of_date, t, s from e where s <> t), d as (select as_of_date, a, count(*) as d from n group by 1, 2)"""
_ALL = "from a cross join customer left join g on g.as_of_date = a.as_of_date and g.node = c_custkey"
_GRAPH = {
    "degree": (["OUT_DEGREE", "IN_DEGREE", "DEGREE", "WEIGHTED_OUT_DEGREE", "WEIGHTED_IN_DEGREE"], "select as_of_date, node, count(*) filter (o) as out_degree, count(*) filter (not o) as in_degree, count(*) as degree, coalesce(sum(w) filter (o), 0) as weighted_out_degree, coalesce(sum(w) filter (not o), 0) as weighted_in_degree from (select as_of_date, s as node, true as o, w from e union all select as_of_date, t, false, w from e) group by 1, 2"),
    "reciprocity": (["RECIPROCITY"], "select as_of_date, s as node, avg((exists (select 1 from e r where r.as_of_date = e.as_of_date and r.s = e.t and r.t = e.s))::int) as reciprocity from e group by 1, 2"),
    "k_hop_2": (["K_HOP_2_COUNT"], "select x.as_of_date, x.a as node, count(distinct y.b) as k_hop_2_count from n x join n y on y.as_of_date = x.as_of_date and y.a = x.b where y.b <> x.a and not exists (select 1 from n z where z.as_of_date = x.as_of_date and z.a = x.a and z.b = y.b) group by 1, 2"),
    "clustering": (["CLUSTERING_COEFF"], "select d.as_of_date, d.a as node, case when d >= 2 then coalesce(c, 0) / (d * (d - 1) / 2.0) end as clustering_coeff from d left join (select x.as_of_date, x.a, count(*) as c from n x join n y on y.as_of_date = x.as_of_date and y.a = x.a and y.b > x.b join n z on z.as_of_date = x.as_of_date and z.a = x.b and z.b = y.b group by 1, 2) c on c.as_of_date = d.as_of_date and c.a = d.a"),
}
_PAIRS = "select n.as_of_date, n.a as node, n.b, d1.d as da, d2.d as db, coalesce(c, 0) as c, coalesce(aa, 0) as aa from n join d d1 on d1.as_of_date = n.as_of_date and d1.a = n.a join d d2 on d2.as_of_date = n.as_of_date and d2.a = n.b left join (select x.as_of_date, x.a, x.b, count(*) as c, sum(1 / nullif(ln(d.d), 0)) as aa from n x join n y on y.as_of_date = x.as_of_date and y.a = x.a join n z on z.as_of_date = x.as_of_date and z.a = x.b and z.b = y.b join d on d.as_of_date = x.as_of_date and d.a = y.b group by 1, 2, 3) p on p.as_of_date = n.as_of_date and p.a = n.a and p.b = n.b"
for _f, _m, _v in (("common_neighbours", "COMMON_NEIGHBOURS_MEAN", "avg(c)"), ("jaccard", "JACCARD_MEAN", "avg(c / nullif(da + db - c, 0))"), ("adamic_adar", "ADAMIC_ADAR_MEAN", "avg(aa)")):
    _GRAPH[_f] = ([_m], f"select as_of_date, node, {_v} as {_m.lower()} from ({_PAIRS}) group by 1, 2")


def _graph(family):
    metrics = _GRAPH[family][0]

    def run(spark, sf_dir):
        edges = read(spark, sf_dir, "orders").selectExpr("o_custkey as s", "(o_orderkey * 7919 + 13) % 1500 as t", "o_orderdate as ts", "o_totalprice as w")
        edge = {"alias": "links", "table": "links", "edge": {"node": "customer", "source": "s", "target": "t", "weight": "w", "timestamp": "ts", "features": [family]}}
        config = {"target": "customer", "max_depth": 1, "transformations": ["identity"], "entities": [{"alias": "customer", "table": "customer", "id": "c_custkey"}, edge]}
        df = loom(spark, sf_dir, config, _GRAPH_DATES, {"links": edges}).to_spark()
        return renamed(df, {f"{m}(customer.links)": m.lower() for m in metrics}, doubles=[m.lower() for m in metrics])

    return run


for _f, (_m, _body) in _GRAPH.items():
    QUERIES[f"graph_{_f}"] = _graph(_f)
    _cells = ", ".join(f"{r(m.lower(), 3) if m.startswith('WEIGHTED') else r(m.lower())} as {m.lower()}" for m in _m)
    SQL[f"graph_{_f}"] = f"with {_E}, g as ({_body}) select a.as_of_date, c_custkey, {_cells} {_ALL}"

# ---- peers, without and with a time of entry

_PEERS = {"PEER_GROUP_SIZE({} by c_mktsegment)": "size", "PEER_MEAN({}.c_acctbal by c_mktsegment)": "peer_mean", "EGO_MINUS_PEER_MEAN({}.c_acctbal by c_mktsegment)": "minus_mean", "PEER_ZSCORE({}.c_acctbal by c_mktsegment)": "zscore", "PEER_PCTILE({}.c_acctbal by c_mktsegment)": "pctile", "PEER_EVENT_RATE({}.orders by c_mktsegment)": "event_rate"}
_JOINED = "timestamp '1995-01-01' + to_days((c_custkey % 2000)::int)"


def _peers(timed):
    def run(spark, sf_dir):
        members = read(spark, sf_dir, "customer").withColumn("joined", F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(cast(c_custkey % 2000 as int))"))
        entity = {"alias": "m", "table": "members", "id": "c_custkey", "variables": {"c_acctbal": "numeric", "c_mktsegment": "categorical"}, "peer_groups": [{"by": "c_mktsegment"}]} | ({"temporal_ix": "joined"} if timed else {})
        config = {"target": "m", "max_depth": 1, "transformations": ["identity"], "entities": [entity, ORDERS], "relationships": [relation("m", "c_custkey", "orders", "o_custkey")]}
        names = {k.format("m"): v for k, v in _PEERS.items()}
        return renamed(loom(spark, sf_dir, config, DATES[:2], {"members": members}).to_spark(list(names)), names)

    return run


def _peers_sql(timed):
    inside = f"({_JOINED} <= as_of_date)::int" if timed else "1"
    return f"""with {dates_sql(DATES[:2])}, c as (select as_of_date, c_custkey, c_mktsegment as g, c_acctbal as x, {inside} as i from a, customer),
o as (select as_of_date, o_custkey, count(*) as n from a join orders on o_orderdate <= as_of_date group by 1, 2),
m as (select c.*, coalesce(o.n, 0) as n from c left join o on o.as_of_date = c.as_of_date and o_custkey = c_custkey),
s as (select as_of_date, g, count(*) as n, sum(x) as sx, sum(x * x) as sxx, sum(n) as sn from m where i = 1 group by 1, 2),
p as (select m.*, s.n - i as k, sx - i * x as t, sxx - i * x * x as tt, sn - i * m.n as e, (select count(*) from m y where y.as_of_date = m.as_of_date and y.g = m.g and y.i = 1 and y.x < m.x) as below from m join s using (as_of_date, g))
select c.as_of_date, c.c_custkey, k as size, {r('t / nullif(k, 0)')} as peer_mean, {r('c.x - t / nullif(k, 0)')} as minus_mean, {r('(c.x - t / nullif(k, 0)) / nullif(sqrt(greatest((tt - t * t / nullif(k, 0)) / nullif(k - 1, 0), 0)), 0)')} as zscore,
  {r('below / nullif(k, 0)')} as pctile, {r('e / nullif(k, 0)')} as event_rate
from c left join p on p.as_of_date = c.as_of_date and p.c_custkey = c.c_custkey"""


QUERIES |= {"peers": _peers(False), "peers_timed": _peers(True)}
SQL |= {"peers": _peers_sql(False), "peers_timed": _peers_sql(True)}

# ---- spatial: suppliers near customers, and customers near each other

_LAT, _LON = "40 + ({} * 37 % 1000) / 1000.0", "-87 + ({} * 91 % 1000) / 1000.0"


def located(df, key, ts=None):
    df = df.withColumns({"lat": F.expr(_LAT.format(key).replace("1000.0", "1000d")), "lon": F.expr(_LON.format(key).replace("1000.0", "1000d"))})
    return df.withColumn("since", F.expr(f"timestamp_ntz'1995-01-01' + make_dt_interval(cast({key} % 2000 as int))")) if ts else df


def _distance(a, b):
    h = f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    return f"2 * 6371000.0 * asin(sqrt({h}))"


def _near_sql(left, right, same):
    point = lambda t, k: f"(select {k} as id, {_LAT.format(k)} as lat, {_LON.format(k)} as lon, timestamp '1995-01-01' + to_days(({k} % 2000)::int) as since from {t})"
    apart = " and l.id <> z.id" if same else ""
    return f"""with {dates_sql(DATES[:2])}, d as (select l.id, z.id as other, z.since, {_distance('l', 'z')} as m from {point(*left)} l, {point(*right)} z where abs(l.lat - z.lat) < 0.06{apart}),
g as (select as_of_date, id, count(*) as n, min(m) as nearest, sum(exp(-m * m / (2 * 3000.0 * 3000.0))) as kde from a join d on m <= 5000 and since <= as_of_date group by 1, 2)
select a.as_of_date, p.{left[1]}, coalesce(n, 0) as n, {r('nearest', 3)} as nearest, {r('kde')} as kde from a cross join {left[0]} p left join g on g.as_of_date = a.as_of_date and g.id = p.{left[1]}"""


def _near(left, right):
    def run(spark, sf_dir):
        tables = {"here": located(read(spark, sf_dir, left[0]), left[1]), "there": located(read(spark, sf_dir, right[0]), right[1], True)}
        where = {"spatial_ix": {"lat": "lat", "lon": "lon"}}
        entities = [{"alias": "here", "table": "here", "id": left[1]} | where, {"alias": "there", "table": "there", "id": right[1], "temporal_ix": "since"} | where]
        spec = {"name": "near", "left": "here", "right": "there", "within_m": 5000, "bandwidth_m": 3000}
        if left == right:
            tables["here"], entities, spec["right"] = tables["there"], [entities[0] | {"temporal_ix": "since"}], "here"
        config = {"target": "here", "max_depth": 1, "transformations": ["identity"], "entities": entities, "spatial_relationships": [spec]}
        df = loom(spark, sf_dir, config, DATES[:2], tables).to_spark()
        df = df.withColumn("DISTANCE_TO_NEAREST(near)", F.round(q("DISTANCE_TO_NEAREST(near)"), 3))
        return renamed(df, {"COLOCATION_COUNT(near)": "n", "DISTANCE_TO_NEAREST(near)": "nearest", "KDE_INTENSITY(near)": "kde"}, ("as_of_date", left[1]))

    return run


_C, _S = ("customer", "c_custkey"), ("supplier", "s_suppkey")
QUERIES |= {"spatial_suppliers_near": _near(_C, _S), "spatial_same_entity": _near(_C, _C)}
SQL |= {"spatial_suppliers_near": _near_sql(_C, _S, False), "spatial_same_entity": _near_sql(_C, _C, True)}

# ---- neighbours one edge away


def _neighbours(directed):
    def run(spark, sf_dir):
        edges = read(spark, sf_dir, "orders").selectExpr("o_custkey as s", "(o_orderkey * 7919 + 13) % 1500 as t", "o_orderdate as ts")
        states = read(spark, sf_dir, "customer").withColumns({"rich": F.col("c_acctbal") > 5000, "since": F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(cast(c_custkey % 2000 as int))")})
        entity = {"alias": "c", "table": "states", "id": "c_custkey", "temporal_ix": "since", "variables": {"c_acctbal": "numeric", "rich": "boolean"}}
        spec = {"name": "linked", "left": "c", "directed": directed, "edges": {"table": "links", "source": "s", "target": "t", "timestamp": "ts"}}
        config = {"target": "c", "max_depth": 1, "intervals": ["P1Y"], "transformations": ["identity"], "entities": [entity], "graph_relationships": [spec]}
        names = {"DEGREE(linked)": "degree", "DEGREE(linked|interval=P1Y)": "degree_1y", "NEIGHBOUR_MEAN(linked.c_acctbal)": "mean_acctbal", "NEIGHBOUR_SHARE(linked.rich)": "share_rich"}
        return renamed(loom(spark, sf_dir, config, _GRAPH_DATES, {"links": edges, "states": states}).to_spark(list(names)), names, doubles=("degree", "degree_1y"))

    return run


def _neighbours_sql(directed):
    back = "" if directed else f" union all select t, s, ts, w from ({_EDGES})"
    return f"""with {dates_sql(_GRAPH_DATES)}, e as (select as_of_date, s, t, ts from a, (select * from ({_EDGES}){back}) where ts <= as_of_date),
g as (select as_of_date, s, count(*) as n, count(case when ts::date >= (as_of_date - interval 1 year)::date then 1 end) as n1 from e group by 1, 2),
h as (select as_of_date, s, avg(c_acctbal) as m, avg((c_acctbal > 5000)::int) as p from e join customer on c_custkey = t and {_JOINED} <= as_of_date group by 1, 2)
select a.as_of_date, c_custkey, n::double as degree, n1::double as degree_1y, {r('m')} as mean_acctbal, {r('p')} as share_rich
from a cross join customer left join g on g.as_of_date = a.as_of_date and g.s = c_custkey left join h on h.as_of_date = a.as_of_date and h.s = c_custkey"""


QUERIES |= {"neighbours_directed": _neighbours(True), "neighbours_undirected": _neighbours(False)}
SQL |= {"neighbours_directed": _neighbours_sql(True), "neighbours_undirected": _neighbours_sql(False)}

# ---- outputs


@add(
    "impute",
    f"""with {dates_sql(DATES[:1])}, g as (select o_custkey, count(*) as n, stddev_samp(o_totalprice) as s from orders, a where o_orderdate <= as_of_date group by 1)
select as_of_date, c_custkey, coalesce(n, 0) as orders, {r('s')} as stddev, (n is null)::bigint as orders_missing, (s is null)::bigint as stddev_missing from a cross join customer left join g on o_custkey = c_custkey""",
)
def impute(spark, sf_dir):
    config = orders_config(["count", "stddev"], ()) | {"entities": [{"alias": "customer", "table": "customer", "id": "c_custkey"}, ORDERS]}
    f = loom(spark, sf_dir, config, DATES[:1])
    df = f.to_spark(["COUNT(orders.o_orderkey)", "STDDEV(orders.o_totalprice)"])
    df = imputation.impute(df, f.keys)
    return renamed(df, {"COUNT(orders.o_orderkey)": "orders", "STDDEV(orders.o_totalprice)": "stddev", "COUNT(orders.o_orderkey)__missing": "orders_missing", "STDDEV(orders.o_totalprice)__missing": "stddev_missing"})


@add("manifest", "select * from (values ('COUNT(orders.o_orderkey)', 'derived', 1, null), ('COUNT(orders.o_orderdate)', 'derived', 1, null), ('SUM(orders.o_totalprice)', 'derived', 1, null), ('SUM(orders.o_totalprice|interval=P6M)', 'derived', 1, 'P6M'), ('COUNT(orders.o_orderkey|interval=P6M)', 'derived', 1, 'P6M'), ('COUNT(orders.o_orderdate|interval=P6M)', 'derived', 1, 'P6M')) t(label, kind, depth, \"interval\")")
def manifest_table(spark, sf_dir):
    config = orders_config(["count", "sum"], ("P6M",)) | {"entities": [{"alias": "customer", "table": "customer", "id": "c_custkey"}, ORDERS]}
    return manifest.to_spark(spark, loom(spark, sf_dir, config).manifest).select("label", "kind", F.col("depth").cast("int").alias("depth"), "interval")


def all_aggregations(spark, sf_dir):
    """Every aggregation of orders by customer, with a window: the widest matrix of one child."""
    from ..functions.registry import AGGREGATIONS
    from .aggregations import orders

    return loom(spark, sf_dir, orders_config(AGGREGATIONS.names()), tables={"orders": orders(spark, sf_dir)}).to_spark()
