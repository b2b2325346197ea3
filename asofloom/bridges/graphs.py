"""Bridges over whole graphs: iterations of joins, each round a written table.

Betweenness and closeness need the whole graph in each process. It is broadcast only up to ``max_edges`` edges; beyond, they raise.
Louvain communities come from one task, as each move depends on those before it; it holds the graph in arrays, which take about 70
bytes for an edge without a weight while they are built.
"""

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..boundary import q
from ..operators.graph import clustering, neighbour_pairs
from ..sources.scratch import written
from .base import Bridge

#: Edges that one process is given at most.
MAX_EDGES = 2_000_000


def simple_edges(rows, source, target, weight=None):
    """Distinct edges (s, t, w) without loops or missing ends; of repeated ones the greatest weight counts."""
    w = F.coalesce(q(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    e = rows.select(q(source).alias("s"), q(target).alias("t"), w.alias("w")).where("s is not null and t is not null and s <> t")
    return e.groupBy("s", "t").agg(F.max("w").alias("w"))


def both_ways(e):
    return e.unionByName(e.select(F.col("t").alias("s"), F.col("s").alias("t"), "w"))


class PageRank(Bridge):
    """Page rank of the nodes of an edge table, damping 0.85; the rank of nodes without an edge out goes to all alike.

    Stops when ranks, whose sum is 1, move by less than ``tolerance`` in all. Movement shrinks by the damping in each round, which bounds the
    rounds unless ``max_rounds`` does; ArithmeticError if these don't suffice. A node's own output key is ``node``.
    """

    values = {"pagerank": "numeric"}

    def __init__(self, source, target, directed=True, alpha=0.85, tolerance=1e-6, max_rounds=None, name="pagerank", node="node"):
        self.source, self.target, self.directed, self.alpha, self.tolerance, self.max_rounds, self.name, self.node = source, target, directed, alpha, tolerance, max_rounds, name, node

    def compute(self, rows, fit_rows):
        e = simple_edges(fit_rows, self.source, self.target)
        e = e if self.directed else both_ways(e).groupBy("s", "t").agg(F.max("w").alias("w"))
        e = written(e.select("s", "t"))
        nodes = e.select(F.explode(F.array("s", "t")).alias("n")).distinct()
        out = e.groupBy("s").agg(F.count("*").alias("d"))
        nodes = written(nodes.join(out.withColumnRenamed("s", "n"), "n", "left"))
        n = nodes.count()
        if not n:
            return nodes.select(F.col("n").alias(self.node), F.lit(None).cast("double").alias("pagerank"))
        ranks, new = nodes.withColumn("r", F.lit(1.0 / n)), None
        for _ in range(self.max_rounds or math.ceil(math.log(self.tolerance / 2) / math.log(self.alpha)) + 2):
            sent = e.join(ranks.where("d is not null").select(F.col("n").alias("s"), (F.col("r") / F.col("d")).alias("g")), "s").groupBy(F.col("t").alias("n")).agg(F.sum("g").alias("g"))
            lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("r"))), F.lit(0.0)).alias("lost"))
            joined = ranks.join(sent, "n", "left").crossJoin(F.broadcast(lost))
            value = F.lit((1 - self.alpha) / n) + self.alpha * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / n)
            new = written(joined.select("n", "d", value.alias("r"), F.abs(value - F.col("r")).alias("moved")), instead=new)
            moved = new.agg(F.sum("moved")).first()[0]
            ranks = new.drop("moved")
            if moved < self.tolerance:
                break
        else:
            raise ArithmeticError(f"ranks still move by {moved} in all")
        return ranks.select(F.col("n").alias(self.node), F.col("r").alias("pagerank"))


def coreness(e):
    """Rows (n, coreness): the largest k such that the node stays when nodes of fewer than k edges are taken away again and again.

    Every node's estimate, at first its degree, becomes the h-index of its neighbours' estimates until none changes. An edge that is there in
    both directions counts twice.
    """
    adjacent = written(both_ways(e).select(F.col("s").alias("n"), F.col("t").alias("m")))
    new = written(adjacent.groupBy("n").agg(F.count("*").alias("k")))
    now = new
    while True:
        heard = adjacent.join(now.select(F.col("n").alias("m"), F.col("k").alias("km")), "m").groupBy("n").agg(F.sort_array(F.collect_list("km"), False).alias("ks"))
        h = F.size(F.filter(F.transform("ks", lambda v, i: v >= i + 1), lambda ok: ok)).cast("long")
        new = written(now.join(heard, "n").select("n", F.least("k", h).alias("k"), (h < F.col("k")).alias("changed")), instead=new)
        done = new.where("changed").isEmpty()
        now = new.drop("changed")
        if done:
            return now.withColumnRenamed("k", "coreness")


class Centrality(Bridge):
    """Degree, in- and out-degree, weighted degree, coreness and clustering of each node; with ``heavy`` also betweenness, closeness and eigenvector."""

    CHEAP = ("degree", "in_degree", "out_degree", "weighted_degree", "coreness", "clustering")
    HEAVY = ("betweenness", "eigenvector", "closeness")

    def __init__(self, source, target, directed=True, weight=None, heavy=False, max_edges=MAX_EDGES, rounds=1000, name="centrality", node="node"):
        self.source, self.target, self.directed, self.weight, self.heavy, self.max_edges, self.rounds, self.name, self.node = source, target, directed, weight, heavy, max_edges, rounds, name, node
        self.values = dict.fromkeys([*self.CHEAP, *(self.HEAVY if heavy else ())], "numeric")

    def compute(self, rows, fit_rows):
        e = simple_edges(fit_rows, self.source, self.target, self.weight)
        if not self.directed:
            e = e.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), "w").groupBy("s", "t").agg(F.max("w").alias("w"))
        e = written(e)
        ends = e.select(F.explode(F.array(F.struct(F.col("s").alias("n"), F.lit(1).alias("out"), "w"), F.struct(F.col("t").alias("n"), F.lit(0).alias("out"), "w"))).alias("x")).select("x.*")
        out, degree = F.sum("out"), F.count("*")
        d = ends.groupBy("n").agg(degree.cast("double").alias("degree"), (degree - out if self.directed else degree).cast("double").alias("in_degree"), (out if self.directed else degree).cast("double").alias("out_degree"), F.sum("w").alias("weighted_degree"))
        # of an undirected view: a node with one neighbour has the clustering 0
        c = clustering(neighbour_pairs(e, []), []).select(F.col("__node").alias("n"), F.coalesce("v", F.lit(0.0)).alias("clustering"))
        d = d.join(coreness(e).withColumn("coreness", F.col("coreness").cast("double")), "n").join(c, "n", "left")
        if self.heavy:
            d = d.join(self._paths(e), "n", "left").join(self._eigenvector(e), "n", "left")
        return d.select(F.col("n").alias(self.node), *self.values)

    def _paths(self, e):
        """Betweenness and closeness: each task searches from some of the nodes in a broadcast graph and adds its shares."""
        size = e.count()
        if size > self.max_edges:
            raise ValueError(f"{size} edges are more than max_edges ({self.max_edges}): betweenness and closeness need the graph in one process")
        t = (e if self.directed else both_ways(e)).select("s", "t").toArrow()
        names = sorted({*t["s"].to_pylist(), *t["t"].to_pylist()})
        index = {x: i for i, x in enumerate(names)}
        forward, backward = [[] for _ in names], [[] for _ in names]
        for a, b in zip(t["s"].to_pylist(), t["t"].to_pylist(), strict=True):
            forward[index[a]].append(index[b])
            backward[index[b]].append(index[a])
        spark = e.sparkSession
        shared = spark.sparkContext.broadcast((forward, backward))

        def shares(batches: Iterator[pa.RecordBatch]):
            out_edges, in_edges = shared.value
            n = len(out_edges)
            between, close, seen = np.zeros(n), np.full(n, np.nan), False
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    seen = True
                    between += dependencies(out_edges, s)
                    far = distances(in_edges, s)
                    reached, total = len(far) - 1, sum(far.values())
                    close[s] = (reached / total) * (reached / (n - 1)) if total else 0.0
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(between), pa.array(close, from_pandas=True)], names=["i", "b", "c"])

        ids = spark.range(len(names)).repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
        got = ids.mapInArrow(shares, "i long, b double, c double").groupBy("i").agg(F.sum("b").alias("b"), F.max("c").alias("c"))
        n = len(names)
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        named = spark.createDataFrame(pa.table({"i": pa.array(range(n), pa.int64()), "n": pa.array(names)}))
        return got.join(named, "i").select("n", (F.col("b") * scale).alias("betweenness"), F.col("c").alias("closeness"))

    def _eigenvector(self, e, tolerance=1e-6):
        """Power iteration on A + 1 from a constant vector, of unit length. Null for all nodes where ``rounds`` don't suffice.

        It ends when the vector's movement, and what is left of the way if movement goes on shrinking as in this round, are below ``tolerance``.
        """
        a = written((e if self.directed else both_ways(e)).select("s", "t"))
        x = written(a.select(F.explode(F.array("s", "t")).alias("n")).distinct())
        x, last, new = x.withColumn("x", F.lit(1.0 / max(x.count(), 1) ** 0.5)), math.inf, None
        for _ in range(self.rounds):
            heard = a.join(x.select(F.col("n").alias("s"), "x"), "s").groupBy(F.col("t").alias("n")).agg(F.sum("x").alias("y"))
            y = x.join(heard, "n", "left").select("n", F.col("x").alias("old"), (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("y"))
            size = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("size"))
            new = written(y.crossJoin(F.broadcast(size)).select("n", (F.col("y") / F.col("size")).alias("x"), F.abs(F.col("y") / F.col("size") - F.col("old")).alias("moved")), instead=new)
            moved = new.agg(F.sqrt(F.sum(F.col("moved") * F.col("moved")))).first()[0] or 0.0
            x = new.drop("moved")
            if moved < 1e-15 or moved < min(last, tolerance) and moved * moved / (last - moved) < tolerance:
                break
            last = moved
        else:
            x = x.withColumn("x", F.lit(None).cast("double"))
        return x.withColumnRenamed("x", "eigenvector")


def distances(edges, start):
    """Steps to all nodes that can be reached."""
    far, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in edges[a]:
            if b not in far:
                far[b] = far[a] + 1
                queue.append(b)
    return far


def dependencies(edges, start):
    """What shortest paths from one node add to the betweenness of the others."""
    far, count, before, order = {start: 0}, defaultdict(float, {start: 1.0}), defaultdict(list), []
    queue = deque([start])
    while queue:
        a = queue.popleft()
        order.append(a)
        for b in edges[a]:
            if b not in far:
                far[b] = far[a] + 1
                queue.append(b)
            if far[b] == far[a] + 1:
                count[b] += count[a]
                before[b].append(a)
    out = np.zeros(len(edges))
    for b in reversed(order):
        for a in before[b]:
            out[a] += count[a] / count[b] * (1 + out[b])
    out[start] = 0
    return out


class Community(Bridge):
    """Communities of an undirected graph, and the modularity of the whole partition.

    By the Louvain method in one task, at every size; ValueError beyond ``max_edges`` edges where these are given. A community is named by its
    smallest node.
    """

    values = {"community": "categorical", "modularity": "numeric"}

    def __init__(self, source, target, weight=None, max_edges=None, name="community", node="node"):
        self.source, self.target, self.weight, self.max_edges, self.name, self.node = source, target, weight, max_edges, name, node

    def compute(self, rows, fit_rows):
        e = simple_edges(fit_rows, self.source, self.target, self.weight).select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), "w")
        e = written(e.groupBy("s", "t").agg(F.max("w").alias("w")))
        kind = e.schema["s"].dataType.simpleString()
        if self.max_edges is not None and (size := e.count()) > self.max_edges:
            raise ValueError(f"{size} edges are more than max_edges ({self.max_edges})")
        weighted = self.weight is not None

        def together(batches: Iterator[pa.RecordBatch]):
            parts, type_ = [], None
            for x in batches:
                type_ = x.schema.field("s").type
                parts.append(tuple(x.column(c).to_numpy(zero_copy_only=False) for c in ("s", "t", "w")[: 2 + weighted]))
            if not parts:
                return
            s, t, *w = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            names = np.unique(np.concatenate([np.unique(s), np.unique(t)]))
            s, t = (np.searchsorted(names, x).astype(np.int32) for x in (s, t))
            own = moved(len(names), s, t, *w)
            for at in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100_000], type_), pa.array(own[at : at + 100_000], pa.int64())], names=["n", "c"])

        found = written(e.repartition(1).mapInArrow(together, f"n {kind}, c long"))
        m = F.broadcast(modularity(e, found))
        first = found.groupBy("c").agg(F.min("n").alias("first"))
        return found.join(first, "c").crossJoin(m).select(F.col("n").alias(self.node), F.col("first").cast("string").alias("community"), "modularity")


def modularity(e, found):
    """One row with the modularity of a partition (n, c)."""
    side = lambda k: found.select(F.col("n").alias(k), F.col("c").alias(f"c{k}"))
    both = e.join(side("s"), "s").join(side("t"), "t")
    inner = both.agg(F.sum("w").alias("all"), F.sum(F.when(F.col("cs") == F.col("ct"), F.col("w")).otherwise(0.0)).alias("inside"))
    ends = both.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), "w"), F.struct(F.col("ct").alias("c"), "w"))).alias("x")).select("x.*")
    squares = ends.groupBy("c").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    return inner.crossJoin(squares).select((F.col("inside") / F.col("all") - F.col("squares") / (4 * F.col("all") * F.col("all"))).alias("modularity"))


def louvain(n, edges):
    """The community of each of n nodes: local moves while they gain modularity, then the same on the communities."""
    a, b, w = zip(*edges, strict=True) if edges else ((), (), ())
    return moved(n, np.asarray(a, np.int32), np.asarray(b, np.int32), np.asarray(w, float)).tolist()


def moved(n, a, b, w=None):
    """louvain() of edges in arrays: both ends, and weights unless all are 1."""
    total = float(len(a) if w is None else w.sum())
    own, loops = np.arange(n), np.zeros(n)
    if not total:
        return own
    first, to, w = neighbours(n, np.concatenate([a, b]), np.concatenate([b, a]), None if w is None else np.concatenate([w, w]))
    while True:
        size = len(loops)
        of = np.repeat(np.arange(size, dtype=np.int32), np.diff(first))
        degree = (np.bincount(of, w, size) + 2 * loops).tolist()
        label, gained = local_moves(first.tolist(), to, w, degree, total)
        if not gained:
            return own
        _, start, back = np.unique(label, return_index=True, return_inverse=True)
        index = np.empty(len(start), np.int32)
        index[np.argsort(start)] = np.arange(len(start))
        label = index[back]  # communities in the order of their first node
        own, size = label[own], len(start)
        inner, of, to = np.bincount(label, loops, size), label[of], label[to]
        inside = of == to
        inner += np.bincount(of[inside], None if w is None else w[inside], size) / 2
        between = of[~inside].astype(np.int64) * size + to[~inside]
        w = None if w is None else w[~inside]
        if w is None:
            keys, w = np.unique(between, return_counts=True)
            w = w.astype(float)
        else:
            keys, back = np.unique(between, return_inverse=True)
            w = np.bincount(back, w, len(keys))
        first, to, w = neighbours(size, (keys // size).astype(np.int32), (keys % size).astype(np.int32), w)
        loops = inner


def neighbours(n, of, to, w):
    """(where each node's neighbours begin, neighbours, weights)."""
    order = np.argsort(of, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    return first, to[order], None if w is None else w[order]


def local_moves(first, to, w, degree, total):
    """(the community of each node after moves that gain modularity, until there are none; whether there were any)."""
    label, weight, gained, more = np.arange(len(degree), dtype=np.int32), degree[:], False, True
    while more:
        more = False
        for i, d in enumerate(degree):
            at, end = first[i], first[i + 1]
            around = label[to[at:end]].tolist()
            home = int(label[i])
            ties = {home: 0.0}
            if w is None:
                for c in around:
                    ties[c] = ties.get(c, 0.0) + 1.0
            else:
                for c, x in zip(around, w[at:end].tolist(), strict=True):
                    ties[c] = ties.get(c, 0.0) + x
            weight[home] -= d
            best, most = home, ties[home] - weight[home] * d / (2 * total)
            for c in sorted(ties):
                gain = ties[c] - weight[c] * d / (2 * total)
                if gain > most + 1e-12:
                    best, most = c, gain
            weight[best] += d
            if best != home:
                label[i], more, gained = best, True, True
    return label, gained
