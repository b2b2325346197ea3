"""Features of an entity as the node of an edge table, measured at each as-of date.

Neighbour lists are undirected and without repetition or loops. Triangles are found by joining edges that point from the node of smaller
degree to the other, so for them a hub's list is never joined with itself. Nodes two steps away, of which a hub makes as many as the square
of its degree, are never listed: they are counted in bitmaps, for a share of the nodes and of the far ends at a time.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..boundary import AS_OF, q
from ..functions.aggregations import ratio

#: Shares of the far ends and of the nodes that are counted together. Sets of neighbours travel to each of the former, edges to each of the latter.
FAR_SHARES, NEAR_SHARES = 16, 2
#: List entries that are put in order at a time.
ENTRIES = 4_000_000


def features(c, entity, edge_entity, columns):
    """Rows (__node, as_of_date where edges have a time, features)."""
    spec = edge_entity.edge
    raw = c.tables(edge_entity.table)
    e = raw.select(q(spec.source).alias("s"), q(spec.target).alias("t"), (q(spec.weight) if spec.weight else F.lit(None)).cast("double").alias("w"), *([q(spec.timestamp).alias("ts")] if spec.timestamp else []))
    at = [AS_OF] if spec.timestamp else []
    e = c.dated(e, "ts") if at else e
    names = {metric: name for _, metric, name in columns}
    parts = []
    degree = [m for m in ("OUT_DEGREE", "IN_DEGREE", "DEGREE", "WEIGHTED_OUT_DEGREE", "WEIGHTED_IN_DEGREE") if m in names]
    if degree:
        parts.append(degrees(e, at).select(*at, "__node", *(q(m).alias(names[m]) for m in degree)))
    if "RECIPROCITY" in names:
        parts.append(reciprocity(e, at).withColumnRenamed("v", names["RECIPROCITY"]))
    pairs = neighbour_pairs(e, at)
    if "K_HOP_2_COUNT" in names:
        parts.append(two_hops(pairs, at).withColumnRenamed("v", names["K_HOP_2_COUNT"]))
    if "CLUSTERING_COEFF" in names:
        parts.append(clustering(pairs, at).withColumnRenamed("v", names["CLUSTERING_COEFF"]))
    link = [m for m in ("COMMON_NEIGHBOURS_MEAN", "JACCARD_MEAN", "ADAMIC_ADAR_MEAN") if m in names]
    if link:
        parts.append(link_prediction(pairs, at).select(*at, "__node", *(q(m).alias(names[m]) for m in link)))
    return reduce(lambda a, b: a.join(b, [*at, "__node"], "full_outer"), parts)


def degrees(e, at):
    ends = e.select(*at, "w", F.explode(F.array(F.struct(F.col("s").alias("n"), F.lit(True).alias("out")), F.struct(F.col("t").alias("n"), F.lit(False).alias("out")))).alias("x"))
    out, weight = F.col("x.out"), lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0))
    return (
        ends.groupBy(*at, F.col("x.n").alias("__node"))
        .agg(F.count_if(out).alias("OUT_DEGREE"), F.count_if(~out).alias("IN_DEGREE"), F.count("*").alias("DEGREE"), weight(out).alias("WEIGHTED_OUT_DEGREE"), weight(~out).alias("WEIGHTED_IN_DEGREE"))
        .where("__node is not null")
    )


def reciprocity(e, at):
    """The share of a node's out edges, repeated ones included, that have an edge back."""
    back = e.select(*at, F.col("t").alias("s"), F.col("s").alias("t")).distinct().withColumn("b", F.lit(1))
    return e.join(back, [*at, "s", "t"], "left").groupBy(*at, F.col("s").alias("__node")).agg(ratio(F.count("b"), F.count("*")).alias("v"))


def neighbour_pairs(e, at):
    """Distinct (a, b) in both directions, without loops."""
    return e.select(*at, F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("t").alias("b")), F.struct(F.col("t").alias("a"), F.col("s").alias("b")))).alias("x")).select(*at, "x.a", "x.b").where("a <> b").distinct()


def two_hops(pairs, at):
    """Nodes at a distance of exactly two. They depend on nothing but a node's set of neighbours, so each set is looked at once."""
    lists = pairs.groupBy(*at, "a").agg(F.sort_array(F.collect_list("b")).alias("near")).withColumn("first", F.min("a").over(Window.partitionBy(*at, "near")))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.array(*map(F.lit, range(n))))
    sets = lists.where("a = first").select(*at, "first", "near", share("first", NEAR_SHARES).alias("i")).withColumn("j", each(FAR_SHARES))
    edges = pairs.select(*(F.col(c).alias(c) for c in at), "a", F.col("b").alias("c"), share("b", FAR_SHARES).alias("j")).withColumn("i", each(NEAR_SHARES))
    keys = [*at, "i", "j"]

    def count(edges, sets):
        return sets.select([*at, "first"]).append_column("v", pa.array(reached(edges, sets["near"]), pa.int64()))

    kinds = ", ".join(f"`{c}` {sets.schema[c].dataType.simpleString()}" for c in [*at, "first"])
    found = edges.groupBy(*keys).cogroup(sets.groupBy(*keys)).applyInArrow(count, f"{kinds}, v long")
    found = found.groupBy(*at, "first").agg((F.sum("v") - 1).alias("v")).where("v > 0")  # less the node itself
    return lists.join(found, [*at, "first"]).select(*at, F.col("a").alias("__node"), "v")


def reached(edges, near):
    """For each set of nodes, the number of ends of their edges (a, c) that aren't in the set.

    Nodes with an end in one of 64 places or more have a bitmap, which takes no more memory than their edges; the ends of others are sorted.
    """
    near = near.combine_chunks() if isinstance(near, pa.ChunkedArray) else near
    if not len(near) or not len(edges):
        return np.zeros(len(near), np.int64)
    a, c = (edges[x].combine_chunks().dictionary_encode() for x in "ac")
    node, end, width, many = a.indices.to_numpy(), c.indices.to_numpy(), len(c.dictionary), len(a.dictionary)
    order = np.argsort(node, kind="stable")
    node, end = node[order], end[order]
    degree = np.bincount(node, minlength=many)
    first = np.concatenate([[0], np.cumsum(degree)])
    dense = degree * 64 >= width
    row = np.where(dense, np.cumsum(dense) - 1, -1)
    maps = np.zeros((int(dense.sum()), -(-width // 64)), np.uint64)
    for n in np.flatnonzero(dense).tolist():
        bits = np.zeros(maps.shape[1] * 64, np.uint8)
        bits[end[first[n] : first[n + 1]]] = 1
        maps[row[n]] = np.packbits(bits, bitorder="little").view(np.uint64)
    members = near.flatten()
    size = pc.list_value_length(near).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(near)), size)
    code = lambda known: pc.fill_null(pc.index_in(members, value_set=known), -1).to_numpy(zero_copy_only=False)
    via, own = code(a.dictionary), code(c.dictionary)
    work = np.concatenate([[0], np.cumsum(np.bincount(of[via >= 0], np.where(dense, 0, degree)[via[via >= 0]], len(near)))])
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(len(near), np.int64)
    lo = 0
    while lo < len(near):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + ENTRIES, "right")) - 1)
        at = slice(start[lo], start[hi])
        s, v, o = of[at] - lo, via[at], own[at]
        listed = (v >= 0) & ~dense[v]
        n = degree[v[listed]]
        ends = end[np.repeat(first[v[listed]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ends = np.unique(np.repeat(s[listed], n) * width + ends)
        mine = s[o >= 0] * width + o[o >= 0]
        mine.sort()
        found = np.bincount(ends // width, minlength=hi - lo) - np.bincount(mine[np.isin(mine, ends, assume_unique=True)] // width, minlength=hi - lo)
        mapped = (v >= 0) & dense[v]
        rows, whose = row[v[mapped]], s[mapped]
        cut = np.flatnonzero(np.diff(whose, prepend=-1))
        for k, at in enumerate(cut.tolist()):
            to, i = cut[k + 1] if k + 1 < len(cut) else len(rows), int(whose[at])
            bits = np.bitwise_or.reduce(maps[rows[at:to]], axis=0) if to - at < 64 else either(maps, rows[at:to])
            there = lambda x, bits=bits: (bits[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1
            e, m = (x[slice(*np.searchsorted(x, (i * width, (i + 1) * width)))] - i * width for x in (ends, mine))
            # those listed that aren't in the bitmap count once more; of the set's own nodes those in it go
            also = e[~there(e)]
            found[i] = int(np.bitwise_count(bits).sum()) + len(also) - int(there(m).sum()) - int(np.isin(m, also, assume_unique=True).sum())
        out[lo:hi] = found
        lo = hi
    return out


def either(maps, rows):
    bits = maps[rows[0]].copy()
    for r in rows[1:].tolist():
        np.bitwise_or(bits, maps[r], out=bits)
    return bits


def triangles(pairs, at):
    """(pairs with the degrees of both ends, triangles once each as x, y, z)."""
    degree = pairs.groupBy(*at, "a").agg(F.count("*").alias("d"))
    sized = pairs.join(degree.withColumnRenamed("d", "da"), [*at, "a"]).join(degree.select(*at, F.col("a").alias("b"), F.col("d").alias("db")), [*at, "b"])
    up = sized.where("da < db or (da = db and a < b)").select(*at, "a", "b", "db")
    wedge = up.select(*at, F.col("a").alias("x"), F.col("b").alias("y"), F.col("db").alias("dy")).join(up.select(*at, F.col("a").alias("x"), F.col("b").alias("z"), F.col("db").alias("dz")), [*at, "x"]).where("dy < dz or (dy = dz and y < z)")
    closed = wedge.join(up.select(*at, F.col("a").alias("y"), F.col("b").alias("z")), [*at, "y", "z"]).select(*at, "x", "y", "z")
    return sized, closed, degree


def clustering(pairs, at):
    """Closed pairs of neighbours over all pairs, null below two neighbours."""
    _, closed, degree = triangles(pairs, at)
    corners = closed.select(*at, F.explode(F.array("x", "y", "z")).alias("a")).groupBy(*at, "a").agg(F.count("*").alias("n"))
    d = F.col("d").cast("double")
    value = F.when(d >= 2, F.coalesce(F.col("n"), F.lit(0)) / (d * (d - 1) / 2))
    return degree.join(corners, [*at, "a"], "left").select(*at, F.col("a").alias("__node"), value.alias("v"))


def link_prediction(pairs, at):
    """Common neighbours, Jaccard and Adamic-Adar of a node with each neighbour, averaged; a pair without common neighbours counts as 0."""
    sized, closed, degree = triangles(pairs, at)
    weight = degree.select(*at, F.col("a").alias("m"), F.when(F.col("d") > 1, 1 / F.ln(F.col("d").cast("double"))).alias("w"))
    sides = closed.select(*at, F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(m).alias("m")) for a, b, m in ("xyz", "yxz", "xzy", "zxy", "yzx", "zyx")))).alias("s")).select(*at, "s.a", "s.b", "s.m")
    common = sides.join(weight, [*at, "m"]).groupBy(*at, "a", "b").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    every = sized.join(common, [*at, "a", "b"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    return every.groupBy(*at, F.col("a").alias("__node")).agg(
        F.avg(n).alias("COMMON_NEIGHBOURS_MEAN"), F.avg(ratio(n, F.col("da") + F.col("db") - n)).alias("JACCARD_MEAN"), F.avg(F.coalesce(F.col("w"), F.lit(0.0))).alias("ADAMIC_ADAR_MEAN")
    )
