"""Operator 6: exact top-k search by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it, and the index is kept sorted by both, in ranges of bounded size. A query
first searches its own pivot's cell, which bounds the distance of its k-th neighbour. By the triangle inequality a neighbour within the
bound r can only be in the annulus [d(q, p) - r, d(q, p) + r] around a pivot p; runs of a cell that miss the annulus, or that lie beyond the
hyperplane between two pivots by more than r, are never compared. In a run the annulus is expanded from the query's own distance outward and
stops when the bound is met. The result is that of brute force.

Queries come in blocks of bounded bytes, each broadcast against the whole index. Equal vectors are one row of the index, so a group of them
costs no more than one, however many they are.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .sharding import in_ranges

K = 10
#: Queries are the rows whose id is divisible by this.
EVERY = 20
#: Vectors of a cell that the number of pivots aims at, pivots at most, and vectors for each that pivots are fitted on. None changes the result.
CELL_ROWS, MAX_PIVOTS, SAMPLE_PER_PIVOT = 2048, 1024, 32
#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Distances computed in one step: queries x vectors.
BLOCK = 1 << 21
#: Rows of a range of the index; it has at least as many ranges as there are shuffle partitions.
INDEX_ROWS = 1 << 18

KEY = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())])
FOUND = "q int, vid long, d double"


def fit_pivots(sample, count, rounds=5, seed=1):
    """``count`` pivots of a sample: a few rounds of k-means from distinct rows."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    pivots = sample[rng.permutation(len(sample))[:count]].copy()
    for _ in range(rounds):
        own = np.concatenate([squares(sample[a : a + 4096], pivots).argmin(axis=1) for a in range(0, len(sample), 4096)])
        n = np.bincount(own, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, own, sample)
        pivots[n > 0] = total[n > 0] / n[n > 0, None]
    return pivots


def squares(a, b):
    """Squared distances by one matrix product."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def slack(a, b):
    """How far the squares of squares() may be off."""
    return 1e-13 * (float((a * a).sum(1).max(initial=0)) + float((b * b).sum(1).max(initial=0))) + 1e-300


def matrix(column, dim):
    """A list column as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def ranked(i, j, d, vid, k):
    """The k first of each i by (d, vid), of three arrays, in that order."""
    order = np.lexsort((vid, d, i))
    i, j, d, vid = i[order], j[order], d[order], vid[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep], vid[keep]


def best(q, x, vid, k, bound, tol):
    """(query row, vector row, distance) of the k nearest of each query within its bound, ordered by (distance, vid).

    The matrix product only chooses candidates, with some slack; distances are then computed anew from differences, so that equal vectors
    have equal distances wherever they are compared.
    """
    d2 = squares(q, x)
    limit = np.where(np.isfinite(bound), bound, 1e150) ** 2 + tol
    if d2.shape[1] > k:
        limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * tol)
    i, j = np.nonzero(d2 <= limit[:, None])
    d = np.sqrt(((q[i] - x[j]) ** 2).sum(axis=1))
    return ranked(i, j, d, vid[j], k)[:3]


def expand(q, dq, bound, x, dx, vid, k, tol):
    """Neighbours in a run sorted by dx: rings around each query's own distance, the nearest first, until the bound is met."""
    order = np.argsort(dq, kind="stable")
    step = max(1, min(512, BLOCK // max(1, len(x))))
    out, room = [], np.sqrt(tol)
    for s in range(0, len(order), step):
        o = order[s : s + step]
        b = bound[o].copy()
        lo0 = hi0 = int(np.searchsorted(dx, dq[o].mean()))
        ring = max(1024, k * 8)
        got_i, got_j, got_d = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        while True:
            # what the triangle inequality still leaves open, for any query of the step
            lo_end = int(np.searchsorted(dx, (dq[o] - b - room).min(), side="left"))
            hi_end = int(np.searchsorted(dx, (dq[o] + b + room).max(), side="right"))
            lo1, hi1 = max(lo_end, lo0 - ring) if lo_end < lo0 else lo0, min(hi_end, hi0 + ring) if hi_end > hi0 else hi0
            if lo1 == lo0 and hi1 == hi0:
                break
            new = np.concatenate([np.arange(lo1, lo0), np.arange(hi0, hi1)])
            i, j, d = best(q[o], x[new], vid[new], k, b, tol)
            i, j, d = np.concatenate([got_i, i]), np.concatenate([got_j, new[j]]), np.concatenate([got_d, d])
            got_i, got_j, got_d, _ = ranked(i, j, d, vid[j], k)
            full = np.bincount(got_i, minlength=len(o)) == k
            last = np.zeros(len(o))
            np.maximum.at(last, got_i, got_d)
            b[full] = np.minimum(b[full], last[full])
            lo0, hi0, ring = lo1, hi1, ring * 4
        out.append((o[got_i], got_j, got_d))
    return [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def searcher(shared, dim, k, own_only):
    """An Arrow map over the index (vid, v, cell, dist): the k nearest vectors that a task has for each query of the broadcast block."""

    def search(batches):
        block = shared.value
        q, own, near, pivots = block["q"], block["own"], block["near"], block["pivots"]
        bound = block["bound"].copy()
        have_d, have_v = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            cells, dist = batch.column("cell").to_numpy(), batch.column("dist").to_numpy()
            order = np.lexsort((dist, cells))
            x, vid = matrix(batch.column("v"), dim), batch.column("vid").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], np.diff(cells[order]) != 0])) if len(order) else []
            for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
                rows, c = order[s:e], int(cells[order[s]])
                dx, p = dist[rows], pivots[c : c + 1]
                tol = slack(q, x[rows])
                room = np.sqrt(tol)
                if own_only:
                    go = np.flatnonzero(own == c)
                    dq = near[go]
                else:
                    d = np.sqrt(squares(q, p)[:, 0])
                    gap = np.sqrt(squares(pivots, p)[:, 0])[own]
                    # distance to the hyperplane that separates the cells
                    plane = np.where(own == c, 0.0, (d**2 - near**2) / (2 * np.maximum(gap, 1e-300)))
                    go = np.flatnonzero((d - bound - room <= dx[-1]) & (d + bound + room >= dx[0]) & ((plane <= bound + 2 * room) | (gap <= room)))
                    dq = d[go]
                if not len(go):
                    continue
                i, j, d = expand(q[go], dq, bound[go], x[rows], dx, vid[rows], k, tol)
                if not len(i):
                    continue
                at = np.unique(go[i])
                i2 = np.concatenate([np.repeat(at, k), go[i]])
                d2, v2 = np.concatenate([have_d[at].ravel(), d]), np.concatenate([have_v[at].ravel(), vid[rows][j]])
                i2, _, d2, v2 = ranked(i2, i2, d2, v2, k)
                have_d[at], have_v[at] = d2.reshape(-1, k), v2.reshape(-1, k)
                bound[at] = np.minimum(bound[at], have_d[at, -1])
        i, j = np.nonzero(np.isfinite(have_d))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(have_v[i, j]), pa.array(have_d[i, j])], names=["q", "vid", "d"])

    return search


def top_k(df, k=K, every=EVERY, cell_rows=CELL_ROWS, id_col="vec_id", vec_col="embedding", block_bytes=BLOCK_BYTES, range_rows=INDEX_ROWS):
    """Rows (vec_id, rank, neighbour_id, distance): for each id divisible by ``every`` its k nearest others of all rows by Euclidean
    distance, ties by the smaller id.

    A vector isn't its own neighbour; of rows that repeat an id the first of their vectors, in their order, counts. Rows with a null
    id, a null or empty vector, a null, infinite or NaN component, or another length than most rows have (the shorter on a tie) are left
    out. With fewer than k others there are fewer rows; one vector or none gives an empty result. Other columns are neither read nor
    returned. Distances are rounded to 6 digits after ranking. Ids are whole numbers; TypeError if the column isn't.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a column of whole numbers")
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    v = v.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    dim, rows = sizes["n"], sizes["count"]
    # 0.0 and -0.0 are one number
    v = v.where(F.size("v") == dim).select("id", F.transform("v", lambda x: x + F.lit(0.0).cast("float" if "float" in df.schema[vec_col].dataType.simpleString() else "double")).alias("v"))
    v = written(v.groupBy("id").agg(F.min("v").alias("v")))
    # of equal vectors no query needs more than the k + 1 smallest ids: its k nearest and itself
    few = v.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("k") <= k + 1)
    distinct = written(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0]))
    count = min(MAX_PIVOTS, max(1, -(-rows // cell_rows)))
    sample = distinct.withColumn("h", F.xxhash64("vid")).orderBy("h", "vid").limit(count * SAMPLE_PER_PIVOT).select("v").toArrow()["v"]
    pivots = fit_pivots(matrix(sample, dim), count)
    shared = spark.sparkContext.broadcast(pivots)

    @F.arrow_udf(KEY)
    def key(column: pa.Array) -> pa.Array:
        p, m = shared.value, matrix(column, dim)
        own = np.concatenate([squares(m[a : a + 4096], p).argmin(axis=1) for a in range(0, len(m), 4096)] or [np.zeros(0, np.int64)])
        d = np.sqrt(((m - p[own]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(own.astype(np.int32)), pa.array(d)], names=["cell", "dist"])

    keyed = distinct.select("vid", "v", key("v").alias("k")).select("vid", "v", "k.cell", "k.dist")
    index = written(in_ranges(keyed, ["cell", "dist", "vid"], rows, range_rows).drop("p"))
    several = distinct.where(F.size("ids") > 1).select("vid", "ids")

    asked = v.where(F.col("id") % every == 0)
    queries = asked.groupBy("v").agg(F.min("id").alias("qid"))
    number = queries.count()
    blocks = max(1, -(-number * dim * 8 // block_bytes))
    mine = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block")
    queries, asked = written(queries.select("*", mine)), written(asked.select("*", mine))
    found = [_block(queries.where(F.col("block") == b), asked.where(F.col("block") == b), index, several, pivots, dim, k) for b in range(blocks)]
    none = spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    return reduce(lambda a, b: a.unionByName(b), [x for x in found if x is not None] or [none])


def _block(queries, asked, index, several, pivots, dim, k):
    spark = index.sparkSession
    t = queries.select("qid", "v").toArrow().sort_by("qid")  # bounded in bytes
    if not t.num_rows:
        return None
    q, qid = matrix(t["v"], dim), t["qid"].to_numpy()
    own = np.concatenate([squares(q[a : a + 4096], pivots).argmin(axis=1) for a in range(0, len(q), 4096)])
    block = {"q": q, "own": own, "near": np.sqrt(((q - pivots[own]) ** 2).sum(axis=1)), "pivots": pivots, "bound": np.full(len(q), np.inf)}
    least = Window.partitionBy("q").orderBy("d", "vid")

    def nearest(bound, own_only):
        shared = spark.sparkContext.broadcast(block | {"bound": bound})
        found = index.mapInArrow(searcher(shared, dim, k + 1, own_only), FOUND)
        return found.withColumn("k", F.row_number().over(least)).where(F.col("k") <= k + 1)

    bound = np.full(len(q), np.inf)
    reach = nearest(bound, True).where(F.col("k") == k + 1).select("q", "d").toArrow()
    bound[reach["q"].to_numpy()] = reach["d"].to_numpy()
    found = nearest(bound, False).join(several, "vid", "left")
    each = found.select("q", "d", F.explode(F.coalesce("ids", F.array("vid"))).alias("nid"))
    near = F.slice(F.sort_array(F.collect_list(F.struct("d", "nid"))), 1, k + 1)  # of at most (k + 1) x (k + 1)
    named = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(qid), dtype=np.int32)), "qid": pa.array(qid)}))
    lists = each.groupBy("q").agg(near.alias("near")).join(named, "q")
    # both sides of a block's queries are bounded, so a vector that very many rows ask for needs no shuffle of these rows
    rows = asked.join(F.broadcast(queries.select("v", "qid")), "v").join(F.broadcast(lists.select("qid", "near")), "qid")
    others = F.slice(F.filter("near", lambda x: x["nid"] != F.col("id")), 1, k)
    rows = rows.select(F.col("id").alias("vec_id"), F.posexplode(others).alias("i", "n"))
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("n.nid").alias("neighbour_id"), F.round("n.d", 6).alias("distance"))


def top_k_sql(k=K, every=EVERY):
    return f"""
with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
p as (select a.vec_id, b.vec_id as neighbour_id, list_distance(a.e, b.e) as d from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0)
select vec_id, rank::integer as rank, neighbour_id, round(d, 6) as distance
from (select *, row_number() over (partition by vec_id order by d, neighbour_id) as rank from p) where rank <= {k}"""
