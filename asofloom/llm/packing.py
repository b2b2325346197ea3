"""Operator 4: packing of documents into windows by non-negative least squares over a histogram of lengths.

Lengths are rounded up to a grid. All combinations of at most DEPTH lengths that fill a window exactly are the columns of a matrix; their
repeat counts are fitted to the histogram by non-negative least squares, rounded down, and what is left over is packed greedily, largest
first. All of it works on the histogram, whose size doesn't depend on the data; documents then take their slots by rank.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .sharding import RANGE_ROWS, in_ranges

#: Tokens of a window, and steps of the length grid in it.
WINDOW, GRID = 2048, 128
DEPTH = 3
BYTES_PER_TOKEN = 4


def combinations(grid, depth):
    """All non-increasing tuples of at most ``depth`` positive sizes that add up to ``grid``."""

    def grow(rest, most, left):
        if rest == 0:
            yield ()
        elif left:
            for x in range(min(rest, most), (rest + left - 1) // left - 1, -1):
                for tail in grow(rest - x, x, left - 1):
                    yield (x, *tail)

    return list(grow(grid, grid, depth))


def nnls(a, b, steps=2000):
    """The x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson on the normal equations."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(steps):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-9 * scale:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if (s > 1e-12 * scale).all():
                x[:] = 0
                x[p] = s
                break
            low = s <= 1e-12 * scale
            alpha = min(1.0, float((x[p][low] / np.maximum(x[p][low] - s[low], 1e-300)).min()))
            x[p] += alpha * (s - x[p])
            drop = p[low & (x[p] <= 1e-12 * scale)]
            if not len(drop):
                drop = p[low][:1]
            x[drop] = 0
            passive[drop] = False
            if not passive.any():
                break
    return x


def greedy(counts, grid):
    """Patterns with repeat counts for a histogram, largest size first, each filled up with the largest that fit."""
    counts, out = counts.copy(), []
    for top in range(grid, 0, -1):
        while counts[top]:
            used, room = {top: 1}, grid - top
            size = min(room, grid)
            while room and size:
                size = min(size, room)
                fit = min(room // size, int(counts[size]) - used.get(size, 0))
                if fit > 0:
                    used[size] = used.get(size, 0) + fit
                    room -= fit * size
                size -= 1
            times = min(int(counts[s]) // k for s, k in used.items())
            for s, k in used.items():
                counts[s] -= times * k
            out.append((tuple(s for s, k in sorted(used.items(), reverse=True) for _ in range(k)), times))
    return out


def recipe(histogram, grid=GRID, depth=DEPTH):
    """Patterns (sizes, times) that use up a histogram: histogram[s] pieces of size s, s from 1 to grid."""
    left = np.array(histogram, np.int64)
    columns = combinations(grid, depth)
    a = np.zeros((grid + 1, len(columns)))
    for j, sizes in enumerate(columns):
        for s in sizes:
            a[s, j] += 1
    total = max(1, left.sum())
    x = nnls(a, left / total) * total
    out = []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        need = {s: columns[j].count(s) for s in columns[j]}
        times = min(int(x[j]), *(int(left[s]) // k for s, k in need.items()))
        if times:
            for s, k in need.items():
                left[s] -= times * k
            out.append((columns[j], times))
    return out + greedy(left, grid)


def slots(patterns):
    """Rows (size, from rank, to rank, first pack, slot): which ranks of a size go to which run of packs."""
    rows, rank, pack = [], {}, 0
    for sizes, times in patterns:
        for slot, s in enumerate(sizes):
            a = rank.get(s, 0)
            rows.append((s, a, a + times, pack, slot))
            rank[s] = a + times
        pack += times
    return rows


def pack(df, window=WINDOW, grid=GRID, depth=DEPTH, id_col="doc_id", text_col="text", length=None, range_rows=RANGE_ROWS):
    """Rows (doc_id, start, length, pack_id, slot): pieces of documents and the windows that they go to.

    ``length`` is a Column with a document's tokens; by default its UTF-8 bytes over BYTES_PER_TOKEN, rounded up. A document longer than
    the window is cut into whole windows and a rest, ``start`` being a piece's first token. Every token is in one piece, each piece in one
    pack, and no pack holds more than the window. Null and empty texts have no pieces. Rows that repeat an id are packed each for itself;
    a null id is kept. An empty table gives an empty result. Other columns are neither read nor returned. Pieces of a size are placed in
    the order of (doc_id, start, length), null ids first, so the result doesn't depend on the partitioning.
    """
    if window % grid:
        raise ValueError("the window must be a multiple of the grid")
    spark = df.sparkSession
    tokens = F.ceil(F.octet_length(F.col(text_col)) / BYTES_PER_TOKEN) if length is None else length
    # written once, before the filter, as that would count all tokens a second time
    sized = written(df.select(F.col(id_col).alias("doc_id"), tokens.cast("long").alias("n"))).where("n > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(window).cast("long")))
    cut = sized.select("doc_id", "n", starts.alias("start")).select("doc_id", "start", F.least(F.lit(window), F.col("n") - F.col("start")).cast("long").alias("length"))
    cut = cut.withColumn("size", F.ceil(F.col("length") * grid / window).cast("int"))

    def ranks(batches):
        seen = np.zeros(grid + 1, np.int64)
        for b in batches:
            size = b.column("size").to_numpy()
            order = np.argsort(size, kind="stable")
            first = np.searchsorted(size[order], np.arange(grid + 2))
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first[size[order]] + seen[size[order]]
            seen += np.diff(first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], names=[*b.schema.names, "rank"])

    pieces = int(sized.agg(F.coalesce(F.sum(F.ceil(F.col("n") / window)), F.lit(0))).first()[0])
    ranged = in_ranges(cut, ["doc_id", "start", "length"], pieces, range_rows)
    local = written(ranged.mapInArrow(ranks, T.StructType([*ranged.schema.fields, T.StructField("rank", T.LongType())])))
    counts = written(local.groupBy("p", "size").agg(F.count("*").alias("n")))
    histogram = np.zeros(grid + 1, np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most grid rows
        histogram[r["size"]] = r["n"]
    before = F.sum("n").over(Window.partitionBy("size").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("p", "size", F.coalesce(before, F.lit(0)).alias("base"))
    plan = spark.createDataFrame(slots(recipe(histogram, grid, depth)) if histogram.any() else [], "size int, lo long, hi long, pack long, slot int")
    ranked = local.join(base, ["p", "size"]).withColumn("rank", F.col("base") + F.col("rank"))
    # grid and depth bound the number of patterns, and with it this table
    placed = ranked.join(F.broadcast(plan), (ranked["size"] == plan["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "start", "length", (F.col("pack") + F.col("rank") - F.col("lo")).alias("pack_id"), "slot")
