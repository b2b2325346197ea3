"""Operator 9: near duplicates by SimHash and covering locality-sensitive hashing.

A document's signature has 128 bits: signs of the sums, over its distinct words, of random +-1 vectors weighted by the square root of the
word's count. Weights are whole sixteenths, so sums are exact and a signature doesn't depend on the batch that a document is in. Two documents are near duplicates if their signatures differ in at most RADIUS bits; groups are the connected components.

The search is exact for that radius. The bits are cut into blocks, whose radii r_i satisfy sum(r_i + 1) = RADIUS + 1, so of any pair
within the radius at least one block differs in at most r_i bits. In a block each bit i has a random vector m(i) of r_i + 1 bits, and for
each v other than 0 there is a table that keeps the bits with <m(i), v> = 1. The at most r_i vectors of the differing bits leave some v
orthogonal to all of them, so in that table the pair agrees on every kept bit and collides.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..boundary import q
from ..sources.scratch import written
from .words import byte_slices, words

BITS = 128
RADIUS = 15
#: Blocks that the bits may be cut into, and comparisons of signatures that cost as much as a row of a table.
BLOCKS, PAIRS_PER_ROW = (1, 2, 3), 100
#: Runs of equal keys up to this length are compared pair by pair at once; longer ones are searched breadth first.
SHORT_RUN = 12

SIGNATURE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def signatures(texts):
    """(has words, signatures as rows of two uint64) of a text array."""
    codes, offsets, vocabulary = words(texts)
    n = len(offsets) - 1
    out, there = np.zeros((n, 2), np.uint64), np.diff(offsets) > 0
    if not len(codes):
        return there, out
    size = len(vocabulary)
    key, count = np.unique(np.repeat(np.arange(n), np.diff(offsets)) * size + codes, return_counts=True)
    doc, word, weight = key // size, key % size, np.round(16 * np.sqrt(count)).astype(np.float32)
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, vocabulary.to_pylist())), np.uint8).reshape(size, 16)
    signs = np.unpackbits(digest, axis=1).view(np.int8) * np.int8(2) - np.int8(1)
    signs = signs.astype(np.float32)
    at = np.searchsorted(doc, np.arange(n + 1))
    bits = np.zeros((n, BITS), bool)
    for i in np.flatnonzero(there):
        s, e = at[i], at[i + 1]
        # single precision is exact below 2 ** 24
        exact = np.float32 if e - s < 1 << 16 and weight[s:e].sum(dtype=np.float64) < 1 << 24 else np.float64
        bits[i] = weight[s:e].astype(exact, copy=False) @ signs[word[s:e]].astype(exact, copy=False) > 0
    packed = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
    out[there] = packed[there]
    return there, out


def signer():
    """An Arrow function from a text column to a struct (a, b), null for texts without words."""

    @F.arrow_udf(SIGNATURE)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            a, b, mask = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
            for s, e in byte_slices(texts, 2 << 20):
                there, sig = signatures(texts.slice(s, e - s))
                a[s:e], b[s:e], mask[s:e] = sig[:, 0].view(np.int64), sig[:, 1].view(np.int64), ~there
            yield pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"], mask=pa.array(mask))

    return sign


def block_radii(radius, blocks):
    """The radius of each block, so that sum(r + 1) = radius + 1."""
    return [(radius + 1) // blocks + (k < (radius + 1) % blocks) - 1 for k in range(blocks)]


def best_blocks(nodes, radius=RADIUS, bits=BITS):
    """How many blocks find the pairs of so many signatures at the least cost: fewer ones have more tables, but longer keys and shorter runs.

    A block's keys have about half its bits, so the comparisons of one signature in a table grow with nodes / 2 ** (bits / blocks / 2).
    """
    cost = lambda b: sum((1 << (r + 1)) - 1 for r in block_radii(radius, b)) * (PAIRS_PER_ROW + nodes / 2 ** (bits / b / 2))
    return min((b for b in BLOCKS if b <= radius + 1), key=cost)


def covering_masks(bits=BITS, radius=RADIUS, blocks=3, seed=9):
    """The masks of all tables, each as a Python integer of ``bits`` bits."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(bits)
    masks = []
    for k in range(blocks):
        own = order[bits * k // blocks : bits * (k + 1) // blocks]
        r = block_radii(radius, blocks)[k]
        if r < 0:
            continue
        m = rng.integers(0, 1 << (r + 1), len(own))
        for v in range(1, 1 << (r + 1)):
            mask = sum(1 << int(i) for i, x in zip(own, m, strict=True) if bin(int(x) & v).count("1") % 2)
            # a table that keeps no bit at all would compare everything; it is only there if all m(i) are orthogonal to v
            masks.append(mask)
    return masks


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def keyed(nodes, masks, at_once=128):
    """Rows (key, node, a, b), one for each node and table. Generated code is kept short: nodes are read once for every ``at_once`` tables."""
    low = (1 << 64) - 1
    keys = [F.xxhash64(F.lit(i), F.col("a").bitwiseAND(F.lit(_signed(m >> 64))), F.col("b").bitwiseAND(F.lit(_signed(m & low)))) for i, m in enumerate(masks)]
    parts = [nodes.select("node", "a", "b", F.explode(F.array(*keys[i : i + at_once])).alias("key")) for i in range(0, len(keys), at_once)]
    return reduce(lambda x, y: x.unionByName(y), parts)


def near(a, b, i, j, radius):
    # as unsigned: the count of a signed number is that of its absolute value
    return np.bitwise_count((a[i] ^ a[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((b[i] ^ b[j]).view(np.uint64)) <= radius


def run_edges(node, a, b, radius):
    """Edges that connect what is within the radius in one run: breadth first, each found node compared with those not yet found."""
    left, edges = np.arange(len(node)), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            hit = near(a, b, i, left, radius)
            found = left[hit]
            left = left[~hit]
            edges += [(node[i], node[j]) for j in found]
            frontier += found.tolist()
    return edges


def edge_finder(radius):
    """An Arrow map over rows sorted by key: pairs (u, v) of nodes that share a key and are within the radius."""

    def edges_of(key, node, a, b):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        run = np.repeat(np.arange(len(start)), length)
        short = (length <= SHORT_RUN)[run]
        us, vs = [], []
        for s in range(1, min(SHORT_RUN, int(length.max(initial=1)))):
            i = np.flatnonzero((run[s:] == run[:-s]) & short[s:])
            if not len(i):
                break
            i = i[near(a, b, i, i + s, radius)]
            us.append(node[i])
            vs.append(node[i + s])
        for k in np.flatnonzero(length > SHORT_RUN):
            e = run_edges(*(x[start[k] : start[k] + length[k]] for x in (node, a, b)), radius)
            if e:
                x = np.array(e, np.int64)
                us.append(x[:, 0])
                vs.append(x[:, 1])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        return np.minimum(u, v), np.maximum(u, v)

    def emit(columns):
        u, v = edges_of(*columns)
        if len(u):
            both = np.unique(np.stack([u, v], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])
        return None

    def find(batches):
        kept, rows = [], 0
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "a", "b")]
            kept.append(columns)
            rows += len(columns[0])
            if rows < 200_000:
                continue
            joined = [np.concatenate(x) for x in zip(*kept, strict=True)]
            cut = int(np.searchsorted(joined[0], joined[0][-1]))  # the last run may go on
            out = emit([x[:cut] for x in joined]) if cut else None
            kept, rows = [[x[cut:].copy() for x in joined]], len(joined[0]) - cut
            if out:
                yield out
        if rows:
            out = emit([np.concatenate(x) for x in zip(*kept, strict=True)])
            if out:
                yield out

    return find


def components(edges):
    """Rows (node, root) of the connected components of edges (u, v): alternating large and small stars until nothing changes."""
    edges = written(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        w = Window.partitionBy("u")
        least = F.least(F.col("u"), F.min("v").over(w))
        large = both.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.select("u", "v", F.min("v").over(w).alias("m"))
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = written(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def document_signatures(df, id_col="doc_id", text_col="text"):
    """A written table (doc_id, a, b, n): one row for each id other than null, with its smallest signature and its number of rows."""
    s = df.select(F.col(id_col).alias("doc_id"), signer()(F.col(text_col)).alias("s")).where("doc_id is not null")
    return written(s.groupBy("doc_id").agg(F.min("s").alias("s"), F.count("*").alias("n")).select("doc_id", "s.a", "s.b", "n"))


def one_of_each(df, id_col="doc_id", text_col="text"):
    """One row of each id: that of the smallest signature, which stands for the id, or else of the least JSON form, whatever the partitioning."""
    order = F.struct(F.coalesce(signer()(F.col(text_col)), F.struct(F.lit(2**63 - 1).alias("a"), F.lit(2**63 - 1).alias("b"))), F.to_json(F.struct(*map(q, df.columns))))
    least = df.select(q(id_col).alias("__id"), F.struct(*map(q, df.columns)).alias("__row"), order.alias("__order")).groupBy("__id").agg(F.min_by("__row", "__order").alias("__row"))
    return least.select("__row.*")


def grouped(signed, radius=RADIUS, blocks=None):
    """Rows (doc_id, group_id) for document_signatures(): group_id is the smallest id of the document's group."""
    whole = signed.where("a is not null").groupBy("a", "b").agg(F.min("doc_id").alias("rep"))
    # equal signatures are one node, so a group of exact copies costs no more than one document
    nodes = written(whole.withColumn("node", F.monotonically_increasing_id()))
    masks = covering_masks(BITS, radius, blocks or best_blocks(nodes.count(), radius))
    rows = keyed(nodes.select("node", "a", "b"), masks).repartition("key").sortWithinPartitions("key")
    edges = rows.select("key", "node", "a", "b").mapInArrow(edge_finder(radius), "u long, v long")
    roots = components(edges)
    rep = nodes.select("node", "rep")
    joined = rep.join(roots, "node")
    tops = joined.select("root", "rep").union(rep.join(roots.select(F.col("root").alias("node")).distinct(), "node").select("node", "rep"))
    tops = tops.groupBy("root").agg(F.min("rep").alias("top"))
    top = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct()).join(tops, "root").select("node", "top")
    named = nodes.join(top, "node", "left").select("a", "b", F.coalesce("top", "rep").alias("g"))
    return signed.join(named, ["a", "b"], "left").select("doc_id", F.coalesce("g", "doc_id").alias("group_id"))


def near_duplicates(df, radius=RADIUS, blocks=None, id_col="doc_id", text_col="text"):
    """Rows (doc_id, group_id, keep), one for each distinct doc_id; keep is true for the smallest id of each group.

    Rows that repeat an id are one document, represented by the smallest of their signatures. Null ids have no row. A document without
    words (null, empty, only signs) is never grouped. Documents with equal signatures are always grouped. An empty table gives an empty
    result. ``blocks``, by default chosen from the number of signatures, changes the number of tables and the bits of a key (more documents:
    fewer blocks), never the result. Other columns are neither read nor returned.
    """
    g = grouped(document_signatures(df, id_col, text_col), radius, blocks)
    return g.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def deduplicate(df, radius=RADIUS, blocks=None, id_col="doc_id", text_col="text"):
    """``df``, all columns, with one document of each group, that of the smallest id.

    Rows with a null id stay, each of them. Of rows that repeat a kept id one stays: that of the smallest signature, by which the id was
    grouped; if several have it, or none has words, the one whose JSON form is least. So the result doesn't depend on the partitioning.
    """
    signed = document_signatures(df, id_col, text_col)
    g = grouped(signed, radius, blocks)
    dropped = written(g.where("doc_id <> group_id").select(F.col("doc_id").alias("__dropped")))
    kept = df.join(dropped, F.col(id_col) == F.col("__dropped"), "left_anti")  # broadcast or shuffled by the written table's size
    repeated = signed.where("n > 1").select(F.col("doc_id").alias("__repeated"))
    if repeated.isEmpty():
        return kept
    again = F.col(id_col) == F.col("__repeated")
    return kept.join(repeated, again, "left_anti").unionByName(one_of_each(kept.join(repeated, again, "left_semi"), id_col, text_col))
