"""Vectorised tokenisation of Arrow text batches, and deterministic samples of labelled rows."""

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: What isn't a letter or digit, for Arrow's regular expressions.
NOT_WORD = r"[^\pL\pN]+"

#: Bytes of text that one vectorised step works on; longer texts form a step of their own.
STEP_BYTES = 1 << 20


def trim():
    """Gives freed memory back to the system, where the C library can: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def worker_cache(key):
    """A dictionary that outlives one task of a reused Python worker."""
    return sys.__dict__.setdefault("_asofloom_cache", {}).setdefault(key, {})


def byte_slices(texts, limit=STEP_BYTES):
    """Consecutive (start, stop) row ranges of about equal bytes, each of at most ``limit`` bytes or of one row."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, n = 0, len(size)
    total = np.concatenate([[0], np.cumsum(size)])
    while start < n:
        stop = int(np.searchsorted(total, total[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop
    if n:
        trim()


def raw_tokens(texts):
    """Whitespace tokens of a text array: codes, row offsets, distinct tokens as an Arrow array. Null counts as empty."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0], coded.dictionary


def bare(tokens):
    """An array of tokens in lower case without anything but letters and digits."""
    low = pc.utf8_lower(tokens)
    odd = pc.invert(pc.utf8_is_alnum(low))
    return pc.replace_with_mask(low, odd, pc.replace_substring_regex(low.filter(odd), NOT_WORD, "")) if pc.any(odd).as_py() else low


def words(texts):
    """Words of a text array: codes, row offsets, distinct words as an Arrow array. Tokens without letter or digit are dropped.

    Code 0 is the empty word, which no row has.
    """
    codes, offsets, raw = raw_tokens(texts)
    coded = bare(raw).dictionary_encode()
    nothing = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    remap = np.where(nothing, 0, np.arange(1, len(nothing) + 1))[coded.indices.to_numpy(zero_copy_only=False)]
    codes = remap[codes] if len(codes) else np.zeros(0, np.int64)
    keep = codes > 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[offsets], pa.concat_arrays([pa.array([""], coded.dictionary.type), coded.dictionary])


def segment_sum(values, offsets):
    """Sums of rows of ``values`` between consecutive offsets; 0 for empty segments."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


#: Strata (combinations of labels) that a sample is drawn from, the most frequent ones, and bytes of text that it has at most.
MAX_STRATA, SAMPLE_BYTES = 256, 128 << 20
#: Hashes of ids are compared in this many bits.
HASH_BITS = 53


def hashed(column):
    return F.shiftrightunsigned(F.xxhash64(column), 64 - HASH_BITS)


def thresholds(counts, want):
    """{label: hash below which about twice ``want`` of its rows lie}; labels of few rows are taken whole."""
    return {k: (1 << HASH_BITS) if n <= 2 * want else int((2 * want + 64) / (n + 64) * (1 << HASH_BITS)) for k, n in counts.items()}


def below(label, cuts):
    """Whether the hash ``h`` of a row is below the threshold of its label."""
    found = F.lit(0).cast("long")
    for k, cut in cuts.items():
        found = F.when(label == F.lit(k), F.lit(cut)).otherwise(found)
    return F.col("h") < found


def frequent(df, label, most):
    rows = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col(label).isNotNull()).orderBy(F.desc("n"), label).limit(most).collect()
    return {r[0]: r[1] for r in rows}


def labelled_sample(docs, id_col, text_col, per_stratum, own=None, labels=None, contradiction=F.max, max_strata=MAX_STRATA, max_bytes=SAMPLE_BYTES):
    """At most ``per_stratum`` documents of each stratum, those of the smallest hash of the id: the same whatever the partitioning.

    The strata are the values of the column ``own`` of ``docs``, of a table ``labels`` (i, y), or both; they need not have so many documents.
    Rows with a null id, text or label are left out. Labels of one id that differ are made one by ``contradiction``; of rows that repeat an
    id the least own label and the least text count. Only the ``max_strata`` most frequent values of ``own`` have strata. Texts are taken in
    the order of their hashes until ``max_bytes`` are reached.

    Thresholds of the hash come from the counts of labels, so a map-side filter leaves about twice the sample before anything is shuffled.
    With ``labels`` the first filter leaves for each y about as many as all strata of a y may have. Returns (text, label...) rows.
    """
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *([F.col(own).alias("l")] if own else [])).where("i is not null").withColumn("h", hashed("i"))
    strata = frequent(base, "l", max_strata) if own else {}
    keys = [*(["l"] if own else []), *(["y"] if labels is not None else [])]
    if labels is not None:
        known = labels.where("i is not null and y is not null").withColumn("h", hashed("i"))
        want = per_stratum * max(1, len(strata)) * (4 if own else 1)
        cuts = thresholds(frequent(known, "y", max_strata), want)
        if not cuts:
            return []
        # all labels of an id, or none, reach the grouping that makes them one
        known = known.where(F.col("h") < max(cuts.values())).groupBy("i").agg(contradiction("y").alias("y"), F.first("h").alias("h")).where(below(F.col("y"), cuts))
        top = Window.partitionBy("y").orderBy("h", "i")
        known = known.withColumn("k", F.row_number().over(top)).where(F.col("k") <= 2 * want).select("i", "y")
        rows = base.drop("t").join(F.broadcast(known), "i")
    else:
        rows = base.drop("t").where(below(F.col("l"), thresholds(strata, per_stratum)))
    least = rows.groupBy("i").agg(*(F.min(c).alias(c) for c in keys), F.first("h").alias("h")).na.drop()
    if own:
        least = least.where(F.col("l").isin(list(strata)))
    chosen = least.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "i"))).where(F.col("k") <= per_stratum).drop("k")
    there = base.drop("h").where("t is not null")
    texts = there.join(F.broadcast(chosen), ["i", *(["l"] if own else [])]).groupBy("i", *keys, "h").agg(F.min("t").alias("t"))
    texts = written(texts)  # bounded in rows; now in bytes, before anything reaches the driver
    run = F.sum(F.octet_length("t")).over(Window.orderBy("h", "i").rowsBetween(Window.unboundedPreceding, 0))
    within = texts.select("i", "h", run.alias("run")).where(F.col("run") <= max_bytes).select("i")
    got = texts.join(F.broadcast(within), "i").toArrow().sort_by("i")
    out = list(zip(*[got.column(c).to_pylist() for c in ("t", *keys)], strict=True))
    del got
    trim()
    return out


def struct_array(columns):
    """A StructArray from a dictionary of arrays."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))
