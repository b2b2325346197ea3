"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the runs of NGRAM words of the benchmark items (shorter items, down to a single word: the whole item). In scripts that are
written without spaces each character is a word. With m the shortest pattern's bytes, the shift table holds, for a hashed block of BLOCK
bytes, how far a window of m bytes that ends in the block may safely move. Where the shift is 0 the block's bucket names the patterns to
try: first their leading bytes, then the whole pattern is compared. The batch's bytes are scanned in many lanes at once, each lane skipping
by its own shifts. Patterns of less than LONG bytes have a table of their own, so that they don't shorten the others' shifts; those of less
than BLOCK bytes are compared with the bytes after each space.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .words import byte_slices

NGRAM = 8
#: Words that an item needs to be searched at all: every item that has a word is.
MIN_WORDS = 1
BLOCK = 8
#: Bytes from which patterns are searched together.
LONG = 32
TABLE_BITS = 18
LANE = 192
#: Bytes of patterns searched in one pass over the documents; a larger benchmark takes several passes.
PASS_BYTES = 64 << 20

HITS = "array<struct<item_id:bigint,hits:bigint>>"


#: A character of a script without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han. Ranges, as properties of scripts are slow.
UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3041-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA9E0-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\uFF66-\uFF9F\x{1AFF0}-\x{1B16F}\x{20000}-\x{3FFFF}])"


def normal(column):
    """Lower case, with every run of other than letters and digits as one space, and a space at either end and around unspaced characters."""
    low = F.lower(column)
    # where each character is one byte there are none to set apart
    apart = F.when(F.length(low) == F.octet_length(low), low).otherwise(F.regexp_replace(low, UNSPACED, " $1 "))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


class Matcher:
    def __init__(self, patterns):
        """patterns: {bytes: sorted item ids}; each at least BLOCK bytes long."""
        self.patterns = sorted(patterns)
        self.items = [patterns[p] for p in self.patterns]
        self.m = m = min(map(len, self.patterns))
        every = np.frombuffer(b"".join(p[:m] for p in self.patterns), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << TABLE_BITS, m - BLOCK + 1, np.uint32)
        for end in range(BLOCK, m + 1):
            h = self.hash(np.ascontiguousarray(every[:, end - BLOCK : end]).view("<u8").ravel())
            np.minimum.at(self.shift, h, np.uint32(m - end))
        self.head = np.ascontiguousarray(every[:, :BLOCK]).view("<u8").ravel()
        tail = self.hash(np.ascontiguousarray(every[:, m - BLOCK :]).view("<u8").ravel())
        self.order = np.argsort(tail, kind="stable")
        self.first = np.searchsorted(tail[self.order], np.arange((1 << TABLE_BITS) + 1))

    @staticmethod
    def hash(block):
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, text):
        """(start, pattern) of all occurrences in a bytes object."""
        m, n = self.m, len(text)
        if n < m:
            return []
        block = np.ndarray(n - BLOCK + 1, "<u8", text, strides=(1,))
        start = np.arange(0, n - m + 1, LANE)
        stop = np.minimum(start + LANE, n - m + 1)
        tries = []
        while len(start):
            h = self.hash(block[start + (m - BLOCK)])
            s = self.shift[h]
            zero = s == 0
            if zero.any():
                tries.append((start[zero], h[zero]))
            start = start + np.maximum(s, 1)
            on = start < stop
            start, stop = start[on], stop[on]
        if not tries:
            return []
        at, h = (np.concatenate(x) for x in zip(*tries, strict=True))
        size = self.first[h + 1] - self.first[h]
        at, base = np.repeat(at, size), np.repeat(self.first[h], size)
        pattern = self.order[base + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)]
        same = block[at] == self.head[pattern]
        return [(a, p) for a, p in zip(at[same].tolist(), pattern[same].tolist(), strict=True) if text.startswith(self.patterns[p], a)]


class ShortMatcher:
    def __init__(self, patterns):
        """patterns: {bytes: sorted item ids}; each less than BLOCK bytes long, with a space in front."""
        self.patterns = sorted(patterns)
        self.items = [patterns[p] for p in self.patterns]
        self.keys = {}
        for size in sorted({len(p) for p in self.patterns}):
            own = [(int.from_bytes(p, "little"), k) for k, p in enumerate(self.patterns) if len(p) == size]
            self.keys[size] = [np.array(x, kind) for x, kind in zip(zip(*sorted(own), strict=True), (np.uint64, np.int64), strict=True)]

    def find(self, text):
        """(start, pattern) of all occurrences in a bytes object."""
        block = np.ndarray(len(text), "<u8", text + bytes(BLOCK), strides=(1,))
        at = np.flatnonzero(np.frombuffer(text, np.uint8) == ord(" "))
        block, out = block[at], []
        for size, (keys, pattern) in self.keys.items():
            head = block & np.uint64((1 << 8 * size) - 1)
            k = np.minimum(np.searchsorted(keys, head), len(keys) - 1)
            same = keys[k] == head
            out += zip(at[same].tolist(), pattern[k[same]].tolist(), strict=True)
        return out


def matchers(patterns):
    """Matchers for the short, the middle and the long patterns, as far as there are any."""
    parts = [{}, {}, {}]
    for p, items in patterns.items():
        parts[(len(p) >= BLOCK) + (len(p) >= LONG)][p] = items
    return [kind(part) for kind, part in zip((ShortMatcher, Matcher, Matcher), parts, strict=True) if part]


def patterns_of(items, ngram=NGRAM, min_words=MIN_WORDS):
    """{pattern: item ids} of (item_id, normal text) rows."""
    out = defaultdict(set)
    for item, text in items:
        w = text.split()
        if len(w) >= min_words:
            for k in range(max(1, len(w) - ngram + 1)):
                out[f" {' '.join(w[k : k + ngram])} ".encode()].add(item)
    return {p: sorted(i) for p, i in out.items()}


def searcher(spark, patterns):
    """An Arrow function from normal text to the items found, with the number of places where a run of the item's words starts."""
    shared = spark.sparkContext.broadcast(patterns)

    @F.arrow_udf(HITS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        every = matchers(shared.value)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("hits", pa.int64())]))
        for texts in batches:
            found = [[] for _ in range(len(texts))]
            for a, b in byte_slices(texts) if every else ():
                parts = [x.encode() if x else b"" for x in texts.slice(a, b - a).to_pylist()]
                ends = np.cumsum([len(x) + 1 for x in parts])
                counts = defaultdict(lambda: defaultdict(int))
                joined = b"\n".join(parts)
                for matcher in every:
                    hits = matcher.find(joined)
                    for row, (_, p) in zip(np.searchsorted(ends, [h[0] for h in hits], side="right").tolist(), hits, strict=True):
                        for item in matcher.items[p]:
                            counts[row][item] += 1
                for row, own in counts.items():
                    found[a + row] = [{"item_id": i, "hits": n} for i, n in sorted(own.items())]
            yield pa.array(found, kind)

    return search


def passes(benchmark, item_col="item_id", text_col="text", ngram=NGRAM, min_words=MIN_WORDS, limit=PASS_BYTES):
    """Pattern dictionaries of the items, each of about ``limit`` bytes at most; an item is searched in one pass as a whole.

    The items' bytes are added up before any reaches the driver, which then holds one part at a time. Parts are drawn by a hash of the id.
    """
    if not isinstance(benchmark.schema[item_col].dataType, T.IntegralType):
        raise TypeError(f"{item_col} must be a column of whole numbers")
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), normal(F.col(text_col)).alias("t")).na.drop()
    own = F.octet_length("t") * F.least(F.lit(ngram), F.size(F.split("t", " ")))
    total, rows = items.agg(F.coalesce(F.sum(own), F.lit(0)), F.count("*")).first()
    parts = 1
    if total > limit:
        items, parts = written(items), min(rows, -(-2 * total // limit))
    for part in range(parts):
        rows = (items if parts == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part)).distinct().toArrow()
        patterns = patterns_of(zip(rows["i"].to_pylist(), rows["t"].to_pylist(), strict=True), ngram, min_words)
        if patterns:
            yield patterns


def contamination(df, benchmark, ngram=NGRAM, min_words=MIN_WORDS, id_col="doc_id", text_col="text", pass_bytes=PASS_BYTES):
    """Rows (doc_id, item_id, hits): the items that documents hold a run of ``ngram`` words of, and at how many places such runs start.

    Of an item of fewer words the whole is sought, also if it is a single word; items of fewer than ``min_words`` are not, by default there
    are none. Case, punctuation and white space don't matter. Null and empty texts, null ids of items, and items without words match
    nothing. Rows that repeat a document's id count each for itself; rows that repeat an item's id are one item with all their runs, and a
    run that several items share counts for each. A null doc_id is kept. An empty table on either side gives an empty result. Documents'
    other columns are neither read nor returned. Whole texts are searched, however long. TypeError if item ids aren't whole numbers.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), normal(F.col(text_col)).alias("t"))
    found = None
    for part in passes(benchmark, ngram=ngram, min_words=min_words, limit=pass_bytes):
        one = docs.select("doc_id", searcher(spark, part)(F.col("t")).alias("h")).select("doc_id", F.inline("h"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("hits")).where("false")
    return found


def decontaminate(df, benchmark, ngram=NGRAM, min_words=MIN_WORDS, text_col="text", pass_bytes=PASS_BYTES):
    """``df``, all columns, without the rows whose text holds a run of ``ngram`` words of an item, or a shorter item as a whole.

    Rows with a null or empty text stay, rows that repeat an id or a text are judged each for itself. With an empty benchmark everything
    stays. Items are those of contamination().
    """
    for part in passes(benchmark, ngram=ngram, min_words=min_words, limit=pass_bytes):
        df = df.where(F.size(searcher(df.sparkSession, part)(normal(F.coalesce(F.col(text_col), F.lit(""))))) == 0)
    return df


def contamination_sql(ngram=NGRAM):
    """For benchmarks whose items all have at least ``ngram`` words."""
    normal_sql = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"
    gram = f"unnest(list_transform(range(1, len(w) - {ngram - 2}), lambda k: array_to_string(w[k:k + {ngram - 1}], ' ')))"
    return f"""
with d as (select doc_id, {gram} as g from (select doc_id, string_split({normal_sql}, ' ') as w from documents)),
b as (select distinct item_id, {gram} as g from (select item_id, string_split({normal_sql}, ' ') as w from benchmark))
select doc_id, item_id, count(*) as hits from d join b using (g) group by doc_id, item_id"""
