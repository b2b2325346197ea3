"""Operator 2: contiguous shards of balanced bytes from a global prefix sum.

Rows are put in ranges of the order and sorted there; each range adds up its own rows, and the totals of the ranges, of which there is one
for every few million rows, give what comes before each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

#: Rows of a range that their number aims at; there are at least as many ranges as shuffle partitions. Neither changes the result.
RANGE_ROWS = 1 << 22


def in_ranges(df, order, rows, range_rows=RANGE_ROWS):
    """``df`` in ranges of the columns ``order``, nulls first, sorted, with the range's number ``p``.

    Rows that are alike in all of ``order`` may be told apart by nothing; a salt spreads them over several ranges, so none gets too long.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // range_rows))
    salted = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    columns = [*(F.col(c).asc_nulls_first() for c in order), F.col("__salt")]
    return salted.repartitionByRange(ranges, *columns).sortWithinPartitions(*columns).drop("__salt").withColumn("p", F.spark_partition_id())


def shards(df, n_shards=64, id_col="doc_id", text_col="text", range_rows=RANGE_ROWS):
    """Rows (doc_id, n_bytes, start_byte, shard), one for each input row, in shards that are contiguous by doc_id.

    start_byte is the number of bytes before the row in the order of (doc_id, n_bytes), null ids first; shard is
    floor(start_byte * n_shards / total), so cuts fall at equal targets. A null or empty text has 0 bytes. Rows that repeat an id are
    neighbours. If all bytes are 0, everything is in shard 0. An empty table gives an empty result. Other columns are neither read nor
    returned. Only ids and lengths are shuffled; the totals of the ranges are the only thing that the driver sees.
    """
    spark = df.sparkSession
    sized = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))

    def running(batches):
        total = 0
        for b in batches:
            n = b.column("n_bytes").to_numpy()
            if len(n):
                ends = total + np.cumsum(n)
                total = int(ends[-1])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(ends - n), b.column("p")], names=["doc_id", "n_bytes", "start", "p"])

    kind = T.StructType([sized.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("start", T.LongType()), ("p", T.IntegerType())))])
    # written, as ranges are drawn by a sample and may differ the next time
    local = written(in_ranges(sized, ["doc_id", "n_bytes"], df.count(), range_rows).mapInArrow(running, kind))
    totals = local.groupBy("p").agg(F.max(F.col("start") + F.col("n_bytes")).alias("s")).toArrow().sort_by("p")
    ends = np.cumsum(totals["s"].to_numpy().astype(np.int64))
    run = int(ends[-1]) if len(ends) else 0
    base = spark.createDataFrame(pa.table({"p": totals["p"], "base": pa.array(ends - totals["s"].to_numpy(), pa.int64())}))
    placed = local.join(base, "p").select("doc_id", "n_bytes", (F.col("base") + F.col("start")).alias("start_byte"))
    cut = F.lit(0) if run == 0 else F.expr(f"cast(start_byte as decimal(38,0)) * {n_shards} div cast({run} as decimal(38,0))")
    return placed.select("doc_id", "n_bytes", "start_byte", F.least(F.lit(n_shards - 1), cut.cast("int")).cast("int").alias("shard"))


def shards_sql(n_shards=64):
    return f"""
with sized as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes from documents),
placed as (select doc_id, n_bytes, (sum(n_bytes) over (order by doc_id nulls first, n_bytes rows unbounded preceding) - n_bytes)::bigint as start_byte,
  sum(n_bytes) over () as total from sized)
select doc_id, n_bytes, start_byte,
  case when total = 0 then 0 else least({n_shards - 1}, (start_byte::hugeint * {n_shards}) // total::hugeint) end::integer as shard
from placed"""
