"""An extension: the matrix of each as-of date once the watermark of an event stream has passed it.

Events are appended to a table; a date whose end lies before the latest event time, less the allowed delay, is closed: its matrix is computed
from the table and written under its date. Events that come later than that don't change it, as they weren't known.
"""

from pyspark.sql import functions as F

from ..boundary import AS_OF, q
from ..loom import Loom


def matrix_stream(stream, ts, dates, config, event_table, events_path, output_path, checkpoint, delay="interval 0 seconds", tables=None, folder=None):
    """A DataStreamWriter that appends each batch to ``events_path`` and writes closed dates to ``output_path/as_of_date=...``.

    stream: the streaming DataFrame of the configuration's table ``event_table``; ts: its event time. A batch that is repeated after a
    failure replaces its own part, so events aren't counted twice.
    """
    dates = sorted(str(d) for d in dates)

    def batch(df, number):
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        seen = spark.read.parquet(events_path)
        closed = seen.agg(F.expr(f"max({ts}) - {delay}").cast("timestamp_ntz").alias("t")).first()["t"]
        for d in dates:
            at = f"{output_path}/{AS_OF}={d}"
            if closed is None or str(closed)[:10] <= d or _written(spark, at):
                continue
            f = Loom(config, spark, [d], {event_table: seen.drop("batch")} | (tables or {}), folder)
            f.to_spark().drop(AS_OF).write.mode("overwrite").parquet(at)

    return stream.where(q(ts).isNotNull()).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _written(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
