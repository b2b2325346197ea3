"""Cuts of lineage that survive the loss of executors: tables in the folder that all of them share."""

import sys
import tempfile
import uuid


def shared_folder(spark):
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode; elsewhere ValueError, as no other would be shared."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    kept = sys.__dict__.setdefault("_asofloom_scratch", {})
    if "folder" not in kept:
        kept["folder"] = tempfile.mkdtemp(prefix="asofloom-")
    return kept["folder"]


def _path(spark, name):
    """(Hadoop file system, path) of a place in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df, instead=None):
    """``df`` as a Parquet table in the shared folder: computed once, and read from there on.

    ``instead``: an earlier result that nothing else needs any more; it is deleted. What is left goes when the application ends.
    """
    spark = df.sparkSession
    run = f"{shared_folder(spark)}/asofloom-{spark.sparkContext.applicationId}"
    at = f"{run}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    fs, path = _path(spark, run)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    discard(instead)
    return out


def discard(df):
    """Deletes the table behind a result of written(); anything else is left alone."""
    at = getattr(df, "_written_at", None)
    if at:
        fs, path = _path(df.sparkSession, at)
        fs.delete(path, True)
