"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset, as in local tests, a
    temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            root = set_before.get()
        else:
            root = "file://" + tempfile.mkdtemp(prefix="pelagia-")
            spark.sparkContext.setCheckpointDir(root)
            root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: later plans start from those files.

    Where it replaces an older written table that nothing else reads any more, that one's files are removed.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if replaces is not None:
        remove(df.sparkSession, replaces.scratch_path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor
