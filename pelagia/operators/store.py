"""Tables between steps: written where driver and executors share a folder, so that lost executors lose no work."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

POINTER = "current.json"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one, but only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        before = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = before.get() if before.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pelagia-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Written in buckets by a key, so that what meets or is grouped by it (see local_joins) is not moved again.

    Rows stay in their tasks: df is to be dealt by the key already (repartition(buckets, key)), else files are many.
    """
    spark, table = df.sparkSession, f"pelagia_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", shared_dir(spark, name)).option("compression", "zstd").saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: its files stay
    return out


@contextmanager
def local_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that run meanwhile move nothing where one of their keys deals both sides alike.

    None is sent whole through the driver, however small its files are: compressed rows take many times that in memory.
    """
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def write_version(table: DataFrame, folder: str, version: int) -> DataFrame:
    """table written as a version of its own and read back; older versions stay readable."""
    path = f"{folder.rstrip('/')}/v{version:09d}"
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def commit(spark: SparkSession, folder: str, version: int) -> None:
    """Makes a written version the one that readers get, by one rename of a pointer."""
    jvm, root = spark._jvm, folder.rstrip("/")
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    out = fresh.getFileSystem(spark._jsc.hadoopConfiguration()).create(fresh, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, pointer, how)


def committed(spark: SparkSession, folder: str) -> tuple[int, DataFrame] | None:
    """The version that was last committed and its table, or None."""
    root = folder.rstrip("/")
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    version = json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0])["version"]
    return version, spark.read.parquet(f"{root}/v{version:09d}")
