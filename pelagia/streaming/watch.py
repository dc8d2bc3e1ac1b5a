"""Streams over arriving files: sessions, upserts by batch, deletions that can be undone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from pelagia.operators import store


def arriving(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def sessions(stream: DataFrame, key: str, stamp: str, gap: str, lateness: str) -> DataFrame:
    """Events of a key whose steps stay below the gap, with their number."""
    timed = stream.withColumn("event_time", F.col(stamp).cast("timestamp")).withWatermark("event_time", lateness)
    return timed.groupBy(key, F.session_window("event_time", gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(spark: SparkSession, result: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what has arrived and returns its last complete result."""
    out = store.shared_dir(spark, name)
    query = result.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", store.shared_dir(spark, f"{name}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


BUCKETS = 64


def upsert_batches(spark: SparkSession, stream: DataFrame, key: str, order: str, table: str, progress: str, buckets: int = BUCKETS) -> DataFrame:
    """The newest row of each key in a table that outlives the query: restarted with the same folders, it goes on.

    Rows lie in buckets by their key's hash. A batch rewrites only the buckets that it touches, first beside the
    table, then over them; doing a batch again gives the same rows.
    """
    schema = StructType([*stream.schema.fields, StructField("bucket", IntegerType())])
    of_key = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", of_key)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # buckets at most
        if not touched:
            return
        if exists(spark, table):
            rows = rows.unionByName(spark.read.schema(schema).parquet(table).where(F.col("bucket").isin(touched)))
        newest = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
        beside = f"{table.rstrip('/')}-batches/{number}"
        newest.write.mode("overwrite").parquet(beside)
        spark.read.schema(schema).parquet(beside).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    if not exists(spark, table):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(schema).parquet(table).drop("bucket")


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a table has been written there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def pending_deletes(requests: DataFrame, delay_ms: int = 5000, retention_ms: int = 60_000) -> DataFrame:
    """(id, action) once a deletion was not undone within the delay, or at once if it is told to be committed.

    requests are (id, action delete, undo or commit, seq): of a file's requests the one with the highest seq counts, in
    whatever order they arrive; commit ends a pending deletion without waiting. A batch is undone or committed by a request for each of
    its files. What was decided is remembered for retention_ms, so that a late older request changes nothing, and
    then freed.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        deleted = pd.DataFrame({"id": [key[0]], "action": ["deleted"]})
        if state.hasTimedOut:
            pending, seq = state.get
            if pending:
                state.update((0, seq))
                state.setTimeoutDuration(retention_ms)
                yield deleted
            else:
                state.remove()
            return
        pending, seq = state.get if state.exists else (0, -1)
        rows = [(int(s), a) for batch in batches for s, a in zip(batch["seq"], batch["action"], strict=True) if s > seq]
        for s, action in sorted(rows):
            seq = s
            if action == "commit" and pending:
                yield deleted
            pending = int(action == "delete")
        state.update((pending, seq))
        state.setTimeoutDuration(delay_ms if pending else retention_ms)

    return requests.groupBy("id").applyInPandasWithState(decide, "id long, action string", "pending int, seq long", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Progress(StreamingQueryListener):
    """What running queries have done so far, by name or id: batches and rows, and how they ended."""

    def __init__(self) -> None:
        self.done: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.done[str(event.id)] = {"name": event.name, "batches": 0, "rows": 0, "ended": False, "error": None}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        entry = self.done.setdefault(str(event.progress.id), {"name": event.progress.name, "batches": 0, "rows": 0, "ended": False, "error": None})
        entry["batches"] += 1
        entry["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if entry := self.done.get(str(event.id)):
            entry |= {"ended": True, "error": event.exception}
