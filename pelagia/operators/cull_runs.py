"""Culls of many sets in steps that can be stopped, resumed and undone.

A run is a folder: its plan, written once and dealt into batches by set, one folder of changes for each batch that
is done, and the sets whose change was undone. The number of batches done is committed by one rename, so a run that
ends anywhere goes on with the first batch that isn't committed and does none twice. The tables themselves
stay as they are; `result` lays the committed changes over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import curation, store
from pelagia.streaming.watch import exists

BATCHES = 16
KEY_OF = {"files": "id", "tags": "image_id", "notes": "id", "quality": "image_id"}
PLAN = "set string, id long, keep boolean, batch int"


def start(spark: SparkSession, folder: str, plan: DataFrame, batches: int = BATCHES) -> None:
    """Writes a plan (group_id or set_id, id, keep), in which a file is in one set only; a run that was started already keeps its plan."""
    if store.committed(spark, folder) is not None:
        return
    key = "group_id" if "group_id" in plan.columns else "set_id"
    rows = plan.select(F.col(key).cast("string").alias("set"), F.col("id").cast("long").alias("id"), "keep")
    rows.withColumn("batch", F.pmod(F.xxhash64("set"), F.lit(batches)).cast("int")).repartition("batch").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/plan")
    _commit(spark, folder, 0, batches)


def _commit(spark: SparkSession, folder: str, done: int, batches: int) -> None:
    store.write_version(spark.createDataFrame([(batches,)], "batches int"), folder, done)
    store.commit(spark, folder, done)


def progress(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Batches done, and all."""
    held = store.committed(spark, folder)
    if held is None:
        raise ValueError("the run was not started")
    return held[0], held[1].first()["batches"]


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PLAN).parquet(f"{folder.rstrip('/')}/plan")


def _undone(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/undone"
    return (spark.read.schema("set string").parquet(path) if exists(spark, path) else spark.createDataFrame([], "set string")).distinct()


def _left(plan: DataFrame, undone: DataFrame) -> DataFrame:
    return plan.join(undone, "set", "left_anti").select(*plan.columns)


def run(spark: SparkSession, folder: str, tables: dict[str, DataFrame], stop: Callable[[], bool] = lambda: False) -> bool:
    """Does the batches that are left and says whether all are done; stop is asked before each of them.

    tables are files, tags, notes and quality as they were at the start. What stays takes over what its set's other
    files carry before those go. A set that was undone before its turn is left alone.
    """
    done, batches = progress(spark, folder)
    while done < batches and not stop():
        plan = _left(_plan(spark, folder).where(F.col("batch") == done), _undone(spark, folder))
        mine = plan.select("id", F.col("set").alias("set_id"))
        touched = {name: tables[name].join(mine.select(F.col("id").alias(key)), key, "left_semi") for name, key in KEY_OF.items()}
        after = curation.cull(plan.select(F.col("set").alias("set_id"), "id", "keep"), touched["files"], touched["tags"], touched["notes"], touched["quality"])
        for name, key in KEY_OF.items():
            of_set = mine.select(F.col("id").alias(key), F.col("set_id").alias("set"))
            after[name].join(of_set, key).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/changes-{done:06d}/{name}")
        done += 1
        _commit(spark, folder, done, batches)
    return done >= batches


def undo(spark: SparkSession, folder: str, sets: DataFrame) -> None:
    """Takes back the changes of sets (set); asked for twice it does the same."""
    sets.select(F.col("set").cast("string").alias("set")).write.mode("append").parquet(f"{folder.rstrip('/')}/undone")


def result(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the changes of all sets that are done and not undone; other rows are as they were."""
    done, undone = progress(spark, folder)[0], _undone(spark, folder)
    if done == 0:
        return dict(tables)
    ids, out = _left(_plan(spark, folder).where(F.col("batch") < done), undone).select("id"), {}
    for name, key in KEY_OF.items():
        paths = [f"{folder.rstrip('/')}/changes-{n:06d}/{name}" for n in range(done)]
        changed = spark.read.parquet(*paths).join(undone, "set", "left_anti")
        kept = tables[name].join(ids.select(F.col("id").alias(key)), key, "left_anti")
        columns = [c for c in tables[name].columns if c in changed.columns]
        out[name] = kept.select(*columns).unionByName(changed.select(*columns))
    return out


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(sets, done, undone, removed): sets of the plan, those whose change holds, those taken back, files that went."""
    done = progress(spark, folder)[0]
    taken = _undone(spark, folder).withColumn("back", F.lit(True))
    rows = _plan(spark, folder).join(taken, "set", "left").withColumn("holds", (F.col("batch") < done) & F.col("back").isNull())
    sets = rows.groupBy("set").agg(F.first("holds").alias("holds"), F.first("back").isNotNull().alias("back"), F.count_if(F.col("holds") & ~F.col("keep")).alias("gone"))
    return sets.agg(F.count(F.lit(1)).alias("sets"), F.count_if("holds").alias("done"), F.count_if("back").alias("undone"), F.coalesce(F.sum("gone"), F.lit(0)).alias("removed"))
