"""Culls in steps: stopped, resumed, cut off and undone."""

import pytest
from pyspark.sql import functions as F

from pelagia.operators import cull_runs, curation


@pytest.fixture(scope="module")
def tables(spark):
    d = F.col("id")
    files = spark.range(60).withColumn("mtime", (d * 1.0))
    tags = files.select(d.alias("image_id"), F.concat(F.lit("t"), (d % 5).cast("string")).alias("tag"), F.lit("user").alias("source"), F.lit(None).cast("double").alias("score"))
    notes = files.select("id", F.when(d % 2 == 0, F.concat(F.lit("n"), d.cast("string"))).alias("note"))
    return {"files": files, "tags": tags, "notes": notes, "quality": files.where("id % 3 = 1").select(d.alias("image_id"), F.lit(1.0).alias("reward"))}


def plan(spark):
    """Fourteen sets of four; four files are in none."""
    return spark.range(56).select(F.floor(F.col("id") / 4).alias("set_id"), "id", (F.col("id") % 4 == 1).alias("keep"))


def rows(tables):
    return {name: sorted((tuple(r) for r in t.select(*sorted(t.columns)).collect()), key=repr) for name, t in tables.items()}


def whole(spark, tables, taken_back=()):
    kept = plan(spark).where(~F.col("set_id").isin(*taken_back)) if taken_back else plan(spark)
    return rows(curation.cull(kept, tables["files"], tables["tags"], tables["notes"], tables["quality"]))


def test_a_stopped_run_goes_on_and_can_be_undone(spark, tables, tmp_path):
    at, batches = f"file://{tmp_path}/run", 4
    with pytest.raises(ValueError):
        cull_runs.run(spark, at, tables)  # not started
    cull_runs.start(spark, at, plan(spark), batches)
    assert rows(cull_runs.result(spark, at, tables)) == rows(tables)
    stops = iter((False, True))
    assert not cull_runs.run(spark, at, tables, lambda: next(stops))
    assert cull_runs.progress(spark, at) == (1, batches)
    # sets are done whole or not at all
    left = {r["id"] for r in cull_runs.result(spark, at, tables)["files"].collect()}
    here = [sum(i in left for i in range(s * 4, s * 4 + 4)) for s in range(14)]
    assert set(here) == {1, 4} and {56, 57, 58, 59} <= left
    cull_runs.start(spark, at, plan(spark).where("set_id = 0"), 9)  # a started run keeps its plan
    assert cull_runs.run(spark, at, tables) and cull_runs.progress(spark, at) == (batches, batches)
    assert rows(cull_runs.result(spark, at, tables)) == whole(spark, tables)
    back = spark.createDataFrame([("3",), ("7",)], "set string")
    cull_runs.undo(spark, at, back)
    cull_runs.undo(spark, at, back)
    assert rows(cull_runs.result(spark, at, tables)) == whole(spark, tables, (3, 7))
    assert tuple(cull_runs.summary(spark, at).first()) == (14, 12, 2, 36)


def test_a_batch_that_was_cut_off_is_done_once(spark, tables, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/run"
    cull_runs.start(spark, at, plan(spark), 2)
    cull_runs.undo(spark, at, spark.createDataFrame([("5",)], "set string"))  # before its turn: left alone
    with monkeypatch.context() as m:
        m.setattr(cull_runs, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError):
            cull_runs.run(spark, at, tables)
    assert cull_runs.progress(spark, at) == (0, 2) and rows(cull_runs.result(spark, at, tables)) == rows(tables)
    assert cull_runs.run(spark, at, tables)
    assert rows(cull_runs.result(spark, at, tables)) == whole(spark, tables, (5,))


def test_a_run_of_no_sets(spark, tables, tmp_path):
    at = f"file://{tmp_path}/run"
    cull_runs.start(spark, at, plan(spark).where("false"), 2)
    assert cull_runs.run(spark, at, tables)
    assert rows(cull_runs.result(spark, at, tables)) == rows(tables)
    assert tuple(cull_runs.summary(spark, at).first()) == (0, 0, 0, 0)
