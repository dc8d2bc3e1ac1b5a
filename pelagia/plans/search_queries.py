"""Queries that search an index of word positions, each with SQL that scans the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators import store, text_index
from pelagia.operators.catalog import media_view
from pelagia.operators.filters import FilterSpec
from pelagia.plans import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str):
    """Registers a function under its name with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql.CATALOG + text
        return function

    return register


def has(term: str) -> str:
    return f"contains({sql.SEARCHED}, ' {term}')"


def indexed(spark, files):
    """An index of files, written to a folder of its own and read back."""
    folder = store.shared_dir(spark, "text-index")
    text_index.add(spark, folder, files)
    return text_index.read(spark, folder)


@query(f"SELECT 'of th' AS term, id FROM files WHERE {has('of th')} UNION ALL SELECT 'shot 1', id FROM files WHERE {has('shot 1')} AND {has('d')}")
def index_phrases(spark, sf_dir):
    files = media_view(spark, sf_dir)
    index = indexed(spark, files)
    one = text_index.search(index, ("of_th",)).select(F.lit("of th").alias("term"), "id")
    return one.union(text_index.search(index, ("shot_1", "d")).select(F.lit("shot 1").alias("term"), "id"))


@query(f"SELECT id FROM files WHERE NOT {has('refi')} AND NOT {has('shot 2')}")
def index_exclude(spark, sf_dir):
    """Exclusion alone: all files but those that the index finds."""
    files = media_view(spark, sf_dir)
    return text_index.search(indexed(spark, files), (), ("refi", "shot_2", "_"), files.select("id"))


@query(f"SELECT id, filename FROM files WHERE root_id IN ('r0', 'r2') AND ({sql.VIDEO} OR group_id IN (SELECT group_id FROM files WHERE {sql.VIDEO} AND group_id IS NOT NULL)) AND {has('shot')} AND {has('en')} AND NOT {has('gen src1')}")
def index_filtered(spark, sf_dir):
    """Terms from the index beside other conditions."""
    files = media_view(spark, sf_dir)
    spec = FilterSpec(include=("shot", "en"), exclude=("gen_src1",), roots=("r0", "r2"), kind="video")
    return text_index.apply(files, spec, indexed(spark, files)).select("id", "filename")


CHANGED = ", after AS (SELECT * REPLACE (CASE WHEN toxic = 1 THEN 'Neues Lied, zweimal neu' ELSE lyrics END AS lyrics, CASE WHEN toxic = 1 THEN 'ohne' ELSE positive END AS positive) FROM files WHERE reward IS DISTINCT FROM 0)"


@query(CHANGED + f", found AS (SELECT id FROM after WHERE {has('neues lied')} UNION ALL SELECT -id FROM after WHERE {has('shot')} AND NOT {has('neu')} AND NOT {has('det')}) SELECT 'segments' AS form, id FROM found UNION ALL SELECT 'compacted', id FROM found")
def index_after_changes(spark, sf_dir):
    """An index after some files have changed and others have gone, in two segments and compacted."""
    files, folder = media_view(spark, sf_dir), store.shared_dir(spark, "text-index")
    text_index.add(spark, folder, files)
    changed = files.where("toxic = 1 and not (reward <=> 0)").withColumn("lyrics", F.lit("Neues Lied, zweimal neu")).withColumn("positive", F.lit("ohne"))
    text_index.add(spark, folder, changed, files.where("reward = 0").select("id"))

    def found(form: str):
        index = text_index.read(spark, folder)
        new = text_index.search(index, ("neues_lied",)).select("id")
        rest = text_index.search(index, ("shot",), ("neu", "det")).select(-F.col("id"))
        return new.union(rest).select(F.lit(form).alias("form"), "id")

    before = found("segments")
    text_index.compact(spark, folder)
    return before.union(found("compacted"))
