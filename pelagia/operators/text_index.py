"""Text search from an index of word positions, kept in segments so that a change of few files writes few rows.

A posting is (token, id, at, segment): a folded word, its file and its place among the file's words. Fields are a
place apart, so no phrase runs from one into the next. Texts are dealt by file before they are split, and what a task
writes is sorted by token and then by file, so postings are never moved and a word or a prefix reads few pages of each part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.operators import filters, store

POSTINGS, RETIRED = "token string, id long, at int, segment int", "id long, segment int"
MOST_SENT = 1 << 21


@dataclass(frozen=True)
class Index:
    """postings of all segments; retired (id, segment): what earlier segments say of the file counts no more."""

    postings: DataFrame
    retired: DataFrame


def postings(files: DataFrame, segment: int = 0) -> DataFrame:
    """The postings of files; rows without a word, and null texts, give none."""
    text = files if "search_text" in files.columns else filters.with_search_text(files)
    words = F.split(F.replace("search_text", F.lit("\n"), F.lit(" \n ")), " ")
    placed = text.select(F.col("id").cast("long").alias("id"), F.posexplode(words).alias("at", "token")).where(~F.col("token").isin("", "\n"))
    return placed.select("token", "id", "at", F.lit(segment).alias("segment"))


def _write(table: DataFrame, path: str, *order: str) -> None:
    sorted_ = table.sortWithinPartitions(*order) if order else table
    sorted_.write.mode("overwrite").parquet(path)


def _segments(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """The committed version and its segments: one row each, and few between two compactions."""
    held = store.committed(spark, folder)
    return (-1, []) if held is None else (held[0], sorted(r["segment"] for r in held[1].collect()))


def _commit(spark: SparkSession, folder: str, version: int, segments: list[int]) -> None:
    store.write_version(spark.createDataFrame([(s,) for s in segments], "segment int"), folder, version)
    store.commit(spark, folder, version)


def add(spark: SparkSession, folder: str, files: DataFrame, gone: DataFrame | None = None) -> int:
    """Adds the words of new and changed files, and forgets the files of gone (id); returns the new version.

    Only these files are written. Readers see the change as a whole or not at all; an addition that was cut off before
    its commit is written anew under the same number. An index has one writer at a time and any number of readers.
    """
    version, segments = _segments(spark, folder)
    number, root = version + 1, folder.rstrip("/")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # not fewer: texts are small where they move, and large once they are split and sorted
    searched = files.select("id", *(c for c in (*filters.SEARCHED, "search_text") if c in files.columns)).repartition(parts, "id")
    _write(postings(searched, number), f"{root}/postings-{number:09d}", "token", "id")
    changed = files.select(F.col("id").cast("long").alias("id"))
    changed = changed if gone is None else changed.union(gone.select(F.col("id").cast("long")))
    changed = changed if segments else changed.limit(0)  # the first segment has none before it
    _write(changed.distinct().withColumn("segment", F.lit(number)), f"{root}/retired-{number:09d}")
    _commit(spark, folder, number, [*segments, number])
    return number


def read(spark: SparkSession, folder: str) -> Index:
    """The committed index; files of older versions stay until they are deleted."""
    segments, root = _segments(spark, folder)[1], folder.rstrip("/")
    load = lambda kind, schema: spark.read.schema(schema).parquet(*(f"{root}/{kind}-{s:09d}" for s in segments)) if segments else spark.createDataFrame([], schema)
    return Index(load("postings", POSTINGS), load("retired", RETIRED))


def live(rows: DataFrame, retired: DataFrame, sent: bool = False) -> DataFrame:
    """rows (id, segment, ...) that no later segment has replaced; if the replaced ids are sent, rows are not moved."""
    since = retired.groupBy("id").agg(F.max("segment").alias("since"))
    since = F.broadcast(since) if sent else since
    return rows.join(since, "id", "left").where(F.col("since").isNull() | (F.col("segment") >= F.col("since"))).select(*rows.columns)


def compact(spark: SparkSession, folder: str, most: int = MOST_SENT) -> int:
    """All segments as one, without what was replaced. Up to most replaced files are sent to the postings; more meet them in a join."""
    version, index, root = _segments(spark, folder)[0], read(spark, folder), folder.rstrip("/")
    number = version + 1
    _write(live(index.postings, index.retired, index.retired.count() <= most).withColumn("segment", F.lit(number)).select("token", "id", "at", "segment"), f"{root}/postings-{number:09d}", "token", "id")
    _write(spark.createDataFrame([], RETIRED), f"{root}/retired-{number:09d}")
    _commit(spark, folder, number, [number])
    return number


def search(index: Index, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), everything: DataFrame | None = None) -> DataFrame:
    """Ids of the files in which every include term and no exclude term is found, by the rules of filters.apply.

    A term of several words is a phrase; its last word is a prefix. An include term without letters is found nowhere,
    an exclude term without letters is ignored. One scan reads the words of all terms; single words are
    aggregated before they move, words of phrases move once, by file. everything (id) tells all files, which a search without
    include terms needs.
    """
    wanted = [C.term_words(t) for t in dict.fromkeys(include)]
    barred = [w for t in dict.fromkeys(exclude) if (w := C.term_words(t))]
    nothing = index.postings.select("id").where(F.lit(False))
    if not all(wanted):
        return nothing
    if not wanted and everything is None:
        raise ValueError("a search without include terms needs all ids")
    terms = wanted + barred
    if not terms:
        return everything.select("id").distinct()
    token, conditions, hits = F.col("token"), [], []
    for number, words in enumerate(terms):
        for slot, word in enumerate(words):
            found = token.startswith(word) if slot == len(words) - 1 else token == word
            start = F.col("at") - slot if len(words) > 1 else F.lit(0)
            conditions.append(found)
            hits.append(F.when(found, F.struct(F.lit(number).alias("term"), F.lit(slot).alias("slot"), start.cast("int").alias("start"))))
    rows = index.postings.where(reduce(lambda a, b: a | b, conditions))
    rows = rows.select("segment", "id", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("hit")).select("segment", "id", "hit.*")
    if any(len(w) > 1 for w in terms):
        whole = F.element_at(F.array(*(F.lit(len(w)) for w in terms)), F.col("term") + 1)
        rows = rows.repartition("segment", "id").groupBy("segment", "id", "term", "start").agg(F.collect_set("slot").alias("slots")).where(F.size("slots") == whole)
    met = live(rows.groupBy("segment", "id").agg(F.collect_set("term").alias("terms")), index.retired)
    of = lambda numbers: F.filter("terms", lambda t: t.isin(*numbers))
    if not wanted:
        return everything.select("id").distinct().join(met.select("id"), "id", "left_anti")
    met = met.where(F.size(of(range(len(wanted)))) == len(wanted))
    met = met.where(F.size(of(range(len(wanted), len(terms)))) == 0) if barred else met
    return met.select("id")


def apply(files: DataFrame, spec: filters.FilterSpec, index: Index, **others) -> DataFrame:
    """filters.apply with its terms looked up in the index."""
    rest = filters.apply(files, spec.without("include", "exclude"), **others)
    if not spec.include and not spec.exclude:
        return rest
    return rest.join(search(index, spec.include, spec.exclude, files.select("id")), "id", "left_semi").select(*rest.columns)
