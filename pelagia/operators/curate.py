"""Changes to curated data as pure functions, duplicate clusters, merging and culling plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with those of rows whose key it doesn't hold yet."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """table with rows in place of those that share their key; of several rows of a key the newest, if told by what."""
    if newest is not None:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), newest).alias("row")).select("row.*")
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def replace_tags(tags: DataFrame, rows: DataFrame, source: str, answered: DataFrame | None = None) -> DataFrame:
    """One source's tags of the answered files (image_id; those in rows if not given), replaced by normalised ones.

    A file with an empty answer loses its old tags. Labels can't be set this way.
    """
    cleaned = rows.select("image_id", F.substring(F.lower(F.trim(F.regexp_replace(F.trim("tag"), ",", " "))), 1, 64).alias("tag"), F.lit(source).alias("source"), "score")
    cleaned = cleaned.where((F.col("tag") != "") & ~F.col("tag").startswith("label:")).groupBy("image_id", "tag", "source").agg(F.max("score").alias("score"))
    old = (rows if answered is None else answered).select("image_id", F.lit(source).alias("source")).distinct()
    return tags.join(old, ["image_id", "source"], "left_anti").select("image_id", "tag", "source", "score").unionByName(cleaned)


def delete_cascade(children: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in children.items()}


def snapshot_diff(stored: DataFrame, walked: DataFrame, key: str, stamp: str, size: str, tolerance: float) -> DataFrame:
    """(key, state): new, changed, unchanged or gone, by time within a tolerance and by size."""
    a = stored.select(key, F.col(stamp).alias("old_stamp"), F.col(size).alias("old_size"))
    b = walked.select(key, F.col(stamp).alias("new_stamp"), F.col(size).alias("new_size"))
    same = (F.abs(F.col("old_stamp") - F.col("new_stamp")) <= tolerance) & (F.col("old_size") == F.col("new_size"))
    state = F.when(F.col("old_size").isNull(), "new").when(F.col("new_size").isNull(), "gone").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def changed_folders(stored: DataFrame, current: DataFrame, tolerance: float) -> DataFrame:
    """(folder, state) of folders that are new, gone, or touched beyond the tolerance."""
    both = stored.withColumnRenamed("mtime", "old").join(current.withColumnRenamed("mtime", "now"), "folder", "full_outer")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("old").isNull() | (F.abs(F.col("now") - F.col("old")) > tolerance), "changed")
    return both.select("folder", state.alias("state")).where(F.col("state").isNotNull())


def gap_clusters(rows: DataFrame, keys: list[str], stamp: Column, gap: float) -> DataFrame:
    """rows with cluster: a number that rises within the keys wherever the step in time reaches the gap.

    Rows of one key and half a gap of time hang together, so the window runs over such cells, which are
    aggregated before they move, and not over the rows of a key. Null keys are a key; null times belong to its first cluster.
    """
    no_time = F.lit(-(1 << 62))
    celled = rows.withColumn("gap_stamp", stamp).withColumn("gap_cell", F.coalesce(F.floor(F.col("gap_stamp") * 2 / gap), no_time))
    cells = celled.groupBy(*keys, "gap_cell").agg(F.min("gap_stamp").alias("first"), F.max("gap_stamp").alias("last"))
    w = Window.partitionBy(*keys).orderBy("gap_cell")
    stepped = cells.withColumn("step", F.when(F.col("first") - F.lag("last").over(w) >= gap, 1).otherwise(0))
    numbered = stepped.select(*(F.col(k).alias(f"cell_{k}") for k in (*keys, "gap_cell")), F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))
    same = F.col("gap_cell") == F.col("cell_gap_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"cell_{k}"))
    return celled.join(numbered, same).select(*rows.columns, "cluster")


def band_pairs(anchor: DataFrame, others: DataFrame, keys: list[str], stamp: str, gap: float, id_column: str) -> DataFrame:
    """(anchor, copy) pairs that share the keys and lie within the gap; null keys and times are in none.

    Rows meet by key and by cell of two gaps of time, to which each anchor looks one back and one ahead, so a frequent key is
    dealt over its cells and only rows near in time are compared.
    """
    cell = F.floor(F.col(stamp) / (2 * gap))
    a = anchor.select(*keys, F.col(id_column).alias("keep_id"), F.col(stamp).alias("keep_stamp"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("band_cell"))
    b = others.select(*keys, F.col(id_column).alias("copy_id"), F.col(stamp).alias("copy_stamp"), cell.alias("band_cell"))
    return a.join(b, [*keys, "band_cell"]).where((F.abs(F.col("keep_stamp") - F.col("copy_stamp")) < gap) & (F.col("keep_id") != F.col("copy_id"))).select("keep_id", "copy_id")


def merge_notes(rows: DataFrame, key: str, order: list[str], note: str, separator: str) -> DataFrame:
    """Distinct notes of each key, joined in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(note).alias("note"))))
    return rows.where(F.col(note).isNotNull()).groupBy(key).agg(F.array_join(F.array_distinct(F.transform(listed, lambda x: x["note"])), separator).alias("notes"))


def set_shapes(members: DataFrame, group: str, role: str) -> DataFrame:
    """The sorted roles of each group: groups of equal shape can be culled alike."""
    return members.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(role)), ",").alias("shape"), F.count(F.lit(1)).alias("n"))


def family_vote(rows: DataFrame, family: str, spelling: str) -> DataFrame:
    """The most used spelling of each family, ties by the alphabet."""
    n = rows.groupBy(F.col(family).alias("family"), F.col(spelling).alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("family").agg(F.min_by("spelling", F.struct(-F.col("n"), F.col("spelling"))).alias("spelling"), F.max("n").alias("votes"))


def rename_plan(files: DataFrame, find: str, replacement: str, existing: DataFrame | None = None) -> DataFrame:
    """New names with numbers where two files of a folder would meet, ignoring case.

    No new name is one that a file of the folder has now, in files or in existing (folder, filename), but its own,
    nor a name without a number that another file gets. Files whose name doesn't change keep it.
    """
    ending = r"(\.[^.]*)$"
    stem = lambda name: F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    rows = files.select("id", "folder", "filename", F.replace(stem("filename"), F.lit(find), F.lit(replacement)).alias("stem"), F.regexp_extract("filename", ending, 1).alias("ext"))
    rows = rows.withColumn("wanted", F.concat("stem", "ext")).withColumn("base", F.lower("wanted")).withColumn("own", F.col("base") == F.lower("filename"))
    first_own = F.row_number().over(Window.partitionBy("folder", "base", "own").orderBy(F.col("wanted") != F.col("filename"), "id")) == 1
    rows = rows.withColumn("stays", (F.col("wanted") == F.col("filename")) | (F.col("own") & first_own))
    place = F.row_number().over(Window.partitionBy("folder", "base", "stays").orderBy("id")).cast("long")
    rows = rows.withColumn("place", F.when(~F.col("stays"), place))
    # names that are taken, as the numbers that they block of a base name (1: the name itself)
    held = files.select("folder", F.lower("filename").alias("name"))
    held = held if existing is None else held.union(existing.select("folder", F.lower("filename")))
    number, number_end = F.regexp_extract(stem("name"), "_([1-9][0-9]{0,17})$", 1), F.regexp_extract("name", ending, 1)
    numbered = held.union(rows.select("folder", "base")).where((number != "") & (number != "1"))
    numbered = numbered.select("folder", F.concat(F.regexp_replace(stem("name"), "_[0-9]+$", ""), number_end).alias("base"), number.cast("long").alias("number"))
    blocked = numbered.union(held.select("folder", F.col("name").alias("base"), F.lit(1).cast("long"))).distinct()
    blocked = blocked.join(rows.where(~F.col("stays")).select("folder", "base").distinct(), ["folder", "base"], "left_semi")
    by_base = Window.partitionBy("folder", "base")
    blocked = blocked.select("folder", "base", (F.col("number") - F.row_number().over(by_base.orderBy("number"))).alias("place"))  # how many free numbers lie before it
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "filename", "stem", "ext", "wanted")]
    both = rows.where(~F.col("stays")).select("folder", "base", "place", "id", "filename", "stem", "ext", "wanted", F.lit(0).alias("skip")).union(blocked.select("folder", "base", "place", *nothing, F.lit(1)))
    n = F.col("place") + F.sum("skip").over(by_base.orderBy("place", "skip").rowsBetween(Window.unboundedPreceding, 0))
    named = both.withColumn("n", n).where("skip = 0")
    named = named.select("id", "folder", "filename", F.when(F.col("n") == 1, F.col("wanted")).otherwise(F.concat("stem", F.lit("_"), F.col("n").cast("string"), "ext")).alias("new_name"))
    return named.union(rows.where("stays").select("id", "folder", "filename", F.col("wanted").alias("new_name")))


def whole_groups(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Groups all of whose members are selected: only their side files go along."""
    hit = selection.select("id").distinct().withColumn("hit", F.lit(True))
    return files.where(F.col("group_id").isNotNull()).join(hit, "id", "left").groupBy("group_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("whole")).where("whole").select("group_id")
