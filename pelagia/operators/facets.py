"""Facet, tag and collection counts, each blind to its own selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.operators import filters
from pelagia.operators.filters import NONE, FilterSpec


def facets(files: DataFrame, spec: FilterSpec) -> DataFrame:
    """(dim, value, n) of models, families, folders and roots in one scan and one shuffle.

    A file counts for a dimension if it passes the conditions of all the others, so flags are computed once
    for each row and one row for each dimension goes on.
    """
    shared = filters.apply(files, spec, skip=("root", "model", "mtype", "folder"))
    dims = {"model": "model_name", "mtype": "model_type", "folder": "folder", "root": "root_id"}
    flags = {d: filters.dimension(spec, d) for d in dims}
    rows = []
    for dim, column in dims.items():
        others = F.lit(True)
        for other, ok in flags.items():
            if other != dim:
                others = others & ok
        value = F.lower(column) if dim == "mtype" else F.col(column)
        rows.append(F.when(others, F.struct(F.lit(dim).alias("dim"), F.coalesce(value, F.lit(NONE)).alias("value"))))
    every = F.lit(True)
    for ok in flags.values():
        every = every & ok
    rows.append(F.when(every, F.struct(F.lit("total").alias("dim"), F.lit("").alias("value"))))
    return shared.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f")).groupBy("f.dim", "f.value").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(tags: DataFrame, matched: DataFrame) -> DataFrame:
    """Files for each tag among those matched; machine is true if no one has set it by hand."""
    inside = tags.join(matched.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return inside.groupBy("tag").agg(F.count_distinct("image_id").alias("n"), (F.max(F.when(F.col("source") == "user", 1).otherwise(0)) == 0).alias("machine"))


def collection_counts(collections: DataFrame, members: DataFrame, matched: DataFrame) -> DataFrame:
    """Members of every collection among the matched files, empty collections included."""
    inside = members.join(matched.select(F.col("id").alias("image_id")), "image_id", "left_semi").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    return collections.join(inside, "collection_id", "left").select("collection_id", F.coalesce("n", F.lit(0)).alias("n"))


def group_state(members: DataFrame, selection: DataFrame) -> DataFrame:
    """How many of the selected files each collection holds."""
    return members.join(selection.select(F.col("id").alias("image_id")), "image_id").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))


def generic_names(files: DataFrame, name: str, trait: str) -> DataFrame:
    """Names that stand for more than one trait."""
    return files.groupBy(name).agg(F.count_distinct(trait).alias("traits")).where("traits > 1")


def mark_lists(files: DataFrame, tags: DataFrame, spec: FilterSpec, members: DataFrame | None = None) -> DataFrame:
    """(list, name, n, machine) of tags, labels and favourites among the files of a search.

    No list narrows itself: labels are counted without the chosen labels, favourites without the favourite
    condition; tags follow all of the search.
    """
    found = lambda s: filters.apply(files, s, tags, members=members).select(F.col("id").alias("image_id"))
    labels = (F.col("source") == "user") & F.col("tag").startswith("label:")
    by_tag = tags.where(filters.is_tag() & ~labels).join(found(spec), "image_id", "left_semi")
    by_tag = by_tag.groupBy("tag").agg(F.count_distinct("image_id").alias("n"), (~F.bool_or(F.col("source") == "user")).alias("machine"))
    by_label = tags.where(labels).join(found(spec.without("labels")), "image_id", "left_semi").groupBy("tag").agg(F.count_distinct("image_id").alias("n"))
    liked = tags.where("source = 'fav'").join(found(spec.without("fav")), "image_id", "left_semi").agg(F.count_distinct("image_id").alias("n"))
    out = by_tag.select(F.lit("tag").alias("list"), F.col("tag").alias("name"), "n", "machine")
    out = out.union(by_label.select(F.lit("label"), F.substring("tag", 7, 100), "n", F.lit(False)))
    return out.union(liked.select(F.lit("fav"), F.lit("favorite"), "n", F.lit(False)))


def ordered(counts: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Facet rows with a place: most files first, folders of equal number by name; roots in their order, empty ones too.

    roots are (place, root_id) of the configuration; what isn't a facet of a root comes as it is.
    """
    rows = counts.where("dim <> 'root'").withColumn("order", F.struct(-F.col("n"), "value")) if roots is not None else counts.withColumn("order", F.struct(-F.col("n"), "value"))
    rows = rows.select("dim", "value", "n", "order")
    if roots is not None:
        by_root = counts.where("dim = 'root'").select(F.col("value").alias("root_id"), "n")
        listed = roots.join(by_root, "root_id", "left").select(F.lit("root").alias("dim"), F.col("root_id").alias("value"), F.coalesce("n", F.lit(0)).alias("n"), F.struct(F.col("place").cast("long").alias("n"), F.col("root_id").alias("value")).alias("order"))
        rows = rows.union(listed)
    return rows.orderBy("dim", "order").select("dim", "value", "n")
