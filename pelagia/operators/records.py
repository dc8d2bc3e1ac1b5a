"""What one file or one page shows: full records, panes, songs, urls, facts for questions, names and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.operators import curation

FACTS = ("filename", "folder", "ext", "width", "height", "model_name", "model_type", "positive", "negative", "loras", "steps", "cfg", "sampler_name", "scheduler", "seed")


def record(files: DataFrame, ids: DataFrame, tags: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The files of ids with their marks, their tags by hand, those of extensions by score and name, and their lists.

    Only rows of these ids are aggregated, and a file's tags are few; what belongs to its group is in panes.
    """
    chosen = files.join(ids.select("id"), "id", "left_semi")
    own = tags.join(ids.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    plain = ~F.col("tag").startswith("label:")
    by_score = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(F.lower(a["tag"]) < F.lower(b["tag"]), -1).otherwise(1)
    machine = F.collect_list(F.when(F.col("source").startswith("ext:"), F.struct(F.coalesce("score", F.lit(-1.0)).alias("score"), F.col("tag"))))
    listed = own.groupBy(F.col("image_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("source") == "user") & plain, F.col("tag")))), ",").alias("tags"),
        F.array_join(F.transform(F.array_sort(machine, by_score), lambda x: x["tag"]), ",").alias("ext_tags"),
    )
    out = chosen.join(listed, "id", "left").join(curation.marks(own).withColumnRenamed("image_id", "id"), "id", "left")
    if members is not None:
        lists = members.join(ids.select(F.col("id").alias("image_id")), "image_id", "left_semi").groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_set("collection_id")).alias("collections"))
        out = out.join(lists, "id", "left")
    return out


def panes(files: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, member_id, stage, place): the members of each file's group, to be shown by place, then name and id."""
    stage = C.canonical_stage(F.coalesce(F.nullif("set_stage", F.lit("")), C.set_role(F.col("filename"))))
    groups = files.join(ids.select("id"), "id", "left_semi").where(F.col("group_id").isNotNull()).select("id", "group_id")
    rows = files.select(F.col("id").alias("member_id"), "group_id", "filename", stage.alias("stage"))
    return groups.join(rows, "group_id").select("id", "member_id", "filename", "stage", C.stage_rank(F.col("stage")).alias("place"))


def song_headline(name: Column, generic: Column, lyrics: Column, genre: Column, filename: Column) -> Column:
    """A song's name unless it stands for several genres, else its first line, its genre, or its readable file name."""
    own = F.when(~F.coalesce(generic, F.lit(False)), F.nullif(F.trim(name), F.lit("")))
    return F.coalesce(own, C.first_lyric_line(lyrics), F.nullif(F.trim(genre), F.lit("")), C.plain_stem(filename))


def songs(page: DataFrame, files: DataFrame, generic: DataFrame) -> DataFrame:
    """(id, headline, cover_id) of the songs of a page (id): the cover is the first picture of the song's group.

    generic are (song_name) that name more than one genre; lyrics are read for the page's rows only.
    """
    rows = files.join(page.select("id"), "id", "left_semi").where(C.is_kind(F.col("ext"), "audio"))
    pictures = files.where(C.is_kind(F.col("ext"), "image")).join(rows.select("group_id").distinct(), "group_id", "left_semi")
    covers = pictures.groupBy("group_id").agg(F.min("id").alias("cover_id"))
    known = generic.select("song_name", F.lit(True).alias("generic"))
    out = rows.join(covers, "group_id", "left").join(known, "song_name", "left")
    return out.select("id", song_headline(F.col("song_name"), F.col("generic"), F.col("lyrics"), F.col("song_genre"), F.col("filename")).alias("headline"), "cover_id")


def file_url(kind: str, file_id: Column, mtime: Column, root_id: Column, size: int | None = None) -> Column:
    """A link that changes whenever the file does."""
    end = F.lit("" if size is None else f"&s={size}")
    return F.concat(F.lit(f"/{kind}/"), file_id.cast("string"), F.lit("?v="), F.coalesce(mtime.cast("long"), F.lit(0)).cast("string"), F.lit("&r="), F.coalesce(root_id, F.lit("")), end)


def thumbnail_key(path: Column, size: int = 512) -> Column:
    digest = F.sha1(path)
    return F.concat_ws("/", F.lit(str(size)), F.substring(digest, 1, 2), F.concat(digest, F.lit(".webp")))


def question_facts(files: DataFrame) -> Column:
    """A file's facts as JSON, without blank ones."""
    fields = [F.nullif(F.col(c), F.lit("")).alias(c) if dict(files.dtypes)[c] == "string" else F.col(c) for c in FACTS if c in files.columns]
    return F.to_json(F.struct(*fields))


def renamed_path(rel_path: Column, new_name: Column) -> Column:
    """The path with its last part replaced."""
    return F.concat(F.regexp_extract(rel_path, "^(.*/)?[^/]*$", 1), new_name)


def set_id_of(graph_json: Column) -> Column:
    """A set id for files of one run without one: a hash of the graph they share, its keys in order."""
    entries = F.array_sort(F.map_entries(F.from_json(graph_json, "map<string,string>")))
    return F.concat(F.lit("auto-"), F.substring(F.sha2(F.to_json(entries).cast("binary"), 256), 1, 12))


def run_prefix(name: Column, stamp: Column) -> Column:
    """<name>_<month>_<day>_<year>/<name>_<hour>-<minute>-<second><run code> of a time."""
    return F.concat(name, F.date_format(stamp, "_M_d_yy"), F.lit("/"), name, F.date_format(stamp, "_HH-mm-ss"), C.run_code(F.unix_timestamp(stamp)))


def with_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, size, mtime) with the short hash that the cache knows: by path, size and time, else by name and size.

    Those that stay null are to be read and hashed.
    """
    name = lambda c: F.lower(F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1))
    exact = cache.groupBy("path", "size", F.floor("mtime").alias("second")).agg(F.max("sha256").alias("by_path"))
    loose = cache.groupBy(name(F.col("path")).alias("name"), "size").agg(F.max_by("sha256", "mtime").alias("by_name"))
    rows = files.withColumn("second", F.floor("mtime")).withColumn("name", name(F.col("path")))
    out = rows.join(exact, ["path", "size", "second"], "left").join(loose, ["name", "size"], "left")
    return out.select(*files.columns, F.substring(F.coalesce("by_path", "by_name"), 1, 10).alias("short_hash"))


def survey(sets: DataFrame, files: DataFrame) -> DataFrame:
    """(root_id, copies, bytes, curated) of the doomed copies of duplicate sets, by library."""
    doomed = sets.where("not keep").select("id", "size", "weight")
    rows = doomed.join(files.select("id", "root_id"), "id")
    return rows.groupBy("root_id").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes"), F.count_if(F.col("weight") > 0).alias("curated"))


def slices(sets: DataFrame, each: int) -> tuple[DataFrame, DataFrame]:
    """The sets that free the most and the least space."""
    heads = sets.where("keep").select("set_id", "filename", "n_dupes", "recoverable")
    return heads.orderBy(F.desc("recoverable"), "filename", "set_id").limit(each), heads.orderBy("recoverable", "filename", "set_id").limit(each)

