"""What users decide about files, as pure functions over the tags, quality and list tables.

Tags are (image_id, tag, source, score); labels are tags "label:<name>" by the user, favourites a source of
their own. Each function maps tables to new tables; `changed` counts what differs. Groups of any size pass:
everything is an equi-join or an aggregation with partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.functions import vocab
from pelagia.operators import curate
from pelagia.operators.filters import is_tag

KEYS = ["image_id", "tag", "source"]


def changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(added, removed): how many keys only one of two versions has."""
    both = before.select(*keys, F.lit(1).alias("old"), F.lit(0).alias("new")).union(after.select(*keys, F.lit(0), F.lit(1)))
    by_key = both.groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return by_key.agg(F.count_if((F.col("new") == 1) & (F.col("old") == 0)).alias("added"), F.count_if((F.col("new") == 0) & (F.col("old") == 1)).alias("removed"))


def clean_tag(tag: str) -> str:
    return tag.strip().replace(",", " ").strip().lower()


def _rows(ids: DataFrame, tag: str, source: str) -> DataFrame:
    return ids.select(F.col("id").alias("image_id"), F.lit(tag).alias("tag"), F.lit(source).alias("source"), F.lit(None).cast("double").alias("score")).distinct()


def _without(tags: DataFrame, ids: DataFrame | None, condition: Column) -> DataFrame:
    """tags without the rows of ids (all where None) that meet the condition."""
    gone = F.coalesce(condition, F.lit(False))
    if ids is None:
        return tags.where(~gone)
    hit = ids.select(F.col("id").alias("image_id"), F.lit(True).alias("of_ids")).distinct()
    return tags.join(hit, "image_id", "left").where(~(gone & F.col("of_ids").isNotNull())).select(*tags.columns)


def add_tag(tags: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    return curate.insert_ignore(tags, _rows(ids, clean_tag(tag), "user"), KEYS)


def remove_tag(tags: DataFrame, ids: DataFrame | None, tag: str) -> DataFrame:
    """Without the tag on these files, or on all, whoever set it; favourites are no tags."""
    return _without(tags, ids, (F.col("tag") == clean_tag(tag)) & is_tag())


def clear_tags(tags: DataFrame, ids: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """Without the tags of one source, or of all machines where it is None."""
    return _without(tags, ids, F.col("source") == source if source else F.col("source").startswith("ext:"))


def clear_scores(quality: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return quality.where("false") if ids is None else quality.join(ids.select(F.col("id").alias("image_id")), "image_id", "left_anti")


def is_status() -> Column:
    return (F.col("source") == "user") & F.col("tag").isin(*(f"label:{x}" for x in vocab.STATUS_LABELS))


def set_label(tags: DataFrame, ids: DataFrame, label: str | None) -> DataFrame:
    """One status for each file, or none; flags stay."""
    label = (label or "").strip().lower() or None
    if label is not None and label not in vocab.STATUS_LABELS:
        raise ValueError(f"unknown label: {label}")
    left = _without(tags, ids, is_status())
    return left if label is None else curate.insert_ignore(left, _rows(ids, f"label:{label}", "user"), KEYS)


def toggle_flag(tags: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """ids are (id, pos): all get or lose the flag, as the first of them doesn't have or has it."""
    if flag not in vocab.FLAG_LABELS:
        raise ValueError(f"unknown label: {flag}")
    tag = f"label:{flag}"
    has = (F.col("tag") == tag) & (F.col("source") == "user")
    first = ids.orderBy("pos", "id").limit(1).select(F.col("id").alias("image_id"))
    if first.join(tags.where(has), "image_id", "left_semi").isEmpty():
        return curate.insert_ignore(tags, _rows(ids, tag, "user"), KEYS)
    return _without(tags, ids, has)


def set_favourite(tags: DataFrame, ids: DataFrame, on: bool) -> DataFrame:
    return curate.insert_ignore(tags, _rows(ids, "favorite", "fav"), KEYS) if on else _without(tags, ids, F.col("source") == "fav")


def set_notes(notes: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, note) with those of rows (id, note) in place of older ones; a blank note is null."""
    return curate.upsert(notes, rows.select("id", F.nullif(F.trim("note"), F.lit("")).alias("note")), ["id"])


def set_opened(opened: DataFrame, ids: DataFrame, when: float) -> DataFrame:
    return curate.upsert(opened, ids.select("id", F.lit(when).alias("opened_at")).distinct(), ["id"])


def marks(tags: DataFrame) -> DataFrame:
    """(image_id, label, flags, fav): the status, the other labels joined by commas, and whether it is a favourite."""
    name = F.substring("tag", 7, 100)
    by_user = (F.col("source") == "user") & F.col("tag").startswith("label:")
    found = tags.where(by_user | (F.col("source") == "fav"))
    return found.groupBy("image_id").agg(
        F.min(F.when(is_status(), name)).alias("label"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(by_user & ~is_status(), name))), ","), F.lit("")).alias("flags"),
        F.bool_or(F.col("source") == "fav").alias("fav"),
    )


def weights(tags: DataFrame, notes: DataFrame, quality: DataFrame) -> DataFrame:
    """(id, weight): how much work is in a file, as tags and favourites by hand, a note and a score."""
    parts = tags.where("source in ('user', 'fav')").select(F.col("image_id").alias("id"))
    parts = parts.union(notes.where("trim(note) <> ''").select("id")).union(quality.where("reward is not null").select("image_id"))
    return parts.groupBy("id").agg(F.count(F.lit(1)).alias("weight"))


def curated_ids(tags: DataFrame, notes: DataFrame, quality: DataFrame) -> DataFrame:
    return weights(tags, notes, quality).select("id")


def duplicate_sets(files: DataFrame, work: DataFrame) -> DataFrame:
    """(set_id, id, filename, size, weight, keep, n_dupes, recoverable) of all sets of copies of two files or more.

    Copies share name (ignoring case) and size and follow each other within a second; what has most work in it
    stays, then the oldest, then the smallest id. set_id is the id that stays.
    """
    name = F.lower("filename")
    runs = curate.gap_clusters(files.withColumn("name_key", name), ["name_key", "size"], F.col("mtime"), 1.0)
    runs = runs.join(work, "id", "left").withColumn("order", F.struct(-F.coalesce("weight", F.lit(0)), F.col("mtime"), F.col("id")))
    key = ["name_key", "size", "cluster"]
    sets = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("best")).where("n > 1")
    out = runs.join(sets, key).withColumn("set_id", F.col("best.id"))
    return out.select("set_id", "id", "filename", "size", F.coalesce("weight", F.lit(0)).alias("weight"), (F.col("id") == F.col("set_id")).alias("keep"), (F.col("n") - 1).alias("n_dupes"), ((F.col("n") - 1) * F.col("size")).alias("recoverable"))


def merge_curation(pairs: DataFrame, files: DataFrame, tags: DataFrame, notes: DataFrame, quality: DataFrame) -> dict[str, DataFrame]:
    """New tags, notes and quality in which each keeper has what its copies had; pairs are (keeper, doomed).

    Tags but labels are united; a keeper without a label gets that of its oldest copy; notes are joined, each
    once, the keeper's first, then by time; a keeper without a score gets that of the copy with the smallest id.
    Rows of the copies stay until they are deleted.
    """
    times = files.select(F.col("id").alias("doomed"), "mtime")
    copied = pairs.join(tags.select(F.col("image_id").alias("doomed"), "tag", "source", "score"), "doomed").join(times, "doomed")
    plain = copied.where(~F.col("tag").startswith("label:")).groupBy(F.col("keeper").alias("image_id"), "tag", "source").agg(F.min_by("score", "doomed").alias("score"))
    labelled = tags.where(F.col("tag").startswith("label:")).select(F.col("image_id").alias("keeper"))
    oldest = F.struct("mtime", "doomed", "tag")
    label = copied.where(F.col("tag").startswith("label:")).join(labelled, "keeper", "left_anti")
    label = label.groupBy(F.col("keeper").alias("image_id")).agg(F.min_by(F.struct("tag", "source", "score"), oldest).alias("x")).select("image_id", "x.*")
    new_tags = curate.insert_ignore(tags, plain.unionByName(label), KEYS)
    text = F.trim(F.coalesce("note", F.lit("")))
    own = pairs.select(F.col("keeper").alias("doomed")).distinct().select(F.col("doomed").alias("keeper"), "doomed", F.lit(0).alias("place"))
    said = own.union(pairs.select("keeper", "doomed", F.lit(1))).join(notes.select(F.col("id").alias("doomed"), text.alias("note")).where("note <> ''"), "doomed").join(times, "doomed")
    said = said.groupBy("keeper", "note").agg(F.min(F.struct("place", "mtime", "doomed")).alias("at"))
    joined = said.groupBy(F.col("keeper").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda x: x["note"]), vocab.NOTE_SEPARATOR).alias("note"))
    scored = quality.where("reward is not null")
    open_ = pairs.join(scored.select(F.col("image_id").alias("keeper")), "keeper", "left_anti")
    adopted = open_.join(scored.select(F.col("image_id").alias("doomed"), "reward"), "doomed").groupBy(F.col("keeper").alias("image_id")).agg(F.min_by("reward", "doomed").alias("reward"))
    return {"tags": new_tags, "notes": curate.upsert(notes.select("id", "note"), joined, ["id"]), "quality": curate.upsert(quality.select("image_id", "reward"), adopted, ["image_id"])}


# lists of files: collections are (collection_id, name, created_at), members (collection_id, image_id, added_at)


def create_collections(collections: DataFrame, names: DataFrame, now: float) -> DataFrame:
    """collections with the new ones of names (name): names differ by more than case, and their number is bounded."""
    cleaned = names.select(C.collection_name(F.col("name")).alias("name")).where("name <> ''").withColumn("key", F.lower("name"))
    fresh = cleaned.groupBy("key").agg(F.min("name").alias("name")).join(collections.select(F.lower("name").alias("key")), "key", "left_anti")
    held = collections.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("collection_id"), F.lit(0)).alias("top")).first()
    room = max(0, vocab.MAX_COLLECTIONS - held["n"])
    rows = fresh.orderBy("key").limit(room).agg(F.array_sort(F.collect_list(F.struct("key", "name"))).alias("rows")).select(F.posexplode("rows").alias("at", "row"))
    return collections.unionByName(rows.select((F.col("at") + held["top"] + 1).cast("long").alias("collection_id"), "row.name", F.lit(now).alias("created_at")))


def add_members(members: DataFrame, collections: DataFrame, rows: DataFrame, files: DataFrame, now: float) -> DataFrame:
    """members with those of rows (collection_id, image_id) whose list and file exist and that are not there yet."""
    known = rows.join(collections.select("collection_id"), "collection_id", "left_semi").join(files.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return curate.insert_ignore(members, known.select("collection_id", "image_id", F.lit(now).alias("added_at")), ["collection_id", "image_id"])


def remove_members(members: DataFrame, rows: DataFrame) -> DataFrame:
    return members.join(rows.select("collection_id", "image_id"), ["collection_id", "image_id"], "left_anti")


def rename_collection(collections: DataFrame, collection_id: int, name: str) -> DataFrame:
    """The list under its new name, unless that is blank or another's."""
    wanted = collections.select(C.collection_name(F.lit(name)).alias("name")).limit(1)
    taken = collections.where(F.col("collection_id") != collection_id).select(F.lower("name").alias("key"))
    free = wanted.where("name <> ''").withColumn("key", F.lower("name")).join(taken, "key", "left_anti").select(F.col("name").alias("new_name"), F.lit(collection_id).alias("collection_id"))
    return collections.join(free, "collection_id", "left").withColumn("name", F.coalesce("new_name", "name")).select(*collections.columns)


def delete_collection(collections: DataFrame, members: DataFrame, collection_id: int) -> tuple[DataFrame, DataFrame]:
    return collections.where(F.col("collection_id") != collection_id), members.where(F.col("collection_id") != collection_id)


def cull_plan(files: DataFrame, anchor_id: int, keep_role: str) -> DataFrame:
    """(group_id, id, keep): sets of the anchor's folder with the same roles as its set, of which one role stays.

    Sets that reach into another folder or hold a video are left alone. Raises where the anchor is in no set, or its
    set has the role never or more than once.
    """
    role = C.canonical_stage(F.coalesce(F.nullif("set_stage", F.lit("")), C.set_role(F.col("filename")), F.lit("unknown")))
    rows = files.where(F.col("group_id").isNotNull()).withColumn("role", role)
    shape = rows.groupBy("group_id", "role").agg(F.count(F.lit(1)).alias("n")).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("shape"))
    anchor = files.where(F.col("id") == anchor_id).select("root_id", "folder", "group_id")
    found = anchor.join(shape, "group_id", "left").select("root_id", "folder", "group_id", "shape").first()
    wanted = vocab.STAGE_ALIASES.get(keep_role.strip().lower(), keep_role.strip().lower())
    if found is None or found["group_id"] is None:
        raise ValueError("not part of a set")
    if {r["role"]: r["n"] for r in found["shape"]}.get(wanted, 0) != 1:
        raise ValueError("the set has that role never or more than once")
    here = (F.col("root_id") == found["root_id"]) & (F.col("folder") == found["folder"])
    candidates = rows.where(here).select("group_id").distinct()
    facts = rows.join(candidates, "group_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(here & ~C.is_kind(F.col("ext"), "video")).alias("inside"))
    same = facts.where("n > 1 and inside").join(shape, "group_id").where(F.col("shape") == F.array(*(F.struct(F.lit(r["role"]).alias("role"), F.lit(r["n"]).alias("n")) for r in found["shape"])))
    return rows.join(same.select("group_id"), "group_id", "left_semi").select("group_id", "id", (F.col("role") == wanted).alias("keep"))


def cull(plan: DataFrame, files: DataFrame, tags: DataFrame, notes: DataFrame, quality: DataFrame) -> dict[str, DataFrame]:
    """New files, tags, notes and quality after a plan (group_id or set_id, id, keep): what stays takes over what the others carry."""
    key = "group_id" if "group_id" in plan.columns else "set_id"
    pairs = plan.where("keep").select(key, F.col("id").alias("keeper")).join(plan.where("not keep").select(key, F.col("id").alias("doomed")), key).select("keeper", "doomed")
    merged = merge_curation(pairs, files, tags, notes, quality)
    gone = pairs.select("doomed").distinct()
    left = lambda t, column: t.join(gone.withColumnRenamed("doomed", column), column, "left_anti").select(*t.columns)
    return {"files": left(files, "id"), "tags": left(merged["tags"], "image_id"), "notes": left(merged["notes"], "id"), "quality": left(merged["quality"], "image_id")}


def largest_sets(sets: DataFrame, n: int) -> DataFrame:
    """The rows of the n duplicate sets that free most."""
    first = sets.where("keep").orderBy(F.desc("recoverable"), "filename", "set_id").limit(n).select("set_id")
    return sets.join(first, "set_id", "left_semi").select(*sets.columns)


def folder_copies(files: DataFrame, root_id: str, folder: str) -> DataFrame:
    """(keep_id, copy_id): copies elsewhere of the files of one folder; names count with their case."""
    inside = (F.col("root_id") == root_id) & (F.col("folder") == folder)
    return curate.band_pairs(files.where(inside), files.where(~F.coalesce(inside, F.lit(False))), ["filename", "size"], "mtime", 1.0, "id")
