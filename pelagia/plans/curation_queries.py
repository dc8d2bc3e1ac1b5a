"""Queries of curation, duplicates, groups and model families, each with the SQL that says what it returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.functions import vocab
from pelagia.operators import cull_runs, curate, curation, facets, grouping, store
from pelagia.operators.catalog import media_view, read
from pelagia.operators.filters import FilterSpec
from pelagia.operators import filters
from pelagia.plans import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str):
    """Registers a function under its name with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = text
        return function

    return register


def cat(select: str) -> str:
    return sql.CATALOG + select


def all_tags(files):
    """Tags by hand and by an extension, two status labels, two flags, favourites."""
    d, image = F.col("id"), F.col("id").alias("image_id")
    none = F.lit(None).cast("double").alias("score")
    parts = [
        files.where("model_name is not null").select(image, F.col("model_name").alias("tag"), F.lit("user").alias("source"), none),
        files.where("set_stage <> ''").select(image, F.lower("set_stage").alias("tag"), F.lit("ext:stage").alias("source"), (d % 7 / 8).cast("double").alias("score")),
        files.where("id % 11 = 0").select(image, F.when(d % 22 == 0, "label:publish").otherwise("label:explore").alias("tag"), F.lit("user").alias("source"), none),
        files.where("id % 8 = 3").select(image, F.lit("label:published").alias("tag"), F.lit("user").alias("source"), none),
        files.where("id % 12 = 3").select(image, F.lit("label:video").alias("tag"), F.lit("user").alias("source"), none),
        files.where("id % 13 = 0").select(image, F.lit("favorite").alias("tag"), F.lit("fav").alias("source"), none),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


TAGS = """, tags AS (
SELECT id AS image_id, model_name AS tag, 'user' AS source, cast(NULL AS double) AS score FROM files WHERE model_name IS NOT NULL
UNION ALL SELECT id, lower(set_stage), 'ext:stage', cast(id % 7 AS double) / 8 FROM files WHERE set_stage <> ''
UNION ALL SELECT id, CASE WHEN id % 22 = 0 THEN 'label:publish' ELSE 'label:explore' END, 'user', NULL FROM files WHERE id % 11 = 0
UNION ALL SELECT id, 'label:published', 'user', NULL FROM files WHERE id % 8 = 3
UNION ALL SELECT id, 'label:video', 'user', NULL FROM files WHERE id % 12 = 3
UNION ALL SELECT id, 'favorite', 'fav', NULL FROM files WHERE id % 13 = 0)"""
STATUS = "(source = 'user' AND tag IN ('label:publish', 'label:refine', 'label:explore'))"
NEW = "cast(NULL AS double)"


@query(cat(TAGS + f" SELECT * FROM tags UNION ALL SELECT id, 'de', 'user', {NEW} FROM files WHERE folder = 'gen/src1' AND NOT EXISTS (SELECT 1 FROM tags t WHERE t.image_id = id AND t.tag = 'de' AND t.source = 'user')"))
def tag_added(spark, sf_dir):
    files = media_view(spark, sf_dir)
    return curation.add_tag(all_tags(files), files.where("folder = 'gen/src1'"), " DE,")


@query(cat(TAGS + " SELECT * FROM tags WHERE NOT (tag = 'final' AND (source = 'user' OR starts_with(source, 'ext:')) AND image_id IN (SELECT id FROM files WHERE root_id = 'r1'))"))
def tag_removed(spark, sf_dir):
    files = media_view(spark, sf_dir)
    return curation.remove_tag(all_tags(files), files.where("root_id = 'r1'"), "Final")


@query(cat(TAGS + " SELECT count(*) FILTER (WHERE starts_with(source, 'ext:')) AS removed, 0::bigint AS added FROM tags"))
def machine_tags_cleared(spark, sf_dir):
    tags = all_tags(media_view(spark, sf_dir))
    return curation.changed(tags, curation.clear_tags(tags), curation.KEYS).select("removed", F.col("added").cast("long").alias("added"))


@query("SELECT doc_id AS image_id, max(quality) AS reward FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src2') GROUP BY doc_id")
def scores_cleared(spark, sf_dir):
    quality = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("image_id")).agg(F.max("quality").alias("reward"))
    return curation.clear_scores(quality, read(spark, sf_dir, "documents").where("source = 'src2'").select(F.col("doc_id").alias("id")))


@query(cat(TAGS + f" SELECT * FROM tags WHERE NOT ({STATUS} AND image_id % 2 = 0) UNION ALL SELECT id, 'label:refine', 'user', {NEW} FROM files WHERE id % 2 = 0"))
def status_set(spark, sf_dir):
    files = media_view(spark, sf_dir)
    return curation.set_label(all_tags(files), files.where("id % 2 = 0"), "Refine")


@query(cat(TAGS + f" SELECT image_id, tag, source FROM tags WHERE NOT ({STATUS} AND image_id % 33 = 0)"))
def status_cleared(spark, sf_dir):
    files = media_view(spark, sf_dir)
    return curation.set_label(all_tags(files), files.where("id % 33 = 0"), None).select(*curation.KEYS)


@query(cat(TAGS + f" SELECT * FROM tags WHERE NOT (tag = 'label:video' AND image_id % 3 = 0) UNION ALL SELECT id, 'label:published', 'user', {NEW} FROM files WHERE id % 3 = 1 AND id % 8 <> 3"))
def flags_toggled(spark, sf_dir):
    """The first file of each selection decides: 3 has the video flag, 1 isn't published."""
    files = media_view(spark, sf_dir)
    pos = F.when(F.col("id").isin(1, 3), -1).otherwise(F.col("id")).alias("pos")
    off = curation.toggle_flag(all_tags(files), files.where("id % 3 = 0").select("id", pos), "video")
    return curation.toggle_flag(off, files.where("id % 3 = 1").select("id", pos), "published")


@query(cat(TAGS + f" SELECT image_id, tag, source, score FROM tags WHERE NOT (source = 'fav' AND image_id % 2 = 0) UNION ALL SELECT id, 'favorite', 'fav', {NEW} FROM files WHERE id % 100 = 1 AND id % 13 <> 0"))
def favourites_set(spark, sf_dir):
    files = media_view(spark, sf_dir)
    off = curation.set_favourite(all_tags(files), files.where("id % 2 = 0"), False)
    return curation.set_favourite(off, files.where("id % 100 = 1"), True)


@query(cat(" SELECT id, CASE WHEN id % 5 <> 0 THEN note WHEN id % 10 = 0 THEN NULL ELSE 'Seen ' || folder END AS note FROM files"))
def notes_set(spark, sf_dir):
    files = media_view(spark, sf_dir)
    fresh = files.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, "  ").otherwise(F.concat(F.lit(" Seen "), "folder")).alias("note"))
    return curation.set_notes(files.select("id", "note"), fresh)


@query(cat(TAGS + f", m AS (SELECT image_id, min(CASE WHEN {STATUS} THEN substr(tag, 7) END) AS label, string_agg(CASE WHEN source = 'user' AND starts_with(tag, 'label:') AND NOT {STATUS} THEN substr(tag, 7) END, ',' ORDER BY tag) AS flags, bool_or(source = 'fav') AS fav FROM tags GROUP BY 1) SELECT id, label, flags, coalesce(fav, FALSE) AS fav, coalesce(trim(note) <> '', FALSE) AS has_note FROM files LEFT JOIN m ON image_id = id"))
def file_marks(spark, sf_dir):
    files = media_view(spark, sf_dir)
    marks = curation.marks(all_tags(files)).withColumnRenamed("image_id", "id")
    return files.join(marks, "id", "left").select("id", "label", "flags", F.coalesce("fav", F.lit(False)).alias("fav"), F.coalesce(F.trim("note") != "", F.lit(False)).alias("has_note"))


SHOWN = "(source = 'user' AND NOT starts_with(tag, 'label:') OR starts_with(source, 'ext:'))"


@query(cat(TAGS + f""", hit AS (SELECT id FROM files WHERE model_name = 'en'), labelled AS (SELECT id FROM hit WHERE id IN (SELECT image_id FROM tags WHERE tag = 'label:published')), liked AS (SELECT id FROM hit WHERE id IN (SELECT image_id FROM tags WHERE source = 'fav')), both_ AS (SELECT id FROM labelled WHERE id IN (SELECT id FROM liked))
SELECT 'tag' AS list, tag AS name, count(DISTINCT image_id) AS n, NOT bool_or(source = 'user') AS machine FROM tags WHERE {SHOWN} AND image_id IN (SELECT id FROM both_) GROUP BY tag
UNION ALL SELECT 'label', substr(tag, 7), count(DISTINCT image_id), FALSE FROM tags WHERE source = 'user' AND starts_with(tag, 'label:') AND image_id IN (SELECT id FROM liked) GROUP BY tag
UNION ALL SELECT 'fav', 'favorite', count(DISTINCT image_id), FALSE FROM tags WHERE source = 'fav' AND image_id IN (SELECT id FROM labelled)"""))
def mark_lists(spark, sf_dir):
    """Counts of tags, labels and favourites for a search; no list narrows itself."""
    files = media_view(spark, sf_dir)
    return facets.mark_lists(files, all_tags(files), FilterSpec(model="en", labels=("published",), fav=True))


@query(cat(TAGS + ", w AS (SELECT image_id AS id FROM tags WHERE source IN ('user', 'fav') UNION ALL SELECT id FROM files WHERE trim(note) <> '' UNION ALL SELECT id FROM files WHERE reward IS NOT NULL) SELECT id, count(*) AS weight FROM w GROUP BY id"))
def curation_weights(spark, sf_dir):
    files = media_view(spark, sf_dir)
    return curation.weights(all_tags(files), files.select("id", "note"), files.select(F.col("id").alias("image_id"), "reward"))


COPIES = ", copies AS (SELECT id, 'f' || cast(cast(floor(id / 60) AS bigint) % 3 AS varchar) AS folder, 'Shot_' || cast(id % 20 AS varchar) AS filename, 100 + id % 3 AS size, 1e9 + floor(id / 60) * 0.4 + floor(id / 300) * 10 AS mtime, reward FROM files)"


def copies(files):
    """Files that share names, sizes and times with others, in chains of less than a second."""
    d = F.col("id")
    return files.select("id", F.concat(F.lit("f"), (F.floor(d / 60) % 3).cast("string")).alias("folder"), F.concat(F.lit("Shot_"), (d % 20).cast("string")).alias("filename"), (F.lit(100) + d % 3).alias("size"), (F.lit(1e9) + F.floor(d / 60) * 0.4 + F.floor(d / 300) * 10).alias("mtime"), "reward", "note")


@query(cat(TAGS + COPIES + """, w AS (SELECT id, count(*) AS weight FROM (SELECT image_id AS id FROM tags WHERE source IN ('user', 'fav') UNION ALL SELECT id FROM files WHERE trim(note) <> '' UNION ALL SELECT id FROM files WHERE reward IS NOT NULL) GROUP BY id),
s AS (SELECT *, sum(step) OVER (PARTITION BY lower(filename), size ORDER BY mtime, id) AS run FROM (SELECT *, CASE WHEN mtime - lag(mtime) OVER (PARTITION BY lower(filename), size ORDER BY mtime, id) >= 1 THEN 1 ELSE 0 END AS step FROM copies)),
r AS (SELECT *, count(*) OVER g AS n, first_value(id) OVER (PARTITION BY lower(filename), size, run ORDER BY -coalesce(weight, 0), mtime, id) AS set_id FROM s LEFT JOIN w USING (id) WINDOW g AS (PARTITION BY lower(filename), size, run))
SELECT set_id, id, filename, size, coalesce(weight, 0) AS weight, id = set_id AS keep, n - 1 AS n_dupes, (n - 1) * size AS recoverable FROM r WHERE n > 1"""))
def duplicate_keepers(spark, sf_dir):
    files = media_view(spark, sf_dir)
    work = curation.weights(all_tags(files), files.select("id", "note"), files.select(F.col("id").alias("image_id"), "reward"))
    return curation.duplicate_sets(copies(files).drop("note"), work)


PAIRS = ", pairs AS (SELECT id - id % 4 AS keeper, id AS doomed FROM files WHERE id % 4 <> 0)"
UNITED = f""", plain AS (SELECT keeper AS image_id, tag, source, arg_min(score, doomed) AS score FROM pairs JOIN tags ON image_id = doomed WHERE NOT starts_with(tag, 'label:') GROUP BY ALL),
adopted AS (SELECT keeper AS image_id, tag, source, score FROM (SELECT keeper, tag, source, score, row_number() OVER (PARTITION BY keeper ORDER BY mtime, doomed, tag) AS place FROM pairs JOIN tags ON image_id = doomed JOIN files ON id = doomed WHERE starts_with(tag, 'label:') AND keeper NOT IN (SELECT image_id FROM tags WHERE starts_with(tag, 'label:'))) WHERE place = 1),
extra AS (SELECT * FROM plain UNION ALL SELECT * FROM adopted)"""
NOTES = f", said AS (SELECT keeper, note, min(place) AS place FROM (SELECT keeper, trim(note) AS note, (1, mtime, doomed) AS place FROM pairs JOIN files ON id = doomed UNION ALL SELECT DISTINCT keeper, trim(note), (0, mtime, keeper) FROM pairs JOIN files ON id = keeper) WHERE note <> '' GROUP BY ALL), merged AS (SELECT keeper AS id, string_agg(note, '{vocab.NOTE_SEPARATOR}' ORDER BY place) AS note FROM said GROUP BY keeper)"
SCORED = ", scored AS (SELECT keeper AS id, arg_min(reward, doomed) AS reward FROM pairs JOIN files f ON f.id = doomed WHERE f.reward IS NOT NULL AND keeper NOT IN (SELECT id FROM files WHERE reward IS NOT NULL) GROUP BY keeper)"


@query(cat(TAGS + PAIRS + UNITED + NOTES + SCORED + """ SELECT 'tag' AS part, image_id AS id, tag || '|' || source AS value, score FROM tags UNION ALL SELECT 'tag', image_id, tag || '|' || source, score FROM extra e WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.image_id = e.image_id AND t.tag = e.tag AND t.source = e.source)
UNION ALL SELECT 'note', id, coalesce(m.note, f.note), NULL FROM files f LEFT JOIN merged m USING (id) UNION ALL SELECT 'note', id, note, NULL FROM merged WHERE id NOT IN (SELECT id FROM files)
UNION ALL SELECT 'score', id, NULL, coalesce(f.reward, s.reward) FROM files f LEFT JOIN scored s USING (id) WHERE f.reward IS NOT NULL OR s.reward IS NOT NULL UNION ALL SELECT 'score', id, NULL, reward FROM scored WHERE id NOT IN (SELECT id FROM files)"""))
def merge_curation(spark, sf_dir):
    """All that three copies of each fourth file carry, moved to it: tags, label, notes and score."""
    files = media_view(spark, sf_dir)
    pairs = files.where("id % 4 <> 0").select((F.col("id") - F.col("id") % 4).alias("keeper"), F.col("id").alias("doomed"))
    quality = files.where("reward is not null").select(F.col("id").alias("image_id"), F.col("reward").cast("double").alias("reward"))
    out = curation.merge_curation(pairs, files, all_tags(files), files.select("id", "note"), quality)
    tags = out["tags"].select(F.lit("tag").alias("part"), F.col("image_id").alias("id"), F.concat_ws("|", "tag", "source").alias("value"), "score")
    notes = out["notes"].select(F.lit("note").alias("part"), "id", F.col("note").alias("value"), F.lit(None).cast("double").alias("score"))
    scores = out["quality"].select(F.lit("score").alias("part"), F.col("image_id").alias("id"), F.lit(None).cast("string").alias("value"), F.col("reward").alias("score"))
    return tags.union(notes).union(scores)


LISTS = ", lists AS (SELECT conv_id AS collection_id, 'List ' || cast(conv_id AS varchar) AS name, 1.0::double AS created_at FROM conversations WHERE conv_id < 50 GROUP BY conv_id), held AS (SELECT DISTINCT conv_id AS collection_id, conv_id * 2 + turn AS image_id, 1.0::double AS added_at FROM conversations)"


def lists(spark, sf_dir):
    talks = read(spark, sf_dir, "conversations")
    named = talks.where("conv_id < 50").select(F.col("conv_id").alias("collection_id")).distinct().select("collection_id", F.concat(F.lit("List "), F.col("collection_id").cast("string")).alias("name"), F.lit(1.0).alias("created_at"))
    members = talks.select(F.col("conv_id").alias("collection_id"), (F.col("conv_id") * 2 + F.col("turn")).alias("image_id"), F.lit(1.0).alias("added_at")).distinct()
    return named, members


@query(cat(LISTS + ", fresh AS (SELECT min(name) AS name, lower(name) AS k FROM (SELECT substr('list ' || lang || ' new', 1, 40) AS name FROM documents UNION ALL SELECT 'LIST 1') WHERE lower(name) NOT IN (SELECT lower(name) FROM lists) GROUP BY lower(name)) SELECT collection_id, name, created_at FROM lists UNION ALL SELECT (SELECT coalesce(max(collection_id), 0) FROM lists) + row_number() OVER (ORDER BY k), name, 2.0 FROM fresh"))
def lists_created(spark, sf_dir):
    collections, _ = lists(spark, sf_dir)
    names = read(spark, sf_dir, "documents").select(F.concat(F.lit(" list  "), "lang", F.lit(" new ")).alias("name")).distinct()
    return curation.create_collections(collections, names.union(names.limit(1).select(F.lit("LIST 1"))), 2.0)


@query(cat(LISTS + " SELECT collection_id, image_id, added_at FROM held WHERE image_id % 10 <> 4 UNION ALL SELECT l.collection_id, f.id, 2.0 FROM lists l JOIN files f ON f.id % 50 = l.collection_id WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.collection_id = l.collection_id AND h.image_id = f.id AND h.image_id % 10 <> 4)"))
def list_members_changed(spark, sf_dir):
    collections, members = lists(spark, sf_dir)
    files = media_view(spark, sf_dir)
    left = curation.remove_members(members, members.where("image_id % 10 = 4"))
    rows = files.select((F.col("id") % 50).alias("collection_id"), F.col("id").alias("image_id"))
    return curation.add_members(left, collections, rows, files, 2.0)


@query(cat(LISTS + " SELECT l.collection_id, CASE WHEN l.collection_id = 1 THEN 'Best of 1' ELSE name END AS name, count(image_id) AS n FROM lists l LEFT JOIN held h ON h.collection_id = l.collection_id WHERE l.collection_id <> 3 GROUP BY 1, 2"))
def list_renamed_and_deleted(spark, sf_dir):
    collections, members = lists(spark, sf_dir)
    renamed = curation.rename_collection(collections, 1, " Best  of 1")
    renamed = curation.rename_collection(renamed, 2, "LIST 4")  # another's name: nothing changes
    left, members = curation.delete_collection(renamed, members, 3)
    counts = members.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    return left.join(counts, "collection_id", "left").select("collection_id", "name", F.coalesce("n", F.lit(0)).alias("n"))


ROLE = "coalesce(CASE lower(set_stage) WHEN '' THEN NULL WHEN 'main' THEN 'raw' WHEN 'det' THEN 'detail' ELSE lower(set_stage) END, CASE WHEN regexp_matches(lower(filename), '[ ._-]refine[ ._-]') THEN 'refine' WHEN regexp_matches(lower(filename), '[ ._-]det[ ._-]') THEN 'detail' END, 'unknown')"


@query(cat(f", g AS (SELECT *, {ROLE} AS role, 'g' || cast(floor(id / 20) AS bigint) AS gid FROM (SELECT * EXCLUDE (folder), 'all' AS folder FROM files) WHERE id % 5 IN (0, 1, 3)), s AS (SELECT gid, string_agg(role, ',' ORDER BY role) AS shape, count(*) AS n, bool_and(root_id = 'r0' AND NOT {sql.VIDEO}) AS inside FROM g WHERE root_id = 'r0' GROUP BY gid) SELECT g.gid AS group_id, id, role = 'final' AS keep FROM g JOIN s USING (gid) WHERE root_id = 'r0' AND n > 1 AND inside AND shape = (SELECT shape FROM s WHERE gid = (SELECT min(gid) FROM s WHERE length(shape) - length(replace(shape, 'final', '')) = 5 AND inside AND n > 1))"))
def set_cull(spark, sf_dir):
    """One set's choice, the final image, repeated over the sets of its folder that have the same roles."""
    files = media_view(spark, sf_dir).where("id % 5 in (0, 1, 3) and root_id = 'r0'").withColumn("folder", F.lit("all"))
    files = files.withColumn("group_id", F.concat(F.lit("g"), F.floor(F.col("id") / 20).cast("string")))
    role = C.canonical_stage(F.coalesce(F.nullif("set_stage", F.lit("")), C.set_role(F.col("filename")), F.lit("unknown")))
    sets = files.groupBy("group_id").agg(F.count_if(role == "final").alias("finals"), F.count(F.lit(1)).alias("n"), F.bool_or(C.is_kind(F.col("ext"), "video")).alias("video"), F.min("id").alias("id"))
    anchor = sets.where("finals = 1 and n > 1 and not video").agg(F.min_by("id", "group_id").alias("id")).first()["id"]
    return curation.cull_plan(files, anchor, "Final")


DUPLICATES = """, w AS (SELECT id, count(*) AS weight FROM (SELECT image_id AS id FROM tags WHERE source IN ('user', 'fav') UNION ALL SELECT id FROM files WHERE trim(note) <> '' UNION ALL SELECT id FROM files WHERE reward IS NOT NULL) GROUP BY id),
s AS (SELECT *, sum(step) OVER (PARTITION BY lower(filename), size ORDER BY mtime, id) AS run FROM (SELECT *, CASE WHEN mtime - lag(mtime) OVER (PARTITION BY lower(filename), size ORDER BY mtime, id) >= 1 THEN 1 ELSE 0 END AS step FROM copies)),
owned AS (SELECT c.*, f.note FROM copies c JOIN files f USING (id)),
pairs AS (SELECT set_id AS keeper, id AS doomed FROM (SELECT id, size, first_value(id) OVER (PARTITION BY lower(filename), size, run ORDER BY -coalesce(weight, 0), mtime, id) AS set_id FROM s LEFT JOIN w USING (id)) WHERE id <> set_id AND size <> 101)"""
CULLED = "".join(x.replace(" files", " owned") for x in (UNITED, NOTES, SCORED))


@query(cat(TAGS + COPIES + DUPLICATES + CULLED + """ SELECT part, id, value, score FROM (SELECT 'file' AS part, id, NULL AS value, NULL AS score FROM owned
UNION ALL SELECT 'tag', image_id, tag || '|' || source, score FROM tags UNION ALL SELECT 'tag', image_id, tag || '|' || source, score FROM extra e WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.image_id = e.image_id AND t.tag = e.tag AND t.source = e.source)
UNION ALL SELECT 'note', id, coalesce(m.note, o.note), NULL FROM owned o LEFT JOIN merged m USING (id)
UNION ALL SELECT 'score', id, NULL, coalesce(o.reward, s.reward) FROM owned o LEFT JOIN scored s USING (id) WHERE o.reward IS NOT NULL OR s.reward IS NOT NULL) WHERE id NOT IN (SELECT doomed FROM pairs)"""))
def cull_in_steps(spark, sf_dir):
    """All sets of copies culled in four batches, stopped half-way and resumed; those of one size are taken back."""
    files = media_view(spark, sf_dir)
    quality = files.where("reward is not null").select(F.col("id").alias("image_id"), F.col("reward").cast("double").alias("reward"))
    tables = {"files": copies(files), "tags": all_tags(files), "notes": files.select("id", "note"), "quality": quality}
    sets = curation.duplicate_sets(tables["files"].drop("note"), curation.weights(tables["tags"], tables["notes"], quality))
    folder, asked = store.shared_dir(spark, "cull-run"), iter((False, False, True))
    cull_runs.start(spark, folder, sets, 4)
    cull_runs.run(spark, folder, tables, lambda: next(asked))
    cull_runs.run(spark, folder, tables)
    cull_runs.undo(spark, folder, sets.where("keep and size = 101").select(F.col("set_id").alias("set")))
    out, nothing, none = cull_runs.result(spark, folder, tables), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("score")
    rows = out["files"].select(F.lit("file").alias("part"), "id", nothing, none)
    rows = rows.union(out["tags"].select(F.lit("tag"), F.col("image_id"), F.concat_ws("|", "tag", "source"), F.col("score")))
    rows = rows.union(out["notes"].select(F.lit("note"), F.col("id"), F.col("note"), none))
    return rows.union(out["quality"].select(F.lit("score"), F.col("image_id"), nothing, F.col("reward")))


@query(cat(COPIES + " SELECT a.id AS keep_id, b.id AS copy_id FROM copies a JOIN copies b ON a.filename = b.filename AND a.size = b.size AND abs(a.mtime - b.mtime) < 1 AND a.id <> b.id AND b.folder <> 'f1' WHERE a.folder = 'f1'"))
def folder_copies(spark, sf_dir):
    return curation.folder_copies(copies(media_view(spark, sf_dir)).withColumn("root_id", F.lit("r")), "r", "f1")


def named_files(files):
    """Files under names as generators write them: run codes, roles, pairs and set ids."""
    d = F.col("id")
    of = lambda n: F.floor(d / n).cast("string")
    name = (
        F.when(d % 40 < 4, F.concat(F.lit("Run "), of(40), F.lit("~VV00ab"), F.lpad((F.floor(d / 40) % 36).cast("string"), 2, "0"), F.lit("_"), (d % 4).cast("string")))
        .when(d % 40 < 8, F.concat(F.lit("clip_"), of(40), F.when(d % 2 == 0, "_BASE_00001").otherwise("-interp.00001")))
        .when(d % 40 < 12, F.concat(F.lit("pic"), d.cast("string")))
        .when(d % 40 < 24, F.concat(F.lit("set "), of(40), F.lit("_"), F.get(F.array(*map(F.lit, ("1 MAIN", "2 DET", "3 refine"))), (d % 3).cast("int")), F.lit("_0007")))
        .otherwise(F.concat(F.lit("lone_"), d.cast("string")))
    )
    ext = F.when((d % 40).isin(5, 7, 13), ".mp4").otherwise(".png")
    set_id = F.when((d % 40 >= 8) & (d % 40 < 13), F.concat(F.lit("s"), of(80)))
    return files.select("id", "root_id", "folder", F.concat(name, ext).alias("filename"), ext.alias("ext"), set_id.alias("set_id"))


NAMED = """, named AS (SELECT id, root_id, folder, n || e AS filename, e AS ext, sid AS set_id FROM (SELECT id, root_id, folder,
CASE WHEN id % 40 < 4 THEN 'Run ' || w || '~VV00ab' || lpad(cast(cast(w AS bigint) % 36 AS varchar), 2, '0') || '_' || cast(id % 4 AS varchar)
  WHEN id % 40 < 8 THEN 'clip_' || w || CASE WHEN id % 2 = 0 THEN '_BASE_00001' ELSE '-interp.00001' END
  WHEN id % 40 < 12 THEN 'pic' || cast(id AS varchar)
  WHEN id % 40 < 24 THEN 'set ' || w || '_' || list_value('1 MAIN', '2 DET', '3 refine')[id % 3 + 1] || '_0007'
  ELSE 'lone_' || cast(id AS varchar) END AS n,
CASE WHEN id % 40 IN (5, 7, 13) THEN '.mp4' ELSE '.png' END AS e, CASE WHEN id % 40 BETWEEN 8 AND 12 THEN 's' || cast(cast(floor(id / 80) AS bigint) AS varchar) END AS sid
FROM (SELECT *, cast(cast(floor(id / 40) AS bigint) AS varchar) AS w FROM files)))"""
PARTS = r"list_filter(regexp_split_to_array(lower(regexp_replace(filename, '\.[^.]*$', '')), '[\s._-]+'), lambda x: x <> '')"
REGROUPED = f"""{NAMED}, p AS (SELECT *, {PARTS} AS parts FROM named),
k0 AS (SELECT *, nullif(lower(regexp_extract(filename, '^(.*?~[vV][vV][0-9a-z]{{4,10}})', 1)), '') AS code FROM p),
g0 AS (SELECT *, CASE WHEN code IS NOT NULL AND count(*) OVER (PARTITION BY root_id, code) >= 2 THEN substr(sha1('vvrun|' || root_id || '|' || code), 1, 12) END AS a FROM k0),
k1 AS (SELECT *, array_to_string(list_filter(parts, lambda x: x NOT IN ('base', 'interp', 'audio')), '_') AS pair FROM g0),
p1 AS (SELECT root_id, folder, pair FROM k1 WHERE a IS NULL GROUP BY ALL HAVING bool_or(ext = '.png') AND bool_or(ext = '.mp4')),
g1 AS (SELECT k1.*, CASE WHEN a IS NULL AND (root_id, folder, pair) IN (SELECT (root_id, folder, pair) FROM p1) THEN substr(sha1(root_id || '|' || folder || '|' || pair), 1, 12) END AS b FROM k1),
p2 AS (SELECT root_id, set_id FROM g1 WHERE a IS NULL AND b IS NULL AND set_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
g2 AS (SELECT g1.*, CASE WHEN a IS NULL AND b IS NULL AND (root_id, set_id) IN (SELECT (root_id, set_id) FROM p2) THEN substr(sha1('vvset|' || root_id || '|' || set_id), 1, 12) END AS c FROM g1),
k3 AS (SELECT *, list_filter(parts, lambda x: x IN ('main', 'det', 'refine'))[1] AS role, regexp_replace(array_to_string(parts, '_'), '(_[0-9]{{1,2}})?_(main|det|refine)', '', 'g') AS base FROM g2),
p3 AS (SELECT root_id, folder, base FROM k3 WHERE a IS NULL AND b IS NULL AND c IS NULL AND ext = '.png' AND role IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT role) >= 2)
SELECT id, coalesce(a, b, c, CASE WHEN ext = '.png' AND role IS NOT NULL AND (root_id, folder, base) IN (SELECT (root_id, folder, base) FROM p3) THEN substr(sha1('set|' || root_id || '|' || folder || '|' || base), 1, 12) END) AS group_id FROM k3"""


@query(cat(REGROUPED))
def regroup(spark, sf_dir):
    return grouping.regroup(named_files(media_view(spark, sf_dir)))


FOLDER = "CASE WHEN contains(replace(model, '\\', '/'), '/') THEN trim(regexp_replace(split_part(replace(model, '\\', '/'), '/', 1), '(?i)[ _-]+v?[0-9]+([._][0-9]+)*\\s*$', '')) ELSE '' END"
TYPES = f""", m AS (SELECT id, {FOLDER} AS folder_family, regexp_extract(model, '([^/\\\\]*)\\.[^.]*$', 1) AS stem FROM files WHERE model IS NOT NULL),
v AS (SELECT lower(folder_family) AS k, arg_min(folder_family, (-n, folder_family)) AS spelling FROM (SELECT folder_family, count(*) AS n FROM m WHERE folder_family <> '' GROUP BY 1) GROUP BY 1),
hints AS (SELECT unnest(['pony', 'illustrious', 'flux', 'sdxl', 'krea', 'wan', 'ltx', 'minimax', 'noobai', 'animagine', 'qwen', 'hunyuan']) AS k),
voc AS (SELECT k, spelling FROM v UNION ALL SELECT k, k FROM hints WHERE k NOT IN (SELECT k FROM v)),
shown AS (SELECT x.k, coalesce(y.spelling, x.spelling) AS spelling FROM voc x LEFT JOIN voc y ON y.k = regexp_replace(x.k, '([ _-]|[0-9]+|xl)+$', '') AND y.k <> x.k AND y.k <> 'sd'),
hit AS (SELECT id, k, length(k) AS n, instr(lower(stem), k) AS spot, stem FROM m, voc WHERE folder_family = '' AND instr(lower(stem), k) > 0),
best AS (SELECT id, arg_max(k, n) AS k FROM hit WHERE spot = 1 OR NOT regexp_matches(substr(stem, spot - 1, 1), '[A-Za-z]') OR (regexp_matches(substr(stem, spot - 1, 1), '[a-z]') AND regexp_matches(substr(stem, spot, 1), '[A-Z]')) GROUP BY id)
SELECT m.id, CASE WHEN folder_family <> '' THEN coalesce(f.spelling, folder_family) ELSE coalesce(b.spelling, '') END AS model_type FROM m LEFT JOIN shown f ON f.k = lower(folder_family) LEFT JOIN best ON best.id = m.id LEFT JOIN shown b ON b.k = best.k"""


@query(cat(TYPES))
def model_types(spark, sf_dir):
    return grouping.model_types(media_view(spark, sf_dir))
