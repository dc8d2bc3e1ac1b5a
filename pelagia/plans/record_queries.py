"""Queries of records, settings texts, graphs and ingest, each with the SQL that says what it returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.functions import columns as C
from pelagia.functions import settings_text
from pelagia.operators import cards, curation, extensions, facets, ingest, records, workflow
from pelagia.operators.catalog import media_view, read
from pelagia.operators.filters import FilterSpec
from pelagia.plans import sql
from pelagia.plans.curation_queries import COPIES, TAGS, all_tags, copies

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


def facts():
    """Generation facts of the catalog view: all of them, or some, by the id."""
    d = F.col("id")
    loras = F.when(d % 3 == 0, F.array(F.struct(F.lit("style").alias("name"), F.lit(0.5).alias("strength")), F.struct(F.concat(F.lit("l"), (d % 5).cast("string")).alias("name"), F.lit(1.0).alias("strength")))).otherwise(F.array().cast(settings_text.LORAS))
    return F.struct(
        F.trim(F.regexp_replace("positive", r"\s+", " ")).alias("positive"), F.when(d % 4 == 1, F.concat(F.lit("bad "), "folder")).alias("negative"), F.col("model_name"), F.lit(None).cast("string").alias("vae_name"), loras.alias("loras"),
        (d % 30 + 10).cast("int").alias("steps"), ((d % 15) / 2).alias("cfg"), F.when(d % 2 == 0, "dpmpp_2m").otherwise("my_sampler").alias("sampler_name"), F.when(d % 7 == 0, "karras").alias("scheduler"), (d * 7919).cast("decimal(20,0)").alias("seed"),
    )


PLAIN = r"trim(regexp_replace(positive, '\s+', ' ', 'g'))"
BLOCK = f"""concat_ws(chr(10), trim({PLAIN} || CASE WHEN id % 3 = 0 THEN ' <lora:style:0.5> <lora:l' || cast(id % 5 AS varchar) || ':1>' ELSE '' END), CASE WHEN id % 4 = 1 THEN 'Negative prompt: bad ' || folder END,
concat_ws(', ', 'Steps: ' || cast(id % 30 + 10 AS varchar), 'Sampler: ' || CASE WHEN id % 2 = 0 THEN 'DPM++ 2M' ELSE 'my_sampler' END || CASE WHEN id % 7 = 0 THEN ' Karras' ELSE '' END, 'CFG scale: ' || CASE WHEN id % 15 % 2 = 0 THEN cast((id % 15) // 2 AS varchar) ELSE cast((id % 15) / 2 AS varchar) END,
'Seed: ' || cast(id * 7919 AS varchar), 'Size: ' || cast(width AS varchar) || 'x' || cast(height AS varchar), 'Model: ' || model_name))"""


@query(cat(f"SELECT id, {BLOCK} AS parameters FROM files"))
def export_parameters(spark, sf_dir):
    return media_view(spark, sf_dir).select("id", settings_text.format_block(facts(), F.col("width"), F.col("height")).alias("parameters"))


@query(cat(f"SELECT id, nullif({PLAIN}, '') AS positive, CASE WHEN id % 4 = 1 THEN 'bad ' || folder END AS negative, model_name, CASE WHEN id % 3 = 0 THEN 'style:0.5,l' || cast(id % 5 AS varchar) || ':1.0' ELSE '' END AS loras, cast(id % 30 + 10 AS int) AS steps, (id % 15) / 2 AS cfg, CASE WHEN id % 2 = 0 THEN 'DPM++ 2M' ELSE 'my_sampler' END AS sampler_name, CASE WHEN id % 7 = 0 THEN 'karras' END AS scheduler, cast(id * 7919 AS varchar) AS seed FROM files"))
def read_parameters(spark, sf_dir):
    """The facts come back from the text that they were written as."""
    rows = media_view(spark, sf_dir).select("id", settings_text.settings_of(settings_text.format_block(facts(), F.col("width"), F.col("height"))).alias("f"))
    loras = F.array_join(F.transform("f.loras", lambda x: F.concat_ws(":", x["name"], x["strength"].cast("string"))), ",")
    return rows.select("id", "f.positive", "f.negative", "f.model_name", loras.alias("loras"), "f.steps", "f.cfg", "f.sampler_name", "f.scheduler", F.col("f.seed").cast("string").alias("seed"))


@query(cat(f"SELECT id, concat_ws(chr(10), 'Prompt: ' || nullif({PLAIN}, ''), CASE WHEN id % 4 = 1 THEN 'Negative: bad ' || folder END, 'Model: ' || model_name, CASE WHEN id % 3 = 0 THEN 'LoRAs: style (0.5), l' || cast(id % 5 AS varchar) || ' (1)' END, 'Steps: ' || cast(id % 30 + 10 AS varchar), 'CFG: ' || CASE WHEN id % 15 % 2 = 0 THEN cast((id % 15) // 2 AS varchar) ELSE cast((id % 15) / 2 AS varchar) END, 'Sampler: ' || CASE WHEN id % 2 = 0 THEN 'dpmpp_2m' ELSE 'my_sampler' END, CASE WHEN id % 7 = 0 THEN 'Scheduler: karras' END, 'Seed: ' || cast(id * 7919 AS varchar)) AS lines FROM files"))
def readable_parameters(spark, sf_dir):
    return media_view(spark, sf_dir).select("id", settings_text.readable_block(facts()).alias("lines"))


def workflows(files):
    """A workflow for each file: two stages of sampling, a switch of texts, a relay, a stack of adapters, two savers."""
    d = F.col("id")
    text = F.to_json(F.struct(F.col("positive").alias("text1"), F.concat(F.lit("other "), "folder").alias("text2")))
    node = lambda key, kind, inputs: F.concat(F.lit(f'"{key}":{{"class_type":"{kind}","inputs":'), inputs if not isinstance(inputs, str) else F.lit(inputs), F.lit("}"))
    switch = F.concat(F.lit('{"Input":'), (d % 2 + 1).cast("string"), F.lit(","), F.substring(text, 2, 1 << 30))
    first = F.concat(F.lit('{"model":["5",0],"positive":["3",0],"negative":["4",0],"latent_image":["9",0],"steps":["13",0],"cfg":["13",1],"sampler_name":["13",2],"scheduler":"karras","seed":'), (d * 7919).cast("string"), F.lit("}"))
    knobs = F.concat(F.lit('{"a":'), (d % 30 + 10).cast("string"), F.lit(',"b":'), ((d % 15) / 2).cast("string"), F.lit(',"c":"euler"}'))
    stack = F.concat(F.lit('{"model":["6",0],"stack_data":"[{\\"lora\\":\\"x/style.safetensors\\",\\"str\\":0.5,\\"on\\":'), F.when(d % 3 == 0, "true").otherwise("false"), F.lit('}]"}'))
    nodes = [
        node(1, "CR Text Input Switch", switch), node(2, "Reroute", '{"input":["1",0]}'), node(3, "CLIPTextEncode", '{"text":["2",0],"clip":["6",1]}'), node(4, "ConditioningZeroOut", '{"conditioning":["3",0]}'),
        node(5, "LoraStack", stack), node(6, "CheckpointLoaderSimple", F.concat(F.lit('{"ckpt_name":"m/base_'), (d % 4).cast("string"), F.lit('.safetensors"}'))), node(7, "KSampler", first), node(8, "CLIPTextEncode", '{"text":"second stage"}'),
        node(9, "EmptyLatentImage", '{"width":512}'), node(10, "VAEDecode", '{"samples":["7",0],"vae":["14",0]}'), node(11, "SaveImage", '{"images":["10",0],"filename_prefix":"shot_"}'), node(12, "KSampler", '{"model":["6",0],"positive":["8",0],"negative":["4",0],"latent_image":["7",0],"steps":4,"seed":1}'),
        node(13, "KSampler Config", knobs), node(14, "VAELoader", '{"vae_name":"v/fine.pt"}'), node(15, "VAEDecode", '{"samples":["12",0],"vae":["6",2]}'), node(16, "SaveImage", '{"images":["15",0],"filename_prefix":"later"}'),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *nodes), F.lit("}"))


@query(cat("SELECT id, nullif(CASE WHEN id % 2 = 0 THEN positive ELSE 'other ' || folder END, '') AS positive, cast(NULL AS varchar) AS negative, 'base_' || cast(id % 4 AS varchar) AS model_name, 'fine' AS vae_name, CASE WHEN id % 3 = 0 THEN 'style:0.5' ELSE '' END AS loras, cast(id % 30 + 10 AS int) AS steps, (id % 15) / 2 AS cfg, 'euler' AS sampler_name, 'karras' AS scheduler, cast(id * 7919 AS varchar) AS seed, 'saver-walk' AS method FROM files WHERE trim(positive) <> ''"))
def read_workflows(spark, sf_dir):
    """What each file's workflow says: its own saver's sampler, decoder and model, and the first stage's settings."""
    files = media_view(spark, sf_dir).where("trim(positive) <> ''")
    asked = files.select("id", workflows(files).alias("graph"), "filename", F.lit(None).cast("string").alias("stage"))
    rows = workflow.facts(asked, "id").select("id", F.struct(*workflow.FACTS).alias("f"))
    loras = F.array_join(F.transform("f.loras", lambda x: F.concat_ws(":", x["name"], x["strength"].cast("string"))), ",")
    return rows.select("id", "f.positive", "f.negative", "f.model_name", "f.vae_name", loras.alias("loras"), "f.steps", "f.cfg", "f.sampler_name", "f.scheduler", F.col("f.seed").cast("string").alias("seed"), "f.method")


SCAN = """, stored AS (SELECT id, folder || '/' || cast(id AS varchar) || filename AS path, folder, ext, mtime, size, CASE WHEN ext = '.mp4' AND id % 2 = 0 THEN NULL ELSE width END AS width FROM files WHERE id % 9 <> 0),
walked AS (SELECT folder || '/' || cast(id AS varchar) || filename AS path, CASE WHEN id % 13 = 0 THEN mtime + 5 ELSE mtime END AS mtime, size, id % 50 = 7 AS bad FROM files WHERE id % 8 <> 0),
st AS (SELECT coalesce(s.path, w.path) AS path, w.bad, CASE WHEN s.path IS NULL THEN 'new' WHEN w.path IS NULL THEN 'gone' WHEN s.mtime = w.mtime AND NOT (ext = '.mp4' AND width IS NULL) THEN 'unchanged' ELSE 'changed' END AS state FROM stored s FULL OUTER JOIN walked w ON s.path = w.path)"""


@query(cat(SCAN + " SELECT state, count(*) AS n FROM st GROUP BY state UNION ALL SELECT 'failed', count(*) FROM st WHERE bad AND state IN ('new', 'changed') HAVING count(*) > 0 UNION ALL SELECT 'rows', (SELECT count(*) FROM st WHERE state IN ('unchanged', 'changed')) + (SELECT count(*) FROM st WHERE state = 'new' AND NOT bad)"))
def ingest_scan(spark, sf_dir):
    """A full walk against the catalog: states, failures, and the rows that the new catalog has."""
    files = media_view(spark, sf_dir).withColumn("path", F.concat("folder", F.lit("/"), F.col("id").cast("string"), "filename")).withColumn("duration", F.lit(1.0))
    columns = ["path", "folder", "filename", "ext", "mtime", "size", "width", "duration"]
    blank = F.when((F.col("ext") == ".mp4") & (F.col("id") % 2 == 0), F.lit(None)).otherwise(F.col("width"))
    stored = files.where("id % 9 <> 0").withColumn("width", blank).select(*columns)
    walked = files.where("id % 8 <> 0").select("path", "folder", "filename", "ext", F.when(F.col("id") % 13 == 0, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"), "size", "width", "duration", (F.col("id") % 50 == 7).alias("bad"))
    done = ingest.scan(stored, walked, lambda todo: todo.withColumn("error", F.when(F.col("bad"), "damaged")).drop("bad"))
    return done.counters().union(done.files.agg(F.lit("rows").alias("state"), F.count(F.lit(1)).alias("n")))


@query(cat(SCAN + """, top AS (SELECT max(id) AS last FROM stored), news AS (SELECT count(*) AS n FROM st WHERE state = 'new' AND NOT bad)
SELECT f.id, f.root_id, f.group_id, f.shuffle_key, f.mtime + CASE WHEN st.state = 'changed' AND NOT st.bad AND f.id % 13 = 0 THEN 5 ELSE 0 END AS mtime, CASE WHEN st.state = 'changed' AND NOT st.bad THEN 4 ELSE 3 END AS reader_ver FROM files f JOIN st ON st.path = f.folder || '/' || cast(f.id AS varchar) || f.filename WHERE st.state IN ('changed', 'unchanged')
UNION ALL SELECT last + i, NULL, NULL, NULL, NULL, 4 FROM top, news, unnest(range(1, n + 1)) u(i)"""))
def scan_keeps_rows(spark, sf_dir):
    """A walk against a catalog with ids: files that are read again keep theirs, new ones get those that follow."""
    files = media_view(spark, sf_dir).withColumn("path", F.concat("folder", F.lit("/"), F.col("id").cast("string"), "filename")).withColumn("duration", F.lit(1.0))
    blank = F.when((F.col("ext") == ".mp4") & (F.col("id") % 2 == 0), F.lit(None)).otherwise(F.col("width"))
    stored = files.where("id % 9 <> 0").withColumn("width", blank).withColumn("reader_ver", F.lit(3)).select("id", "path", "folder", "root_id", "group_id", "shuffle_key", "filename", "ext", "mtime", "size", "width", "duration", "reader_ver")
    walked = files.where("id % 8 <> 0").select("path", "folder", "filename", "ext", F.when(F.col("id") % 13 == 0, F.col("mtime") + 5).otherwise(F.col("mtime")).alias("mtime"), "size", "width", "duration", (F.col("id") % 50 == 7).alias("bad"))
    done = ingest.scan(stored, walked, lambda todo: todo.withColumn("error", F.when(F.col("bad"), "damaged")).drop("bad"), version=4)
    added = F.col("id") > stored.agg(F.max("id")).first()[0]  # which new file gets which of the new ids is open
    return done.files.select("id", "root_id", "group_id", "shuffle_key", F.when(~added, F.col("mtime")).alias("mtime"), "reader_ver")


@query(cat(", b AS (SELECT root_id, count(*) FILTER (WHERE id % 8 < 3) AS behind FROM files GROUP BY root_id) SELECT root_id, behind, behind / CASE root_id WHEN 'r0' THEN 10.0 WHEN 'r1' THEN 20.0 ELSE 40.0 END AS seconds, (SELECT sum(behind / CASE root_id WHEN 'r0' THEN 10.0 WHEN 'r1' THEN 20.0 ELSE 40.0 END) FROM b) AS all_seconds FROM b"))
def catchup_estimate(spark, sf_dir):
    files = media_view(spark, sf_dir).withColumn("reader_ver", F.col("id") % 8)
    rate = F.when(F.col("root_id") == "r0", 10.0).when(F.col("root_id") == "r1", 20.0).otherwise(40.0)
    roots = files.select("root_id").distinct().withColumn("rate", rate)
    return ingest.catch_up(files, roots, 3)


@query(cat(" SELECT id FROM files WHERE folder NOT IN ('gen/src1', 'gen/src2')"))
def folders_gone(spark, sf_dir):
    return ingest.without_folders(media_view(spark, sf_dir), ["gen/src1", "gen/src2"], 1, 8).select("id")


@query(cat(", main AS (SELECT id, folder || '/' || id::varchar AS path FROM files WHERE id % 2 = 0), a AS (SELECT folder || '/' || id::varchar AS path, id + 1000000 AS old FROM files WHERE id % 3 = 0), t AS (SELECT path, 'x' AS tag FROM a) SELECT path, count(*) AS rows, cast(sum(tagged) AS bigint) AS tags, bool_or(kept) AS kept_id FROM (SELECT path, 1 AS n, CASE WHEN path IN (SELECT path FROM t) THEN 1 ELSE 0 END AS tagged, TRUE AS kept FROM main UNION ALL SELECT path, 1, 1, FALSE FROM a WHERE path NOT IN (SELECT path FROM main)) GROUP BY path"))
def catalogs_merged(spark, sf_dir):
    files = media_view(spark, sf_dir).select("id", F.concat_ws("/", "folder", F.col("id").cast("string")).alias("path"))
    main = files.where("id % 2 = 0").withColumn("root_id", F.lit("main"))
    other = files.where("id % 3 = 0").select((F.col("id") + 1000000).alias("id"), "path")
    tag = lambda rows: rows.select(F.col("id").alias("image_id"), F.lit("x").alias("tag"), F.lit("user").alias("source"))
    merged, children = ingest.merge_catalogs(main, {"other": other}, {"tags": (tag(main.where("false")), {"other": tag(other)})})
    tags = children["tags"].groupBy(F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("tags"))
    rows = merged.join(tags, "id", "left").join(main.select("id", F.lit(True).alias("kept")), "id", "left")
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("tags", F.lit(0))).alias("tags"), F.bool_or(F.coalesce("kept", F.lit(False))).alias("kept_id"))


@query(cat(TAGS + """, chosen AS (SELECT id FROM files WHERE id % 5 = 2), t AS (SELECT image_id, string_agg(DISTINCT tag, ',' ORDER BY tag) FILTER (WHERE source = 'user' AND NOT starts_with(tag, 'label:')) AS tags, string_agg(tag, ',' ORDER BY coalesce(score, -1) DESC, lower(tag)) FILTER (WHERE starts_with(source, 'ext:')) AS ext_tags, bool_or(source = 'fav') AS fav FROM tags GROUP BY 1)
SELECT f.id, f.folder, f.positive, CASE WHEN t.image_id IS NOT NULL THEN coalesce(t.tags, '') END AS tags, CASE WHEN t.image_id IS NOT NULL THEN coalesce(t.ext_tags, '') END AS ext_tags, coalesce(t.fav, FALSE) AS fav FROM files f JOIN chosen USING (id) LEFT JOIN t ON t.image_id = f.id"""))
def selected_records(spark, sf_dir):
    files = media_view(spark, sf_dir)
    out = records.record(files, files.where("id % 5 = 2").select("id"), all_tags(files))
    return out.select("id", "folder", "positive", "tags", "ext_tags", F.coalesce("fav", F.lit(False)).alias("fav"))


STAGE = "coalesce(nullif(set_stage, ''), CASE WHEN regexp_matches(lower(filename), '_refine[.]') THEN 'refine' WHEN regexp_matches(lower(filename), '_det[.]') THEN 'det' END, '')"


@query(cat(f", m AS (SELECT *, CASE lower({STAGE}) WHEN 'main' THEN 'raw' WHEN 'det' THEN 'detail' ELSE lower({STAGE}) END AS stage FROM files WHERE group_id IS NOT NULL) SELECT f.id, m.id AS member_id, m.filename, m.stage, cast(CASE m.stage WHEN 'raw' THEN 0 WHEN 'detail' THEN 1 WHEN 'refine' THEN 2 WHEN 'upscale' THEN 3 WHEN 'final' THEN 4 WHEN '' THEN 5 ELSE -1 END AS int) AS place FROM files f JOIN m ON m.group_id = f.group_id WHERE f.id % 5 = 2"))
def set_panes(spark, sf_dir):
    files = media_view(spark, sf_dir)
    return records.panes(files, files.where("id % 5 = 2").select("id"))


LINE = r"list_filter(list_transform(string_split(positive, chr(10)), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^[\[(].*[\])]$') AND len(regexp_split_to_array(x, '\s+')) >= 3)[1]"


@query(cat(f", s AS (SELECT *, model_name AS song_name, folder AS genre FROM files), g AS (SELECT song_name FROM s GROUP BY 1 HAVING count(DISTINCT root_id) > 1), c AS (SELECT group_id, min(id) AS cover_id FROM files WHERE ext = '.png' AND group_id IS NOT NULL GROUP BY 1) SELECT s.id, coalesce(CASE WHEN song_name NOT IN (SELECT song_name FROM g WHERE song_name IS NOT NULL) THEN song_name END, {LINE}, genre) AS headline, cover_id FROM s LEFT JOIN c USING (group_id) WHERE ext = '.mp3'"))
def song_cards(spark, sf_dir):
    files = media_view(spark, sf_dir).withColumn("song_name", F.col("model_name")).withColumn("song_genre", F.col("folder")).withColumn("lyrics", F.col("positive"))
    generic = facets.generic_names(files.where("song_name is not null"), "song_name", "root_id")
    return records.songs(files.where("ext = '.mp3'"), files, generic)


@query(cat(" SELECT id, '/thumb/' || cast(id AS varchar) || '?v=' || cast(mtime AS varchar) || '&r=' || root_id || '&s=512' AS url, '512/' || substr(sha1(folder), 1, 2) || '/' || sha1(folder) || '.webp' AS key FROM files"))
def thumbnail_links(spark, sf_dir):
    return media_view(spark, sf_dir).select("id", records.file_url("thumb", F.col("id"), F.col("mtime"), F.col("root_id"), 512).alias("url"), records.thumbnail_key(F.col("folder")).alias("key"))


@query(cat(" SELECT id, filename, coalesce(model_type, '') AS model_type, width FROM files"))
def question_facts(spark, sf_dir):
    """Facts as JSON, read back: blank ones are absent."""
    files = media_view(spark, sf_dir)
    parsed = F.from_json(records.question_facts(files), "filename string, model_type string, width long")
    return files.select("id", parsed.alias("f")).select("id", "f.filename", F.coalesce("f.model_type", F.lit("")).alias("model_type"), "f.width")


@query(cat(", cache AS (SELECT folder || '/' || filename AS path, size, mtime, sha256(cast(id AS varchar)) AS sha FROM files WHERE id % 2 = 0), exact AS (SELECT path, size, mtime, max(sha) AS a FROM cache GROUP BY ALL), loose AS (SELECT split_part(path, '/', 3) AS name, size, arg_max(sha, mtime) AS b FROM cache GROUP BY ALL) SELECT id, substr(coalesce(a, b), 1, 10) AS short_hash FROM files f LEFT JOIN exact e ON e.path = folder || '/' || filename AND e.size = f.size AND e.mtime = f.mtime LEFT JOIN loose l ON l.name = lower(filename) AND l.size = f.size".replace("split_part(path, '/', 3) AS name", "lower(split_part(path, '/', 3)) AS name")))
def cached_hashes(spark, sf_dir):
    files = media_view(spark, sf_dir).select("id", F.concat_ws("/", "folder", "filename").alias("path"), "size", "mtime")
    cache = files.where("id % 2 = 0").select("path", "size", "mtime", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("sha256"))
    return records.with_hashes(files, cache).select("id", "short_hash")


DUPES = """, d AS (SELECT *, count(*) OVER g AS n, first_value(id) OVER (PARTITION BY filename, size, run ORDER BY mtime, id) AS set_id FROM (SELECT *, sum(step) OVER (PARTITION BY filename, size ORDER BY mtime, id) AS run FROM (SELECT *, CASE WHEN mtime - lag(mtime) OVER (PARTITION BY filename, size ORDER BY mtime, id) >= 1 THEN 1 ELSE 0 END AS step FROM copies)) WINDOW g AS (PARTITION BY filename, size, run))"""


@query(cat(COPIES + DUPES + " SELECT root_id, count(*) AS copies, cast(sum(d.size) AS bigint) AS bytes, cast(0 AS bigint) AS curated FROM d JOIN files f USING (id) WHERE n > 1 AND id <> set_id GROUP BY root_id"))
def duplicate_survey(spark, sf_dir):
    files = media_view(spark, sf_dir)
    none = files.where("false").select("id", F.lit(0).alias("weight"))
    return records.survey(curation.duplicate_sets(copies(files).drop("note"), none), files)


@query(cat(COPIES + DUPES + ", h AS (SELECT set_id, filename, n - 1 AS n_dupes, (n - 1) * size AS recoverable FROM d WHERE n > 1 AND id = set_id) SELECT * FROM (SELECT 'most' AS part, * FROM h ORDER BY recoverable DESC, filename, set_id LIMIT 25) UNION ALL SELECT * FROM (SELECT 'least', * FROM h ORDER BY recoverable, filename, set_id LIMIT 25)"))
def duplicate_slices(spark, sf_dir):
    files = media_view(spark, sf_dir)
    most, least = records.slices(curation.duplicate_sets(copies(files).drop("note"), files.where("false").select("id", F.lit(0).alias("weight"))), 25)
    return most.select(F.lit("most").alias("part"), "*").union(least.select(F.lit("least").alias("part"), "*"))


@query(cat(", r AS (SELECT 0 AS place, 'r2' AS root_id UNION ALL SELECT 1, 'none' UNION ALL SELECT 2, 'r0' UNION ALL SELECT 3, 'r1'), c AS (SELECT root_id, count(*) AS n FROM files WHERE model_name = 'en' GROUP BY 1) SELECT 'root' AS dim, root_id AS value, coalesce(n, 0) AS n FROM r LEFT JOIN c USING (root_id) UNION ALL SELECT 'model', coalesce(model_name, '(none)'), count(*) FROM files GROUP BY 2 UNION ALL SELECT 'mtype', coalesce(lower(model_type), '(none)'), count(*) FROM files WHERE model_name = 'en' GROUP BY 2 UNION ALL SELECT 'folder', folder, count(*) FROM files WHERE model_name = 'en' GROUP BY 2 UNION ALL SELECT 'total', '', count(*) FROM files WHERE model_name = 'en'"))
def ordered_facets(spark, sf_dir):
    roots = spark.createDataFrame([(0, "r2"), (1, "none"), (2, "r0"), (3, "r1")], "place int, root_id string")
    return facets.ordered(facets.facets(media_view(spark, sf_dir), FilterSpec(model="en")), roots)


@query("WITH p AS (SELECT conv_id AS post_id, conv_id * 7 % 100 AS posted, conv_id * 2 + turn AS image_id FROM conversations) SELECT image_id, arg_max(post_id, (posted, post_id)) AS post_id, max(posted) AS posted FROM p GROUP BY image_id")
def newest_posts(spark, sf_dir):
    receipts = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("post_id")).agg((F.max("conv_id") * 7 % 100).alias("posted"), F.collect_list(F.col("conv_id") * 2 + F.col("turn")).alias("ids"))
    return extensions.newest_receipts(receipts)


@query("WITH p AS (SELECT conv_id AS post_id, any_value(conv_id * 7 % 100) AS posted, min(conv_id) % 3 > 0 AS ok FROM conversations GROUP BY conv_id) SELECT post_id, posted, ok FROM p ORDER BY posted DESC, post_id LIMIT 100")
def post_log(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("post_id")).agg((F.max("conv_id") * 7 % 100).alias("posted"))
    return extensions.post_log(rows.where("post_id % 3 > 0"), rows.where("post_id % 3 = 0")).select("post_id", "posted", "ok")


@query(cat(", n AS (SELECT 'name_' || cast(id AS varchar) || '_12-30-' || lpad(cast(id % 60 AS varchar), 2, '0') || '~vv00ab12_' || lpad(cast(id % 7 AS varchar), 5, '0') || '.mp3' AS f, id FROM files) SELECT id, 'name_' || cast(id AS varchar) AS name, 'name_' || cast(id AS varchar) || '_12-30-' || lpad(cast(id % 60 AS varchar), 2, '0') AS plain, 'a/b/' || f AS path FROM n"))
def generated_names(spark, sf_dir):
    d = F.col("id")
    files = media_view(spark, sf_dir).select("id", F.concat(F.lit("name_"), d.cast("string"), F.lit("_12-30-"), F.lpad((d % 60).cast("string"), 2, "0"), F.lit("~vv00ab12_"), F.lpad((d % 7).cast("string"), 5, "0"), F.lit(".mp3")).alias("f"))
    return files.select("id", C.name_from_filename(F.col("f")).alias("name"), C.plain_stem(F.col("f")).alias("plain"), records.renamed_path(F.lit("a/b/old.png"), F.col("f")).alias("path"))


@query(cat(", gg AS (SELECT group_id FROM files WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(*) > 1 AND bool_or(" + sql.VIDEO + ")) SELECT id FROM files WHERE group_id IN (SELECT group_id FROM gg)"))
def visible_set_members(spark, sf_dir):
    """With pairs alone shown, what 'select all' takes: the members of all visible pairs."""
    rows = cards.with_cards(media_view(spark, sf_dir), pairs=True, sets=False)
    shown = cards.collapse(rows, sets_only=True)
    return cards.members_of(shown, rows).select("id")
