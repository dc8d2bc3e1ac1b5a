"""SQL of the catalog-shaped view, shared by the checks."""

_EXT = "CASE WHEN d.doc_id % 23 = 0 THEN '.mp4' WHEN d.doc_id % 31 = 0 THEN '.mp3' ELSE '.png' END"

CATALOG = f"""
WITH scores AS (SELECT doc_id, max(quality) AS reward, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cat AS (
  SELECT d.doc_id AS id, concat('r', cast(d.doc_id % 3 AS varchar)) AS root_id, concat('gen/', d.source) AS folder,
    CASE WHEN d.doc_id % 10 <> 0 THEN d.lang END AS model_name,
    CASE WHEN d.doc_id % 10 <> 0 THEN d.lang || '_v' || cast(d.doc_id % 4 AS varchar) END AS model_type,
    CASE WHEN d.doc_id % 10 <> 0 THEN list_value('SDXL v1.5\\', 'Pony/', 'krea 2/', 'Krea/', 'krea2/', '')[d.doc_id % 6 + 1] || list_value('base', 'ultraPonyReal_7', 'influx', 'my-flux_1Dev')[d.doc_id % 4 + 1] || '.safetensors' END AS model,
    {_EXT} AS ext,
    'shot_' || cast(d.doc_id % 97 AS varchar) || CASE d.doc_id % 6 WHEN 1 THEN '_Refine' WHEN 2 THEN '-audio' WHEN 3 THEN '_det' ELSE '' END || {_EXT} AS filename,
    CASE WHEN d.doc_id % 4 <> 0 THEN 'g' || cast(cast(floor(d.doc_id / 3) AS bigint) AS varchar) END AS group_id,
    CASE d.doc_id % 5 WHEN 0 THEN 'Final' WHEN 1 THEN 'raw' WHEN 2 THEN 'First' ELSE '' END AS set_stage,
    1700000000 + d.doc_id * 60 AS mtime, d.n_chars AS size, 1024 + d.doc_id % 60 AS width, 1024 + d.doc_id % 47 AS height,
    d.text AS positive, cast(s.reward AS int) AS reward, cast(coalesce(s.toxic, 0) AS int) AS toxic,
    CASE WHEN d.doc_id % 31 = 0 THEN 'Chanson d''été ' || d.lang END AS lyrics, d.doc_id * 7919 % 1000000007 AS shuffle_key,
    CASE WHEN d.doc_id % 9 = 0 THEN 0 ELSE 1 END AS has_meta, CASE WHEN d.doc_id % 17 = 0 THEN 'Note on ' || d.source WHEN d.doc_id % 17 = 1 THEN ' ' END AS note
  FROM documents d LEFT JOIN scores s ON s.doc_id = d.doc_id),
files AS (SELECT *, coalesce(group_id, 'i' || cast(id AS varchar)) AS card FROM cat)
"""

WORDS = r"regexp_replace(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
SEARCHED = " || ".join("' ' || " + WORDS.format(c) + " || chr(10)" for c in ("positive", "model_name", "filename", "folder", "lyrics"))
RANK = "CASE WHEN lower(coalesce(set_stage, '')) = 'final' THEN 0 WHEN lower(coalesce(set_stage, '')) = 'upscale' THEN 1 WHEN lower(coalesce(set_stage, '')) = 'refine' THEN 2 WHEN lower(coalesce(set_stage, '')) IN ('detail', 'det') THEN 3 WHEN lower(coalesce(set_stage, '')) IN ('raw', 'main') THEN 4 WHEN coalesce(set_stage, '') <> '' THEN 5 WHEN filename ILIKE '%refine%' THEN 2 WHEN filename ILIKE '%det%' THEN 3 WHEN filename ILIKE '%main%' THEN 4 ELSE 5 END"
VIDEO = "(ext IN ('.mp4', '.mov', '.webm'))"
AUDIO = "(ext IN ('.mp3', '.flac', '.wav', '.opus', '.m4a'))"
ASPECT = "CASE WHEN width > 0 AND height > 0 THEN CASE WHEN abs(width - height) * 50 <= greatest(width, height) THEN 'square' WHEN height > width THEN 'portrait' ELSE 'landscape' END END"


def cards(rows: str, fav: str = "0", having: str = "TRUE") -> str:
    """Faces of cards among rows (a FROM item with card), by ranks inside windows."""
    return f"""
SELECT card, id, mtime, size, reward, shuffle_key, group_count, video_id, has_video, has_audio, newest FROM (
  SELECT *, count(*) OVER c AS group_count, max(mtime) OVER c AS newest, bool_or({VIDEO}) OVER c AS has_video, bool_or({AUDIO}) OVER c AS has_audio,
    first_value(CASE WHEN {VIDEO} THEN id END) OVER (PARTITION BY card ORDER BY CASE WHEN {VIDEO} THEN 0 ELSE 1 END, CASE WHEN lower(filename) LIKE '%-audio.%' THEN 0 ELSE 1 END, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS video_id,
    row_number() OVER (PARTITION BY card ORDER BY CASE WHEN {AUDIO} THEN 0 ELSE 1 END, CASE WHEN {VIDEO} THEN 1 ELSE 0 END, {RANK}, filename DESC, {fav} DESC, reward DESC NULLS LAST, mtime DESC, id DESC) AS place
  FROM {rows} WINDOW c AS (PARTITION BY card)) WHERE place = 1 AND {having}"""


CARDS = cards("(SELECT * FROM files WHERE card IN (SELECT card FROM files WHERE {where}))")
