"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagia.operators.catalog import read
from pelagia.operators import store
from pelagia.streaming import presence, watch


def stream_sessions(spark, sf_dir):
    """Sessions of each user with gaps under an hour, their number and events."""
    stream = watch.arriving(spark, sf_dir, "events.parquet", read(spark, sf_dir, "events").schema)
    table = watch.run_to_table(spark, watch.sessions(stream, "user_id", "ts", "1 hour", "2 hours"), "complete", "sessions")
    return table.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


def stream_newest(spark, sf_dir):
    """The newest event of each user, kept up to date batch by batch."""
    stream = watch.arriving(spark, sf_dir, "events.parquet", read(spark, sf_dir, "events").schema)
    rows = stream.select("event_id", "user_id", "event_type", "value")
    newest = watch.upsert_batches(spark, rows, "user_id", "event_id", store.shared_dir(spark, "newest"), store.shared_dir(spark, "newest-progress"))
    return newest.select("user_id", "event_id", "event_type", "value")


def stream_presence(spark, sf_dir):
    """How often each user came, left and fell silent, and whether they are still there; an error says that they leave."""
    stream = watch.arriving(spark, sf_dir, "events.parquet", read(spark, sf_dir, "events").schema)
    signals = stream.select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "error", "leave").otherwise("beat").alias("kind"))
    found = presence.changes(signals, "1 hour", presence.Rules(stale=36_000_000, grace=7_200_000))
    table = presence.appended(found, store.shared_dir(spark, "presence"), store.shared_dir(spark, "presence-progress"))
    counts = table.groupBy("client").agg(F.count_if(F.col("state") == "open").alias("opened"), F.count_if(F.col("reason") == "left").alias("went"), F.count_if(F.col("reason") == "stale").alias("fell_silent"))
    shown = counts.join(presence.now(table), "client")
    return shown.select(F.col("client").cast("long").alias("user_id"), "opened", "went", "fell_silent", (F.col("state") == "open").alias("open_now"))


#: one signal after the other for each user; the row after the last stands for the watermark
PRESENCE = """WITH RECURSIVE sig AS (SELECT user_id, epoch_ms(ts) AS ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS k FROM events UNION ALL SELECT user_id, (SELECT epoch_ms(max(ts)) FROM events) - 3600000, 2 FROM (SELECT DISTINCT user_id FROM events)),
num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k = 2, ms, k) AS n FROM sig),
walk AS (
  SELECT user_id, 0::bigint AS n, FALSE AS open, 0::bigint AS seen, -1::bigint AS gone, 0 AS opened, 0 AS went, 0 AS fell FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, CASE WHEN k = 0 THEN TRUE ELSE open AND NOT ends END, CASE WHEN k = 0 THEN ms ELSE seen END, CASE WHEN k = 0 OR ends OR NOT open THEN -1 WHEN k = 1 THEN ms ELSE gone END,
    opened + CASE WHEN k = 0 AND (NOT open OR ends) THEN 1 ELSE 0 END, went + CASE WHEN ends AND leaves THEN 1 ELSE 0 END, fell + CASE WHEN ends AND NOT leaves THEN 1 ELSE 0 END
  FROM (SELECT *, open AND ms > CASE WHEN leaves THEN gone + 7200000 ELSE seen + 36000000 END AS ends FROM (SELECT w.user_id, s.n, s.ms, s.k, w.open, w.seen, w.gone, w.opened, w.went, w.fell, w.gone >= 0 AND w.gone + 7200000 < w.seen + 36000000 AS leaves FROM walk w JOIN num s ON s.user_id = w.user_id AND s.n = w.n + 1)))
SELECT user_id, cast(opened AS bigint) AS opened, cast(went AS bigint) AS went, cast(fell AS bigint) AS fell_silent, open AS open_now FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1 AND opened > 0"""
QUERIES = {"stream_sessions": stream_sessions, "stream_newest": stream_newest, "stream_presence": stream_presence}
ORACLE_SQL = {
    "stream_sessions": "SELECT user_id, cast(sum(step) AS bigint) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 3600, TRUE) THEN 1 ELSE 0 END AS step FROM events) GROUP BY user_id",
    "stream_newest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "stream_presence": PRESENCE,
}
