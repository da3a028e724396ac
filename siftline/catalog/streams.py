"""Streaming jobs over ``events``, each with its batch twin in SQL."""

import datetime
import uuid

from pyspark.sql import functions as F

from siftline.catalog.base import query, table
from siftline.functions.runlog import (merge_partials, phase_states, progress_partials,
                                       run_percent, stalled)
from siftline.session import checkpoint_dir
from siftline.streaming import jobs
from siftline.streaming.deltas import read_deltas

_LINES = {"click": "Phase 1 running", "view": "Phase 1b complete: 5 jobs, 0 failed",
          "purchase": "Phase 2 Ranking", "error": "Phase 2b FAILED (exit 1)",
          "signup": "note without meaning"}


def lines(events):
    text = F.coalesce(*[F.when(F.col("event_type") == t, x) for t, x in _LINES.items()])
    text = F.when(F.col("event_id") % 997 == 996, "Pipeline complete.").otherwise(text)
    return events.select(
        (F.col("user_id") * 1000 + F.floor(F.col("event_id") / 50)).alias("run_id"),
        F.col("event_id").alias("seq"), "ts",
        F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), text).alias("line"))


# Phases in order with weights; a phase is closed by a later phase or the end.
PROGRESS = """ln AS (SELECT user_id * 1000 + event_id // 50 AS run_id, event_id AS seq, ts,
  CASE WHEN event_id % 997 = 996 THEN '*' ELSE CASE event_type WHEN 'click' THEN '1'
   WHEN 'view' THEN '1b' WHEN 'purchase' THEN '2' WHEN 'error' THEN '2b' END END AS phase,
  CASE WHEN event_id % 997 = 996 THEN 'done' ELSE CASE event_type WHEN 'view' THEN 'done'
   WHEN 'error' THEN 'failed' ELSE 'running' END END AS status FROM events
  WHERE event_type <> 'signup' OR event_id % 997 = 996),
 st AS (SELECT run_id, phase, arg_max(status, seq) AS status, max(seq) AS seq FROM ln
  GROUP BY ALL),
 ru AS (SELECT run_id, max(ts) AS last_activity, max(CASE WHEN phase = '*' THEN seq END) AS fin
  FROM ln GROUP BY 1),
 ph(o, phase, w) AS (VALUES (0, '0b', 4), (1, '1', 22), (2, '1b', 3), (3, '1c', 12),
  (4, '1b-final', 3), (5, '2', 38), (6, '2b', 2), (7, '3', 5), (8, '4', 6), (9, '5', 5)),
 gr AS (SELECT ru.run_id, fin, last_activity, o, w, status, st.seq, greatest(fin, max(st.seq)
   OVER (PARTITION BY ru.run_id ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
   AS later FROM ru CROSS JOIN ph LEFT JOIN st ON st.run_id = ru.run_id AND st.phase = ph.phase),
 fs AS (SELECT *, CASE WHEN coalesce(status, 'pending') IN ('pending', 'running')
   AND later IS NOT NULL AND (seq IS NULL OR later > seq) THEN 'done'
   ELSE coalesce(status, 'pending') END AS s FROM gr),
 pc AS (SELECT run_id, CASE WHEN max(fin) IS NOT NULL THEN 100 ELSE least(99, floor(sum(
   CASE WHEN s IN ('done', 'failed', 'skipped') THEN w WHEN s = 'running' THEN w / 2.0 ELSE 0 END
   )))::INT END AS pct, max(fin) IS NOT NULL AS complete, max(last_activity) AS last_activity
   FROM fs GROUP BY run_id)"""
_PC = f"WITH {PROGRESS} SELECT run_id, pct, complete, last_activity FROM pc"


@query("run_progress", _PC)
def run_progress(spark, sf):
    state = progress_partials(lines(table(spark, sf, "events")))
    return run_percent(phase_states(merge_partials(state)))


@query("run_stalls", f"""WITH {PROGRESS} SELECT run_id, NOT complete AND epoch_us(
 TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_activity) >= 120000000 AS stalled FROM pc""")
def run_stalls(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return stalled(run_progress(spark, sf), now).select("run_id", "stalled")


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf))


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("run_progress_stream", _PC)
def run_progress_stream(spark, sf):
    root = _folder(spark, "progress")
    jobs.run_progress(lines(_stream(spark, sf, "events")), f"{root}/state",
                      f"{root}/check").awaitTermination()
    return jobs.progress_now(spark, f"{root}/state")


@query("alert_intake_stream", """SELECT 'u' || user_id AS key,
 strftime(min(ts), '%Y-%m-%d') AS first_alerted, strftime(max(ts), '%Y-%m-%d') AS last_seen
FROM events GROUP BY user_id""")
def alert_intake_stream(spark, sf):
    root = _folder(spark, "alerts")
    e = _stream(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    s = e.select(F.concat(F.lit("u"), "user_id").alias("key"), day.alias("first_alerted"),
                 day.alias("seen_on"), F.col("event_id").alias("seq"),
                 *[F.lit("x").alias(c) for c in jobs.ALERT_FIELDS])
    jobs.alert_intake(s, f"{root}/state", f"{root}/check").awaitTermination()
    return jobs.merge_alert_partials(read_deltas(spark, f"{root}/state")).select(
        "key", "first_alerted", "last_seen")


@query("posting_intake_stream", """SELECT DISTINCT 'url:https://x.example/' || user_id
 AS dedup_key FROM events""")
def posting_intake_stream(spark, sf):
    """One posting per key within the watermark; the delay covers the whole month of events."""
    root = _folder(spark, "postings")
    e = _stream(spark, sf, "events").select(
        F.concat(F.lit("https://x.example/"), "user_id", F.lit("?e="), "event_id").alias("url"),
        F.lit("").alias("company"), F.lit("").alias("title"), "ts")
    out = jobs.posting_intake(e, "ts", "60 days").select("dedup_key")
    (out.writeStream.option("checkpointLocation", f"{root}/check").trigger(availableNow=True)
     .format("parquet").option("path", f"{root}/out").start().awaitTermination())
    return spark.read.schema("dedup_key string").parquet(f"{root}/out")


@query("earliest_posting_stream", """WITH RECURSIVE e AS (SELECT 'url:https://x.example/' || user_id
  AS dedup_key, event_id, ts FROM events),
 hold AS (SELECT dedup_key, min(ts) AS ts FROM e GROUP BY 1
  UNION ALL
  SELECT h.dedup_key, (SELECT min(e.ts) FROM e WHERE e.dedup_key = h.dedup_key
   AND e.ts > h.ts + INTERVAL 2 DAY) AS nx FROM hold h WHERE nx IS NOT NULL),
 ended AS (SELECT dedup_key, ts, lead(ts) OVER (PARTITION BY dedup_key ORDER BY ts) AS nx FROM hold)
SELECT d.dedup_key, d.ts FROM ended d WHERE nx IS NOT NULL
 OR d.ts + INTERVAL 2 DAY < (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def earliest_posting_stream(spark, sf):
    """Which arrival of a key stays, in event order; what the watermark has not passed is held."""
    root = _folder(spark, "earliest")
    e = _stream(spark, sf, "events").select(
        F.concat(F.lit("https://x.example/"), "user_id", F.lit("?e="), "event_id").alias("url"),
        F.lit("").alias("company"), F.lit("").alias("title"), "ts")
    out = jobs.earliest_postings(e, "ts", datetime.timedelta(days=2)).select("dedup_key", "ts")
    (out.writeStream.option("checkpointLocation", f"{root}/check").trigger(availableNow=True)
     .format("parquet").option("path", f"{root}/out").start().awaitTermination())
    return spark.read.schema("dedup_key string, ts timestamp").parquet(f"{root}/out")
