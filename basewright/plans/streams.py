"""Queries of the streaming forms (T); each drains a stream of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewright.plans.registry import add
from basewright.plans.shared_sql import SEQS, rc
from basewright.streaming import jobs


@add("t01_stream_dedup", f"WITH {SEQS} SELECT DISTINCT sha256(least(seq, {rc('seq')})) AS hash FROM seqs")
def t01(spark, sf):
    docs = jobs.stream_table(spark, sf, "documents").withColumn("seq", F.regexp_replace(F.upper("text"), "[^ACGTN]", ""))
    return jobs.run_available(jobs.first_by_hash(docs).select("hash"))


@add(
    "t02_stream_quota",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, value, i, CASE WHEN value <= 1000 THEN value ELSE 0 END AS total, value <= 1000 AS kept FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.event_id, o.value, o.i, CASE WHEN f.total + o.value <= 1000 THEN f.total + o.value ELSE f.total END, f.total + o.value <= 1000 FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, event_id, value FROM f WHERE kept""",
)
def t02(spark, sf):
    return jobs.run_available(jobs.quota(jobs.stream_table(spark, sf, "events"), "user_id", "event_id", "value", 1000))


@add("t03_stream_running_best", "SELECT user_id, min(value) AS best_loss, max(event_id) AS latest_step, count(*) AS rows FROM events GROUP BY user_id")
def t03(spark, sf):
    return jobs.run_available(jobs.running_best(jobs.stream_table(spark, sf, "events"), "user_id", "event_id", "value"), "complete")


@add("t04_stream_step_buckets", "SELECT (event_id // 1000)::BIGINT AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t04(spark, sf):
    return jobs.run_available(jobs.step_buckets(jobs.stream_table(spark, sf, "events"), "event_id", 1000, "event_type"), "complete")


@add("t05_stream_tumbling", "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def t05(spark, sf):
    rows = jobs.run_available(jobs.windowed(jobs.stream_table(spark, sf, "events"), "ts", "6 hours"), "complete")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@add("t05_stream_sliding", "WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2")
def t05s(spark, sf):
    rows = jobs.run_available(jobs.windowed(jobs.stream_table(spark, sf, "events"), "ts", "12 hours", "6 hours"), "complete")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@add(
    "t05_stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def t05g(spark, sf):
    rows = jobs.run_available(jobs.sessions(jobs.stream_table(spark, sf, "events"), "ts", "user_id", "12 hours"), "complete")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@add("t06_stream_history", "SELECT event_id AS step, value AS loss FROM events WHERE event_type = 'purchase'")
def t06(spark, sf):
    keep = lambda d: d.where("event_type = 'purchase'").select(F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return jobs.history_sink(jobs.stream_table(spark, sf, "events"), keep)
