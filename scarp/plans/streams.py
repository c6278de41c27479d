"""Streaming queries over the events table, run over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk
from ..streaming import jobs, lifecycle
from .lifecycle import fold_sql


def _stream(spark, sf):
    return jobs.observations(spark, f"{sf}/events*.parquet")  # a pattern, as the file source takes no single file


def stream_daily(spark, sf):
    """Counts and sums by day and kind under a watermark; complete mode, as the last day stays open."""
    out = jobs.run_to_table(jobs.tumbling(_stream(spark, sf), "1 day", ["event_type"]), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, sf):
    out = jobs.run_to_table(jobs.sliding(_stream(spark, sf), "2 days", "1 day"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("top", 6).alias("top"))


def stream_sessions(spark, sf):
    """Sessions of a user, six hours apart."""
    out = jobs.run_to_table(jobs.sessions(_stream(spark, sf), "6 hours", ["user_id"]), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def stream_first(spark, sf):
    """Each event once, though the stream may repeat it."""
    stream = _stream(spark, sf)
    out = jobs.run_to_table(jobs.first_sightings(stream.union(stream), ["event_id"]))
    return out.select("event_id", "event_type")


def stream_latest(spark, sf):
    """The latest observation of each user and kind, merged batch by batch."""
    rows = _stream(spark, sf).select("user_id", "event_type", "event_id", "value")
    return jobs.merged(rows, ["user_id", "event_type"], "event_id").withColumn("value", F.round("value", 6))


def _assessed(events, *more):
    score = risk.ramp(F.col("value"), F.lit(20.0), F.lit(80.0))
    return events.select(
        F.col("event_id").alias("assessment_id"), F.col("user_id").alias("site_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.round(score, 6).alias("score"), risk.level_for(score).alias("level"),
        ((F.col("event_id") % 10) / 10.0).alias("dynamic"), (F.col("event_id") % 4 == 0).alias("needs_confirmation"), *more,
    )


def stream_alerts(spark, sf):
    """The alert fold with state by site."""
    out = jobs.run_to_table(jobs.alert_stream(_assessed(_stream(spark, sf))))
    return out.select("assessment_id", "site_id", "level", "kind", "previous_level", "superseded", "status")


def stream_expiries(spark, sf):
    """Alerts that ended by themselves, when and at which level: the watermark, as a timer by event time tells, or a later row of
    their site has passed their expiry."""
    rows = _assessed(jobs.observations(spark, f"{sf}/events*.parquet", "1 hour"), "ts")
    out = jobs.run_to_table(lifecycle.alert_life(rows), settings=lifecycle.ROCKS)
    return out.where("kind = 'expired'").select("assessment_id", "site_id", "level", "expires")


QUERIES = {f.__name__: f for f in (stream_daily, stream_sliding, stream_sessions, stream_first, stream_latest, stream_alerts, stream_expiries)}
_DECIDED = f"""WITH RECURSIVE sc AS (SELECT event_id, user_id, ts, event_id % 10 AS d, greatest(0, least(1, (value - 20) / 60::DOUBLE)) AS s FROM events), src AS (SELECT event_id AS assessment_id, user_id AS site_id, epoch_us(ts) AS "at", round(s, 6) AS score, CASE WHEN s >= 0.6 THEN 'high' WHEN s >= 0.35 THEN 'medium' ELSE 'low' END AS level, d::DOUBLE / 10 AS dynamic, event_id % 4 = 0 AS needs_confirmation FROM sc), {fold_sql("src")}"""
ORACLES = {
    "stream_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "WITH d AS (SELECT ts::DATE AS d, value FROM events UNION ALL SELECT ts::DATE - 1, value FROM events) SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n, round(max(value), 6) AS top FROM d GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), c AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM c GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1",
    "stream_first": "SELECT event_id, event_type FROM events",
    "stream_alerts": f"{_DECIDED} SELECT assessment_id, site_id, level, kind, previous_level, superseded, status FROM decided",
    "stream_expiries": f"""{_DECIDED}, e AS (SELECT assessment_id, site_id, level, pexp AS expires, lead(pat) OVER (PARTITION BY site_id ORDER BY n) AS next, (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events) AS seen FROM decided), l AS (SELECT site_id, max("at") AS newest FROM src GROUP BY 1)
 SELECT assessment_id, site_id, level, expires FROM e JOIN l USING (site_id) WHERE level <> 'high' AND (next > expires OR next IS NULL AND (expires < seen OR expires < newest))""",
    "stream_latest": "SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2",
}
