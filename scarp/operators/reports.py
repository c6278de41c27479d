"""Evaluation of alerts against known events, and health of the runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import age_days


def evaluation(alerts: DataFrame, near_km: float = 2.0, most_days: float = 30.0) -> DataFrame:
    """By event, from its alerts (event_id, kind, level, at, event_at, km): whether it was warned of, the first warning's
    lead in hours, alerts elsewhere before it by level, and the first detection after it within ``near_km``. A distance
    of zero is near; a missing one is not."""
    lead = age_days(F.col("at"), F.col("event_at")) * 24
    near = F.coalesce(F.col("km") <= near_km, F.lit(False))
    before = (F.col("kind") != "all_clear") & (lead > 0)
    warning = before & near & (lead <= most_days * 24)
    elsewhere = before & ~near
    return alerts.groupBy("event_id").agg(
        F.coalesce(F.bool_or(warning), F.lit(False)).alias("warned"),
        F.max(F.when(warning, lead)).alias("lead_h"),
        F.count_if(elsewhere).alias("elsewhere"),
        F.count_if(elsewhere & (F.col("level") == "high")).alias("elsewhere_high"),
        F.min(F.when((lead <= 0) & near, -lead)).alias("detected_after_h"),
    )


def health(runs: DataFrame, now: Column, interval_hours: float) -> DataFrame:
    """Last good finish, and whether it is older than two intervals (or missing)."""
    g = runs.where(F.col("status").isin("processed", "partial")).agg(F.max("acquired_at").alias("last"), F.count("*").alias("runs"))
    return g.withColumn("stale", F.coalesce(age_days(F.col("last"), now) * 24 > 2 * interval_hours, F.lit(True)))


def timeline(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """By key: the number of assessments, the highest score and when, and how long each level held on average."""
    return assessments.groupBy(*keys).agg(F.count("*").alias("n"), F.max("score").alias("top"), F.max_by("at", F.struct("score", "at")).alias("top_at"), F.count_if(F.col("level") == "high").alias("high"), F.count_if(F.col("level") == "medium").alias("medium"))
