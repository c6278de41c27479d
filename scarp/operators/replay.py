"""Replays in two times: what stored evidence would have led to, and when that would have been known.

Evidence has the time of its acquisition; decisions are made ``latency`` hours later. Assessments are made only at times of
scenes that were processed, of the sites that were observed then. Nothing is sent, so no alert counts as dispatched and no
all-clear follows; a store whose alerts were sent is not rebuilt at all. The report's parts are tables by area, and are
written as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import alerts as life
from . import exports, risk
from .joins import KM_LAT, KM_LON, rank
from .tables import top_by

#: Hours from an acquisition until its results are known (fixed value).
LATENCY_HOURS = 6.0
#: Smallest change that a report lists, least confidence of a detection and how near it must be, names of places a site
#: shows, and movements a report shows (fixed values).
MIN_CHANGE_M2, MIN_CONFIDENCE, DETECTED_KM, MOST_PLACES, MOST_MOVES = 50_000, 0.7, 5.0, 8, 10


def refuse_dispatched(stored: DataFrame) -> None:
    """An error if a stored alert was sent: its history can't be told otherwise any more."""
    if not stored.where(F.col("status") == "dispatched").limit(1).isEmpty():
        raise RuntimeError("refusing to rebuild alerts: some were dispatched")


def assessment_times(obs: DataFrame, scenes: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_id, as_of): sites observed at the time of a processed scene of their area. ``scenes``: aoi, acquired_at, status."""
    done = scenes.where(F.col("status") == "processed").select("aoi", F.col("acquired_at").alias("as_of")).distinct()
    seen = obs.select("site_id", F.col("observed_at").alias("as_of")).distinct().join(sites.select("site_id", "aoi"), "site_id")
    return seen.join(done, ["aoi", "as_of"], "left_semi").select("site_id", "as_of")


def reassessed(obs: DataFrame, scenes: DataFrame, sites: DataFrame, exposure: DataFrame, w: risk.Windows, stored: DataFrame | None = None) -> DataFrame:
    """The assessments that the stored observations lead to, with ``at`` in microseconds. ``stored``: the alerts so far."""
    if stored is not None:
        refuse_dispatched(stored)
    out = risk.assessed(obs, assessment_times(obs, scenes, sites), sites, exposure, w)
    return out.withColumn("at", F.unix_micros(F.col("as_of").cast("timestamp")))


def undispatched(assessments: DataFrame, latency_hours: float = LATENCY_HOURS) -> DataFrame:
    """The alerts of ``assessments`` (assessment_id, site_id, at, level, score, dynamic, needs_confirmation), none of them sent."""
    return life.fold(assessments, (), latency_hours)


def distance(events: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (aoi, lon, lat) with ``km`` to their area's event (aoi, event_at, event_lon, event_lat; any may be null), and
    its time. Longitudes are scaled at the row."""
    km = F.hypot((F.col("lon") - F.col("event_lon")) * KM_LON * F.cos(F.radians("lat")), (F.col("lat") - F.col("event_lat")) * KM_LAT)
    return rows.join(events, "aoi", "left").withColumn("km", km).drop("event_lon", "event_lat")


def scene_counts(scenes: DataFrame) -> DataFrame:
    """By area: processed scenes of each sensor, skipped and failed ones."""
    done = F.col("status") == "processed"
    return scenes.groupBy("aoi").agg(*[F.count_if(done & (F.col("sensor") == s)).alias(s.lower()) for s in ("S1", "S2")], *[F.count_if(F.col("status") == x).alias(x) for x in ("skipped", "failed")])


def site_rows(assessments: DataFrame, obs: DataFrame, sites: DataFrame, exposed: DataFrame, events: DataFrame) -> DataFrame:
    """A row for each assessed site: distance to the event, the highest score before it (the first of equal ones) with its
    level, time and reasons, how often it was assessed and observed, and the named assets that a flood reaches first.

    ``exposed``: site_id, name, minutes."""
    placed = distance(events, sites.select("site_id", "aoi", "code", "lon", "lat"))
    own = assessments.join(placed.select("site_id", "event_at"), "site_id")
    before = F.col("event_at").isNull() | (F.col("as_of") < F.col("event_at"))
    top = F.max_by(F.when(before, F.struct("level", "score", "at", "reasons")), F.when(before, F.struct("score", (-F.col("at")).alias("early"))))
    told = own.groupBy("site_id").agg(F.count("*").alias("assessments"), top.alias("before"))
    seen = obs.groupBy("site_id").agg(F.count("*").alias("observations"))
    first = top_by(exposed.where(F.col("name").isNotNull() & (F.col("name") != "")), ["site_id"], MOST_PLACES, F.col("minutes"), F.col("name"))
    named = first.groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("places"))
    out = placed.join(told, "site_id").join(seen, "site_id", "left").join(named, "site_id", "left")
    return out.select("aoi", "site_id", "code", "km", "assessments", F.coalesce("observations", F.lit(0)).alias("observations"), *[F.col(f"before.{c}").alias(f"before_{c}") for c in ("level", "score", "at", "reasons")], F.array_join(F.coalesce("places", F.array().cast("array<string>")), ",").alias("places"))


def lead_hours(event_at: Column, known: Column) -> Column:
    """Hours from what was known, in microseconds, to the event, to one place."""
    return F.round((F.unix_micros(event_at.cast("timestamp")) - known) / F.lit(3600e6), 1)


def alert_rows(alerts: DataFrame, sites: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with their area and distance, when they would have been available, the lead over the event and whether there
    was one."""
    placed = distance(events, sites.select("site_id", "aoi", "code", "lon", "lat")).select("site_id", "aoi", "code", "km", "event_at")
    early = F.col("available") < F.unix_micros(F.col("event_at").cast("timestamp"))
    return alerts.join(placed, "site_id").select("aoi", "site_id", "code", "km", "level", "kind", "at", "available", lead_hours(F.col("event_at"), F.col("available")).alias("lead_h"), early.alias("pre_event"), "status")


def change_rows(changes: DataFrame, events: DataFrame) -> DataFrame:
    """Changes (aoi, kind, at, lon, lat, area_m2, confidence) that are large enough, with their distance to two places."""
    out = distance(events, changes.where(F.col("area_m2") >= MIN_CHANGE_M2))
    return out.withColumn("km", F.round("km", 2)).withColumn("area_km2", F.round(F.col("area_m2") / 1e6, 4)).drop("area_m2")


def summary(site: DataFrame, alert: DataFrame, change: DataFrame, events: DataFrame, source_km: float = 2.0, warning_days: float = 30.0) -> DataFrame:
    """By area: the number of alerts and, of areas with an event, whether a site within ``source_km`` was warned of in the
    ``warning_days`` before, the first such warning, the highest level near the source, alerts elsewhere, and the hours until
    the event was detected (at some distance: one at distance zero is not counted)."""
    near = F.coalesce(F.col("km") <= source_km, F.lit(False))
    early = F.coalesce(F.col("pre_event"), F.lit(False)) & (F.col("kind") != "all_clear")
    warning = early & near & (F.col("lead_h") <= warning_days * 24)
    first = F.min(F.when(warning, F.struct("available", "lead_h", "level")))
    told = alert.groupBy("aoi").agg(F.count("*").alias("alerts"), first.alias("first"), F.count_if(early & ~warning).alias("elsewhere"), *[F.count_if(early & ~warning & (F.col("level") == x)).alias(f"elsewhere_{x}") for x in ("medium", "high")])
    level = site.where(near & F.col("before_level").isNotNull()).groupBy("aoi").agg(F.max_by("before_level", rank(F.col("before_level"))).alias("highest_before"))
    after = (F.col("kind") == "mass_movement") & (F.col("confidence") >= MIN_CONFIDENCE) & (F.nullif(F.col("km"), F.lit(0.0)) <= DETECTED_KM) & (F.col("at") > F.col("event_at"))
    found = change.where(after).groupBy("aoi").agg(F.min((F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("event_at").cast("timestamp"))) / F.lit(3600e6)).alias("late"))
    out = events.select("aoi", "event_at").join(told, "aoi", "left").join(level, "aoi", "left").join(found, "aoi", "left")
    known = F.col("event_at").isNotNull()
    counts = [F.when(known, F.coalesce(c, F.lit(0))).alias(c) for c in ("elsewhere", "elsewhere_medium", "elsewhere_high")]
    return out.select("aoi", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.when(known, F.col("first").isNotNull()).alias("warned"), F.col("first.lead_h").alias("lead_h"), F.col("first.level").alias("first_level"), F.when(known, F.col("highest_before")).alias("highest_before"), *counts, F.round("late", 1).alias("detected_after_h"))


def report_lines(summed: DataFrame, scenes: DataFrame, alert: DataFrame, change: DataFrame) -> DataFrame:
    """The report of each area as lines (aoi, section, place, line). Alerts are all listed, movements as far as a report
    shows them."""
    text = lambda c, none="–": F.coalesce(F.col(c).cast("string"), F.lit(none))
    counts = scene_counts(scenes)
    head = summed.join(counts, "aoi", "left").fillna(0, ["s1", "s2", "skipped", "failed"])
    warned = F.when(F.col("warned"), F.concat(F.lit("yes, "), F.upper("first_level"), F.lit(" "), text("lead_h"), F.lit(" h ahead"))).otherwise(F.concat(F.lit("no; highest level near the source: "), F.upper(text("highest_before", "not assessed"))))
    listed = [
        F.concat(F.lit("# Replay of area "), F.col("aoi")),
        F.concat(F.lit("Scenes processed: "), F.col("s1"), F.lit(" radar, "), F.col("s2"), F.lit(" optical ("), F.col("skipped"), F.lit(" skipped, "), F.col("failed"), F.lit(" failed)")),
        F.when(F.col("warned").isNotNull(), F.concat(F.lit("- Warned before the event: "), warned)),
        F.when(F.col("warned").isNotNull(), F.concat(F.lit("- Alerts elsewhere before it: "), F.col("elsewhere"), F.lit(" ("), F.col("elsewhere_high"), F.lit(" HIGH, "), F.col("elsewhere_medium"), F.lit(" MEDIUM)"))),
        F.when(F.col("detected_after_h").isNotNull(), F.concat(F.lit("- Detected "), F.col("detected_after_h"), F.lit(" h after it"))),
    ]
    lines = head.select("aoi", F.lit(0).alias("section"), F.posexplode(F.array(*listed)).alias("place", "line")).where("line is not null")
    minute = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm")
    told = top_by(alert, ["aoi"], 1 << 30, F.col("available"), F.col("site_id")).withColumns({"available": minute("available"), "lead": text("lead_h")})
    moves = top_by(change.where("kind = 'mass_movement'"), ["aoi"], MOST_MOVES, F.col("area_km2").desc(), F.col("at"), F.col("lon")).withColumn("when", F.date_format("at", "yyyy-MM-dd HH:mm"))
    return lines.unionByName(exports.section(told, "aoi", 1, "Alerts", ["available", "lead", "code", "level", "kind"])).unionByName(exports.section(moves, "aoi", 2, "Largest mass movements", ["when", "area_km2", "km"]))


def write_report(parts: dict[str, DataFrame], lines: DataFrame, path: str) -> None:
    """Each part as JSON lines in a folder of its name, and the lines as text, all by area. A rerun replaces what it writes."""
    for name, part in parts.items():
        part.repartition("aoi").write.mode("overwrite").partitionBy("aoi").json(f"{path}/{name}")
    ordered = lines.repartition("aoi").sortWithinPartitions("aoi", "section", "place")
    ordered.select("aoi", "line").write.mode("overwrite").partitionBy("aoi").text(f"{path}/report")
