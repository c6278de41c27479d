"""Replays of an area's evidence against an event: assessments, alerts, and the parts of the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay
from ..sources import views
from ..sources.shared import saved
from .rescoring import REPLAY_SQL, RESCORED_SQL, first_places, replay_alerts, replay_assessments, scenes_of
from .statistics import six

EVENT_AT = "2024-01-20 06:30:00"


def _events(spark, sf):
    """One event an area, at its first site's place; every sixth area has none."""
    first = views.sites(spark, sf).groupBy("aoi").agg(F.min(F.struct("site_id", "lon", "lat")).alias("s"))
    at = F.when(F.col("aoi") % 6 != 0, F.lit(EVENT_AT).cast("timestamp_ntz"))
    return first.select("aoi", at.alias("event_at"), (F.col("s.lon") + 0.004).alias("event_lon"), F.col("s.lat").alias("event_lat"))


def _changes(spark, sf):
    obs = views.monitored(spark, sf).where("kind = 'sar_change'")
    kind = F.when(F.col("event_id") % 3 == 0, "snow").otherwise("mass_movement")
    return obs.join(views.sites(spark, sf).select("site_id", "aoi", "lon", "lat"), "site_id").select("aoi", kind.alias("kind"), F.col("observed_at").alias("at"), "lon", "lat", F.col("v").alias("area_m2"), F.col("quality").alias("confidence"))


def _parts(spark, sf):
    events = _events(spark, sf)
    told = saved(replay_assessments(spark, sf))
    sites = views.sites(spark, sf)
    alert = saved(replay.alert_rows(replay_alerts(told), sites, events))
    site = replay.site_rows(told, views.observations(spark, sf), sites, first_places(spark, sf), events)
    return events, site, alert, replay.change_rows(_changes(spark, sf), events)


def hindcast_sites(spark, sf):
    _, site, _, _ = _parts(spark, sf)
    return site.select("aoi", "site_id", *six("km"), "assessments", "observations", "before_level", F.round("before_score", 4).alias("before_score"), "before_at", "before_reasons", "places")


def hindcast_alerts(spark, sf):
    _, _, alert, _ = _parts(spark, sf)
    return alert.select("aoi", "site_id", *six("km"), "level", "kind", "at", "available", "lead_h", "pre_event", "status")


def hindcast_summary(spark, sf):
    events, site, alert, change = _parts(spark, sf)
    return replay.summary(site, alert, change, events).join(replay.scene_counts(scenes_of(spark, sf)), "aoi", "left").fillna(0, ["s1", "s2", "skipped", "failed"])


QUERIES = {f.__name__: f for f in (hindcast_sites, hindcast_alerts, hindcast_summary)}

HOUR = 3600_000_000
_KM = "sqrt(pow((lon - elon) * 111.32::DOUBLE * cos(radians(lat)), 2) + pow((lat - elat) * 110.57::DOUBLE, 2))"
_PARTS = f"""ev0 AS (SELECT aoi, min((site_id, lon, lat)) AS s FROM site GROUP BY 1), ev AS (SELECT aoi, CASE WHEN aoi % 6 <> 0 THEN epoch_us(TIMESTAMP '{EVENT_AT}') END AS eat, s[2] + 0.004::DOUBLE AS elon, s[3] AS elat FROM ev0),
 pl AS (SELECT site_id, aoi, {_KM} AS km, eat FROM site JOIN ev USING (aoi)),
 alr AS (SELECT aoi, site_id, km, level, kind, assessment_id AS "at", assessment_id + {6 * HOUR} AS available, round((eat - assessment_id - {6 * HOUR}) / 3600e6::DOUBLE, 1) AS lead_h, assessment_id + {6 * HOUR} < eat AS pre_event, status FROM decided JOIN pl USING (site_id)),
 be AS (SELECT site_id, count(*) AS assessments, arg_max(CASE WHEN early THEN (level, score, "at", reasons) END, CASE WHEN early THEN (score, -"at") END) AS b FROM (SELECT src.*, reasons, eat IS NULL OR "at" < eat AS early FROM src JOIN (SELECT site_id, "at", reasons FROM rs) USING (site_id, "at") JOIN pl USING (site_id)) GROUP BY 1),
 nm AS (SELECT site_id, string_agg(name, ',' ORDER BY k) AS places FROM (SELECT site_id, name, row_number() OVER (PARTITION BY site_id ORDER BY minutes * 8 / sp, name) AS k FROM fact JOIN sp USING (site_kind) JOIN exposed ON path_id = aoi WHERE name <> '') WHERE k <= 8 GROUP BY 1),
 sr AS (SELECT aoi, pl.site_id, km, assessments, (SELECT count(*) FROM obs WHERE obs.site_id = pl.site_id) AS observations, b[1] AS before_level, b[2] AS before_score, b[3] AS before_at, b[4] AS before_reasons, coalesce(places, '') AS places FROM pl JOIN be USING (site_id) LEFT JOIN nm USING (site_id)),
 chd AS (SELECT aoi, CASE WHEN event_id % 3 = 0 THEN 'snow' ELSE 'mass_movement' END AS kind, epoch_us(observed_at) AS "at", round({_KM}, 2) AS km, quality, eat FROM mon JOIN site USING (site_id) JOIN ev USING (aoi) WHERE mon.kind = 'sar_change' AND v >= 50000),
 wa AS (SELECT *, coalesce(pre_event, false) AND kind <> 'all_clear' AS early, coalesce(pre_event, false) AND kind <> 'all_clear' AND km <= 2 AND lead_h <= 720 AS warning FROM alr),
 sa AS (SELECT aoi, count(*) AS alerts, min(CASE WHEN warning THEN (available, lead_h, level) END) AS f, count(CASE WHEN early AND NOT warning THEN 1 END) AS elsewhere, count(CASE WHEN early AND NOT warning AND level = 'medium' THEN 1 END) AS em, count(CASE WHEN early AND NOT warning AND level = 'high' THEN 1 END) AS eh FROM wa GROUP BY 1),
 sl AS (SELECT aoi, arg_max(before_level, CASE before_level WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS hb FROM sr WHERE km <= 2 AND before_level IS NOT NULL GROUP BY 1),
 sd AS (SELECT aoi, round(min("at" - eat) / 3600e6::DOUBLE, 1) AS late FROM chd WHERE kind = 'mass_movement' AND quality >= 0.7 AND km > 0 AND km <= 5 AND "at" > eat GROUP BY 1),
 sc_ AS (SELECT aoi, count(CASE WHEN status = 'processed' AND sensor = 'S1' THEN 1 END) AS s1, count(CASE WHEN status = 'processed' AND sensor = 'S2' THEN 1 END) AS s2, count(CASE WHEN status = 'skipped' THEN 1 END) AS skipped, count(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM scn GROUP BY 1)"""

_WITH = f"WITH RECURSIVE {RESCORED_SQL}, {REPLAY_SQL}, {_PARTS}"

ORACLES = {
    "hindcast_sites": f"{_WITH} SELECT aoi, site_id, round(km, 6) AS km, assessments, observations, before_level, round(before_score, 4) AS before_score, before_at, before_reasons, places FROM sr",
    "hindcast_alerts": f"{_WITH} SELECT aoi, site_id, round(km, 6) AS km, level, kind, \"at\", available, lead_h, pre_event, status FROM alr",
    "hindcast_summary": f"""{_WITH} SELECT ev.aoi, coalesce(alerts, 0) AS alerts, CASE WHEN eat IS NOT NULL THEN f IS NOT NULL END AS warned, f[2] AS lead_h, f[3] AS first_level, CASE WHEN eat IS NOT NULL THEN hb END AS highest_before, CASE WHEN eat IS NOT NULL THEN coalesce(elsewhere, 0) END AS elsewhere,
 CASE WHEN eat IS NOT NULL THEN coalesce(em, 0) END AS elsewhere_medium, CASE WHEN eat IS NOT NULL THEN coalesce(eh, 0) END AS elsewhere_high, late AS detected_after_h, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed
 FROM ev LEFT JOIN sa USING (aoi) LEFT JOIN sl USING (aoi) LEFT JOIN sd USING (aoi) LEFT JOIN sc_ USING (aoi)""",
}
