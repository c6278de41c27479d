"""Re-scoring: every site at every time at which it was observed, from observations to alerts, in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, replay, risk, sweep, tables
from ..sources import views
from .lifecycle import fold_sql
from .relations import PATHS_SQL, flow_paths_of_areas
from .statistics import AS_OF, MONTH, as_of, ice_sql, event_sql, fracture_sql, insar_sql, lake_sql, r6, six


def kind_exposure(spark, sf):
    """Exposed assets of each area's path by the kinds of its sites (aoi, site_kind), reached at the speed of the kind. Sites of
    one area and kind share them, so they are not repeated for each site."""
    speed = F.create_map(*[F.lit(x) for p in risk.WAVE_SPEED.items() for x in p])[F.col("site_kind")]
    assets = joins.exposed_assets(flow_paths_of_areas(spark, sf), views.assets(spark, sf), 1.5, 1.0)
    kinds = views.site_facts(spark, sf).select("site_kind", "aoi").distinct()
    return kinds.join(assets.withColumnRenamed("path_id", "aoi"), "aoi").withColumn("minutes", F.col("minutes") / speed)


def site_exposure(spark, sf):
    """The score of each site's exposure, that of its area and kind."""
    each = risk.exposure_score(kind_exposure(spark, sf), ["aoi", "site_kind"])
    return views.site_facts(spark, sf).select("site_id", "aoi", "site_kind").join(each, ["aoi", "site_kind"]).drop("aoi", "site_kind")


def first_places(spark, sf):
    """(site_id, name, minutes) of the named assets that a flood of each site reaches first, as many as a report shows."""
    named = kind_exposure(spark, sf).where("name <> ''")
    first = tables.top_by(named, ["aoi", "site_kind"], replay.MOST_PLACES, F.col("minutes"), F.col("name")).select("aoi", "site_kind", "name", "minutes")
    return views.site_facts(spark, sf).select("site_id", "aoi", "site_kind").join(first, ["aoi", "site_kind"]).select("site_id", "name", "minutes")


def exposure_scores(spark, sf):
    return site_exposure(spark, sf).select("site_id", *six("exposure", "weighted"), "assets")


def _times(spark, sf):
    known = views.site_facts(spark, sf).select("site_id")
    return views.observations(spark, sf).select("site_id", F.col("observed_at").alias("as_of")).distinct().join(known, "site_id", "left_semi")


def _assessed(spark, sf):
    exposure = site_exposure(spark, sf)
    return risk.assessed(views.monitored(spark, sf), _times(spark, sf), views.site_facts(spark, sf), exposure, MONTH)


def _micros():
    return F.unix_micros(F.col("as_of").cast("timestamp")).alias("at")


def reassess_all(spark, sf):
    """Assessments of all sites at all times."""
    out = _assessed(spark, sf)
    return out.select("site_id", _micros(), *[F.round(c, 4).alias(c) for c in ("hazard", "dynamic", "score", "exposure")], F.round("confidence", 6).alias("confidence"), "level", "needs_confirmation", "alertable", "reasons")


def noisy_or_risk(spark, sf):
    """All sites at one time: features by kind, gated indicators, hazard, exposure and level."""
    sites = views.site_facts(spark, sf)
    exposure = site_exposure(spark, sf)
    out = risk.assessed(views.monitored(spark, sf), sites.select("site_id", as_of().alias("as_of")), sites, exposure, MONTH)
    return out.select("site_id", *[F.round(c, 4).alias(c) for c in ("hazard", "dynamic", "score", "exposure")], "level", "alertable", "needs_confirmation", "reasons")


def site_indicators(spark, sf):
    """Features by site and time, as the model sees them: the number, least, mean and largest value of each."""
    long = sweep.site_features(views.monitored(spark, sf), _times(spark, sf), views.site_facts(spark, sf), MONTH).where("x is not null")
    return long.groupBy("site_kind", "feature").agg(F.count("*").alias("n"), F.round(F.min("x"), 5).alias("least"), F.round(F.avg("x"), 5).alias("mean"), F.round(F.max("x"), 5).alias("most"))


def scenes_of(spark, sf):
    """Scenes of areas, at the times at which their sites were observed: most were processed, some skipped, some failed."""
    obs = views.observations(spark, sf).join(views.sites(spark, sf).select("site_id", "aoi"), "site_id")
    k = F.col("event_id")
    return obs.select("aoi", F.col("observed_at").alias("acquired_at"), "sensor", F.when(k % 7 == 0, "failed").when(k % 5 == 0, "skipped").otherwise("processed").alias("status"))


def replay_assessments(spark, sf):
    exposure = site_exposure(spark, sf)
    sites = views.site_facts(spark, sf)
    out = replay.reassessed(views.monitored(spark, sf), scenes_of(spark, sf), sites, exposure, MONTH)
    return out.withColumns({"score": F.round("score", 4), "dynamic": F.round("dynamic", 4), "assessment_id": F.col("at")})


def replay_alerts(assessments):
    return replay.undispatched(assessments)


def reassessed_alerts(spark, sf):
    """The alerts that a replay of the processed scenes leads to, decided six hours after each and never sent."""
    return replay_alerts(replay_assessments(spark, sf)).select("site_id", "at", "available", "level", "kind", "previous_level", "superseded", "status")


QUERIES = {f.__name__: f for f in (noisy_or_risk, exposure_scores, reassess_all, site_indicators, reassessed_alerts)}

_K = "site_id, as_of"
_WEIGHTS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in risk.ASSET_WEIGHT.items())
_SPEEDS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in risk.WAVE_SPEED.items())
EXPOSURE_SQL = f"""{PATHS_SQL}, {views.FACTS}, wt(kind, wt) AS (VALUES {_WEIGHTS}), sp(site_kind, sp) AS (VALUES {_SPEEDS}),
 expo AS (SELECT site_id, sum(wt * exp(-(minutes * 8 / sp) / 180)) AS weighted, count(*) AS assets FROM fact JOIN sp USING (site_kind) JOIN exposed ON path_id = aoi JOIN wt USING (kind) GROUP BY 1),
 exps AS (SELECT *, 1 - exp(-weighted / 12) AS exposure FROM expo)"""
_MODEL = ", ".join(f"('{f}', {a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE, {str(d).lower()}, {repr(g) if g else 'NULL'}, {fl}::DOUBLE, '{kind}')" for f, a, b, w, d, g, fl, kinds in risk.MODEL for kind in kinds)
FEATURES_SQL = f"""{views.MONITORED}, tm AS (SELECT DISTINCT site_id, observed_at AS as_of FROM obs WHERE site_id IN (SELECT site_id FROM site)),
 ar AS MATERIALIZED (SELECT tm.as_of, mon.*, fact.site_kind, fact.slope, date_diff('microsecond', observed_at, tm.as_of) / 86400e6::DOUBLE AS age FROM tm JOIN mon USING (site_id) JOIN fact USING (site_id) WHERE observed_at <= tm.as_of AND date_diff('microsecond', observed_at, tm.as_of) <= {MONTH.reach} * 86400e6::DOUBLE),
 arl AS (SELECT * FROM ar WHERE site_kind IN ('glacial_lake', 'barrier_lake')), ari AS (SELECT * FROM ar WHERE site_kind IN ('glacier', 'slope')),
 {lake_sql("arl", _K)}, {event_sql("ar", _K, "sar_change", "chg")}, {fracture_sql("ar", _K)}, {ice_sql("ari", _K)}, {insar_sql("ari", _K)},
 slid AS (SELECT {_K}, max(v) AS slid, least(0.8::DOUBLE, 0.3::DOUBLE + 0.2::DOUBLE * least(count(*), 2) + CASE WHEN max(quality) >= 0.8 THEN 0.1::DOUBLE ELSE 0 END) AS confidence FROM ar WHERE site_kind = 'landslide' AND kind = 'sar_change' AND age <= {MONTH.event} GROUP BY {_K}),
 kn AS (SELECT tm.as_of, fact.* FROM tm JOIN fact USING (site_id)),
 flk AS (SELECT kn.site_id, kn.as_of, site_kind, coalesce(l.confidence, 0.1::DOUBLE) AS confidence, [walls, coalesce(l.glacier_m, kn.glacier_m), CASE WHEN site_kind = 'barrier_lake' THEN 1.0::DOUBLE END, growth_pct, annual_growth_pct, CASE WHEN l.confidence IS NULL THEN nullif(kn.area, 0) ELSE l.area END / 1e6, turbidity_rise,
 CASE WHEN l.confidence IS NOT NULL THEN area_sum / 1e6 END, CASE WHEN l.confidence IS NOT NULL THEN new_length END] AS xs, ['steep_walls_deg', 'glacier_contact_m', 'barrier_lake', 'lake_growth_recent_pct', 'lake_growth_annual_pct', 'lake_area_km2', 'turbidity_rise', 'sar_change_km2', 'new_fractures_m'] AS fs
 FROM kn LEFT JOIN lake l USING ({_K}) LEFT JOIN chg USING ({_K}) LEFT JOIN crack USING ({_K}) WHERE site_kind IN ('glacial_lake', 'barrier_lake')),
 fic AS (SELECT kn.site_id, kn.as_of, site_kind, coalesce(i.confidence, 0.15::DOUBLE) AS confidence, [kn.slope, speed, steep_speed, i.z, ratio, trend, mm_per_month, los_ratio, area_sum / 1e6, new_length] AS xs, ['source_slope_deg', 'velocity_m_day', 'velocity_steep_m_day', 'velocity_z', 'velocity_ratio', 'velocity_trend', 'insar_mm_month', 'insar_ratio', 'sar_change_km2', 'new_fractures_m'] AS fs
 FROM kn LEFT JOIN ice i USING ({_K}) LEFT JOIN los USING ({_K}) LEFT JOIN chg USING ({_K}) LEFT JOIN crack USING ({_K}) WHERE site_kind IN ('glacier', 'slope')),
 fsl AS (SELECT kn.site_id, kn.as_of, site_kind, coalesce(s.confidence, 0.3::DOUBLE) AS confidence, [slid / 1e6] AS xs, ['landslide_area_km2'] AS fs FROM kn LEFT JOIN slid s USING ({_K}) WHERE site_kind = 'landslide'),
 fw AS (SELECT * FROM flk UNION ALL SELECT * FROM fic UNION ALL SELECT * FROM fsl), feat AS (SELECT site_id, as_of, site_kind, confidence, unnest(xs) AS x, unnest(fs) AS feature FROM fw)"""
RESCORED_SQL = f"""{EXPOSURE_SQL}, {FEATURES_SQL}, md(feature, x0, x1, weight, dyn, gate, flo, site_kind) AS (VALUES {_MODEL}),
 sc0 AS (SELECT site_id, as_of, feature, weight, dyn, gate, flo, greatest(0, least(1, (x - x0) / (x1 - x0))) AS s FROM feat JOIN md USING (feature, site_kind) WHERE x IS NOT NULL),
 sc AS (SELECT a.site_id, a.as_of, a.feature, a.weight, a.dyn, a.weight * CASE WHEN a.gate IS NULL THEN a.s ELSE a.s * greatest(a.flo, coalesce(g.s, 0)) END AS part FROM sc0 a LEFT JOIN sc0 g ON a.site_id = g.site_id AND a.as_of = g.as_of AND a.gate = g.feature),
 hz AS (SELECT site_id, as_of, 1 - product(1 - part) AS hazard, 1 - product(CASE WHEN dyn THEN 1 - part ELSE 1 END) AS dynamic, coalesce(string_agg(CASE WHEN part >= 0.05 THEN feature END, ',' ORDER BY -round(part, 6), feature), '') AS reasons FROM sc GROUP BY 1, 2),
 ctx AS (SELECT f.site_id, f.as_of, f.confidence, coalesce(e.exposure, 0) AS exposure, coalesce(hazard, 0) AS hazard, coalesce(dynamic, 0) AS dynamic, coalesce(reasons, '') AS reasons FROM fw f LEFT JOIN exps e USING (site_id) LEFT JOIN hz USING ({_K})),
 rs0 AS (SELECT *, hazard * (0.4::DOUBLE + 0.6::DOUBLE * exposure) AS score FROM ctx),
 rs AS (SELECT *, epoch_us(as_of) AS "at", score >= 0.6 AND confidence < 0.3 AND dynamic >= 0.15 AS needs_confirmation, dynamic >= 0.15 AS alertable, CASE WHEN score >= 0.6 AND NOT (dynamic < 0.15 OR confidence < 0.3) THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS level FROM rs0)"""
LATENCY = 6 * 3600_000_000
ALL_TIMES = "tm AS (SELECT DISTINCT site_id, observed_at AS as_of FROM obs WHERE site_id IN (SELECT site_id FROM site))"
ONE_TIME = f"tm AS (SELECT site_id, TIMESTAMP '{AS_OF}' AS as_of FROM site)"
REPLAY_SQL = f"""scn AS (SELECT aoi, observed_at, sensor, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'skipped' ELSE 'processed' END AS status FROM obs JOIN site USING (site_id)),
 src AS (SELECT rs."at" AS assessment_id, rs.site_id, rs."at", round(score, 4) AS score, rs.level, round(dynamic, 4) AS dynamic, needs_confirmation FROM rs JOIN site s USING (site_id) WHERE EXISTS (SELECT 1 FROM scn WHERE scn.aoi = s.aoi AND scn.observed_at = rs.as_of AND status = 'processed')),
 {fold_sql('src', "''", LATENCY).replace('q.assessment_id = o.a2', 'q.assessment_id = o.a2 AND q.site_id = o.site_id')}"""
ORACLES = {
    "exposure_scores": f"WITH {EXPOSURE_SQL} SELECT site_id, {r6('exposure, weighted')}, assets FROM exps",
    "noisy_or_risk": f"WITH {RESCORED_SQL.replace(ALL_TIMES, ONE_TIME)} SELECT site_id, round(hazard, 4) AS hazard, round(dynamic, 4) AS dynamic, round(score, 4) AS score, round(exposure, 4) AS exposure, level, alertable, needs_confirmation, reasons FROM rs",
    "reassess_all": f"WITH {RESCORED_SQL} SELECT site_id, \"at\", round(hazard, 4) AS hazard, round(dynamic, 4) AS dynamic, round(score, 4) AS score, round(exposure, 4) AS exposure, round(confidence, 6) AS confidence, level, needs_confirmation, alertable, reasons FROM rs",
    "site_indicators": f"WITH {EXPOSURE_SQL}, {FEATURES_SQL} SELECT site_kind, feature, count(*) AS n, round(min(x), 5) AS least, round(avg(x), 5) AS mean, round(max(x), 5) AS most FROM feat WHERE x IS NOT NULL GROUP BY 1, 2",
    "reassessed_alerts": f"WITH RECURSIVE {RESCORED_SQL}, {REPLAY_SQL} SELECT site_id, assessment_id AS \"at\", assessment_id + {LATENCY} AS available, level, kind, previous_level, superseded, status FROM decided",
}
