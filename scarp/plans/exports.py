"""Metrics, feeds, report tables and the monitoring cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection, exports, joins, tables
from ..sources import views
from ..streaming import cycle, jobs
from .inventory import CHANGES, _changes


def metric_lines(spark, sf):
    """Sites by level and acquisitions by status, as lines of a metrics page."""
    a = exports.gauges(views.sites(spark, sf), "sites", "level", F.count("*"))
    return a.union(exports.gauges(views.acquisitions(spark, sf), "scenes", "status", F.count("*")))


def feed_entries(spark, sf):
    rows = views.acquisitions(spark, sf).where("status = 'processed'").select(F.concat(F.lit("a-"), "key").alias("uid"), F.concat(F.lit("Scene <"), F.col("sensor"), F.lit("> & more")).alias("title"), F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return exports.atom_entries(rows)


def report_lines(spark, sf):
    """The largest events of each sensor as lines of a report."""
    rows = views.acquisitions(spark, sf).groupBy("sensor", "status").agg(F.count("*").alias("n"), F.max("key").alias("last"))
    return exports.table_lines(rows, ["sensor", "status", "n", "last"])


def area_reports(spark, sf):
    """A report for each area of interest: its sites by level, the ten largest mass movements, its last seven acquisitions."""
    levels = views.sites(spark, sf).groupBy("aoi", "level").agg(F.count("*").alias("sites"))
    levels = levels.withColumn("place", 2 - joins.rank(F.col("level"))).withColumn("aoi", F.col("aoi").cast("long"))
    moves = tables.top_by(_changes(spark, sf).where("confidence >= 0.7 and not snow_like").withColumn("aoi", F.col("aoi").cast("long")), ["aoi"], 10, F.col("area").desc(), F.col("id")).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    acq = views.acquisitions(spark, sf).withColumn("aoi", (F.col("key") % 25).cast("long"))
    last = tables.top_by(acq, ["aoi"], 7, F.col("acquired_at").desc(), F.col("key").desc()).withColumn("time", F.date_format("acquired_at", "yyyy-MM-dd HH:mm"))
    lines = exports.section(levels, "aoi", 1, "Sites by level", ["level", "sites"]).unionByName(exports.section(moves, "aoi", 2, "Largest mass movements", ["id", "day"])).unionByName(exports.section(last, "aoi", 3, "Last acquisitions", ["key", "time", "status"]))
    return exports.documents(lines, "aoi")


def lake_benchmark(spark, sf):
    """Lakes that were found against known ones: the nearest within two kilometres, and the error of its area."""
    known = views.assets(spark, sf).where("kind = 'town'").select(F.col("asset_id").alias("id"), "lon", "lat", (F.abs("height_m") + 100).alias("area"))
    found = views.sites(spark, sf).select(F.col("site_id").alias("id"), "lon", "lat", (F.abs("z") + 50).alias("area"))
    out = detection.confusion_of_lakes(found, known, 2.0)
    return out.select("id", "nearest", F.round("error_pct", 5).alias("error_pct"))


def monitoring_cycle(spark, sf):
    """Events as scenes through the cycle: what each site would be re-scored at."""
    rows = jobs.observations(spark, f"{sf}/events*.parquet").select(
        F.col("event_id").alias("key"), F.col("user_id").alias("site_id"), F.col("ts").alias("acquired_at"), F.when(F.col("event_type") == "error", "error").when(F.col("value") < 5, "empty").otherwise("ok").alias("outcome")
    )
    run = cycle.Cycle(spark)
    return run.run(rows).groupBy("site_id", "status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (metric_lines, feed_entries, report_lines, area_reports, lake_benchmark, monitoring_cycle)}
ORACLES = {
    "metric_lines": f"WITH {views.SITES}, {views.ACQ} SELECT 'sites{{level=\"' || level || '\"}} ' || count(*) AS line FROM site GROUP BY level UNION ALL SELECT 'scenes{{status=\"' || status || '\"}} ' || count(*) FROM acq GROUP BY status",
    "feed_entries": f"WITH {views.ACQ}, t AS (SELECT strftime(acquired_at, '%Y-%m-%dT%H:%M:%S') AS \"at\", 'a-' || key AS uid, sensor FROM acq WHERE status = 'processed') SELECT \"at\", uid, '<entry><id>' || uid || '</id><title>Scene &lt;' || sensor || '&gt; &amp; more</title><updated>' || \"at\" || '</updated></entry>' AS entry FROM t ORDER BY \"at\" DESC, uid LIMIT 50",
    "report_lines": f"WITH {views.ACQ} SELECT '| ' || sensor || ' | ' || status || ' | ' || count(*) || ' | ' || max(key) || ' |' AS line FROM acq GROUP BY sensor, status",
    "area_reports": f"""WITH {CHANGES}, {views.ACQ}, h(section, place, line) AS (VALUES (1, -9, '## Sites by level'), (1, -8, ''), (1, -7, '| level | sites |'), (1, -6, '|---|---|'), (2, -9, '## Largest mass movements'), (2, -8, ''), (2, -7, '| id | day |'), (2, -6, '|---|---|'), (3, -9, '## Last acquisitions'), (3, -8, ''), (3, -7, '| key | time | status |'), (3, -6, '|---|---|---|')),
 r AS (SELECT aoi::BIGINT AS aoi, 1 AS section, CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS place, '| ' || level || ' | ' || count(*) || ' |' AS line FROM site GROUP BY aoi, level
 UNION ALL SELECT aoi, 2, k, '| ' || id || ' | ' || strftime("at", '%Y-%m-%d') || ' |' FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY area DESC, id) AS k FROM ch WHERE confidence >= 0.7 AND NOT snow_like) WHERE k <= 10
 UNION ALL SELECT key % 25, 3, k, '| ' || key || ' | ' || strftime(acquired_at, '%Y-%m-%d %H:%M') || ' | ' || status || ' |' FROM (SELECT *, row_number() OVER (PARTITION BY key % 25 ORDER BY acquired_at DESC, key DESC) AS k FROM acq) WHERE k <= 7),
 l AS (SELECT * FROM r UNION ALL SELECT aoi, section, place, line FROM h JOIN (SELECT DISTINCT aoi, section FROM r) USING (section)) SELECT aoi, string_agg(line, chr(10) ORDER BY section, place, line) AS text FROM l GROUP BY 1""",
    "lake_benchmark": f"WITH {views.SITES}, {views.ASSETS}, p AS (SELECT a.asset_id AS id, site_id, abs(height_m) + 100 AS ka, abs(z) + 50 AS fa, sqrt(pow((a.lon - s.lon) * 111.32::DOUBLE * cos(radians(a.lat)), 2) + pow((a.lat - s.lat) * 110.57::DOUBLE, 2)) AS km FROM asset a JOIN site s ON a.kind = 'town'), m AS (SELECT id, arg_min(site_id, (round(km, 9), site_id)) AS nearest, arg_min(100 * (fa - ka) / ka, (round(km, 9), site_id)) AS e FROM p WHERE km < 2 GROUP BY 1) SELECT id, nearest, round(e, 5) AS error_pct FROM m",
    "monitoring_cycle": "SELECT user_id AS site_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 5 THEN 'skipped' ELSE 'processed' END AS status, count(*) AS n FROM events GROUP BY 1, 2",
}
