"""What an API would read: events, sites, observations, alerts, reports, and the records that it returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry, phrases, scalars, spectral
from ..operators import alerts, joins, reads, stats, tables
from ..sources import views
from .inventory import CHANGES, _changes
from .pixels import BANDS, _bands
from .statistics import AS_OF, as_of, six
from .terrain import utm_sql

_OBS_DAY = "date_diff('microsecond', observed_at, TIMESTAMP '{t}') / 86400e6::DOUBLE"


def api_events(spark, sf):
    """Events of two kinds and a least area in the last two years of the table, newest first, at most 5,000."""
    e = _changes(spark, sf).withColumn("kind", F.when(F.col("id") % 4 == 0, "mass_movement").when(F.col("id") % 4 == 1, "velocity_hotspot").otherwise("vegetation_loss"))
    out = reads.events(e, as_of("1999-01-01 00:00:00"), as_of("2000-12-31 00:00:00"), ["mass_movement", "velocity_hotspot"])
    return out.select("id", "kind", F.date_format("at", "yyyy-MM-dd").alias("day"), F.round("area", 2).alias("area"))


def api_observations(spark, sf):
    """Observations of each site and kind in the last ten days, ascending, as a chart reads them."""
    out = reads.observations(views.observations(spark, sf), as_of() - F.expr("INTERVAL 10 DAYS"))
    return out.select("site_id", "kind", "place", "event_id", *six("v"))


def site_details(spark, sf):
    """Each site with its latest observation, its ten newest alerts' ids and its three nearest assets: a point read by code is
    a filter on this."""
    s = views.sites(spark, sf).select("site_id", "code", "kind", "level", "lon", "lat")
    obs = views.observations(spark, sf)
    last = obs.groupBy("site_id").agg(F.max_by(F.struct("event_id", F.round("v", 6).alias("v")), F.struct("observed_at", "event_id")).alias("last"))
    newest = tables.top_by(obs.where("v > 60"), ["site_id"], 10, F.col("observed_at").desc(), F.col("event_id").desc()).groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("place", "event_id"))).alias("a"))
    near = joins.nearest_few(s, views.assets(spark, sf), 5.0, 3, "site_id", "asset_id")
    few = near.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("place", "asset_id"))).alias("x"))
    ids = lambda c, f: F.array_join(F.transform(c, lambda r: r[f].cast("string")), ",")
    out = s.join(last, "site_id", "left").join(newest, "site_id", "left").join(few, "site_id", "left")
    return out.select("code", "kind", "level", F.col("last.event_id").alias("event_id"), F.col("last.v").alias("v"), F.coalesce(ids("a", "event_id"), F.lit("")).alias("alerts"), F.coalesce(ids("x", "asset_id"), F.lit("")).alias("assets"))


def hindcast_reports(spark, sf):
    """Reports as text, some of them cut off: their summaries and numbers of alerts, unreadable ones skipped."""
    obs = views.observations(spark, sf)
    r = obs.groupBy("site_id").agg(F.count("*").alias("n"), F.round(F.max("v"), 5).alias("top"), F.sort_array(F.collect_list(F.when(F.col("v") > 80, F.col("event_id")))).alias("ids"))
    body = F.to_json(F.struct(F.col("site_id").alias("name"), F.struct("n", "top").alias("summary"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("alerts")))
    text = F.when(F.col("site_id") % 7 == 0, F.substring(body, 1, 25)).otherwise(body)
    parsed = reads.readable_reports(r.select(text.alias("text")), "name long, summary struct<n:long,top:double>, alerts array<struct<id:long>>")
    return parsed.select(F.col("name").alias("site_id"), "summary.n", "summary.top", F.size("alerts").alias("alerts"))


def saved_reports(spark, sf):
    """Reports of sites as compact text, all numbers rounded to five places."""
    r5 = lambda c: stats.settled(F.col(c) if isinstance(c, str) else c, 5)
    g = views.observations(spark, sf).groupBy("site_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.sort_array(F.collect_list(F.when(F.col("v") > 95, F.col("v")))).alias("top"))
    return g.select("site_id", F.to_json(F.struct("n", r5("mean").alias("mean"), F.transform("top", r5).alias("top"))).alias("report"))


def alert_records(spark, sf):
    """Public records of alerts: with their site, the hazard in words, and the place of each in the site's queue of review."""
    a = views.acquisitions(spark, sf).select(F.col("key").alias("uid"), (F.col("orbit") + 1 + F.col("key") % 90).alias("site_id"), F.when(F.col("status") == "pending", "pending_review").otherwise("dispatched").alias("status"), "acquired_at")
    s = views.sites(spark, sf).select("site_id", "code", F.col("kind").alias("site_kind"))
    hazard = phrases.phrase(phrases.HAZARD, F.when(F.col("site_kind") == "slope", "other").otherwise(F.col("site_kind")), "en", phrases.ANY_HAZARD["en"])
    rows = tables.top_by(a.join(s, "site_id"), ["code", "status"], 200, F.col("acquired_at").desc(), F.col("uid").desc())
    return rows.select("uid", "code", "status", "place", hazard.alias("hazard"), F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("issued"))


def subscriber_records(spark, sf):
    """Subscribers written by name: areas must be polygons, others are refused; a later entry of a name replaces the earlier."""
    k = F.col("sub_id")
    kind = F.when(k % 6 == 0, F.lit("Point")).otherwise("Polygon")
    area = F.when(k % 4 != 0, F.to_json(F.struct(kind.alias("type"), F.array(F.lit(1.0)).alias("coordinates"))))
    s = views.subscribers(spark, sf).select("sub_id", F.concat(F.lit("n"), F.floor(k / 2)).alias("name"), "language", "min_level", "active", area.alias("area"))
    fine = F.col("area").isNull() | F.get_json_object("area", "$.type").isin("Polygon", "MultiPolygon")
    return tables.latest(s.where(fine), ["name"], F.col("sub_id").desc()).select("name", "sub_id", "language", "min_level", "active", F.col("area").isNotNull().alias("bounded"))


def parsed_times(spark, sf):
    """Times as catalogues write them, with Z, with an offset or with neither (then UTC), as one instant."""
    at, k = F.col("acquired_at"), F.col("key")
    text = F.when(k % 3 == 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k % 3 == 1, F.concat(F.date_format(at + F.expr("INTERVAL 345 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:45"))).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    return views.acquisitions(spark, sf).select("key", F.unix_micros(scalars.instant(text)).alias("micros"))


def top_movements(spark, sf):
    """The ten largest mass movements of each area of interest, as a report lists them."""
    e = _changes(spark, sf).where("confidence >= 0.7 and not snow_like")
    return tables.top_by(e, ["aoi"], 10, F.col("area").desc(), F.col("id")).select("aoi", "place", "id", F.round("area", 2).alias("area"))


def todo_list(spark, sf):
    """Acquisitions since a start that are neither processed nor skipped, in order of time within their sensor."""
    acq = views.acquisitions(spark, sf).where((F.col("acquired_at") >= as_of("2000-06-01 00:00:00")) & ~F.col("status").isin("processed", "skipped"))
    place = F.row_number().over(Window.partitionBy("sensor").orderBy("acquired_at", "key"))
    return acq.select("sensor", "key", place.alias("place"))


def redispatched_alerts(spark, sf):
    """Alerts with a failed delivery, once each, with the channels that failed and the attempts so far."""
    l = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("alert_id"), F.get(F.array(F.lit("sms"), F.lit("email"), F.lit("webhook")), (F.col("l_linenumber") % 3).cast("int")).alias("channel"), (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_quantity") % 4).cast("int").alias("attempts"))
    return l.groupBy("alert_id").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("failed"), F.col("channel")))), ",").alias("channels"), F.max("attempts").alias("attempts"), F.bool_or("failed").alias("_f")).where("_f").drop("_f")


def near_events(spark, sf):
    """Distance of each change from its area's largest one, by degrees alone as reports give it, and in kilometres."""
    e = _changes(spark, sf)
    big = e.groupBy("aoi").agg(F.max_by(F.struct("lon", "lat"), F.struct("area", "id")).alias("b"))
    flat = F.hypot(F.col("lon") - F.col("b.lon"), F.col("lat") - F.col("b.lat")) * 111.0
    real = joins.km(F.col("lon"), F.col("lat"), F.col("b.lon"), F.col("b.lat"))
    return e.join(big, "aoi").groupBy("aoi").agg(F.round(F.avg(flat), 5).alias("flat_km"), F.round(F.avg(real), 5).alias("km"), F.count_if(F.round(flat, 2) <= 50).alias("near"))


def submitted_pairs(spark, sf):
    """Pairs of scenes that jobs asked for, each once, and those still to ask for, fifty at most: the cap of a submission."""
    p = joins.consecutive(views.acquisitions(spark, sf).where("sensor = 'S1'"), ["orbit"], "acquired_at", "key", 1, 24)
    pairs = p.select(F.array("first", "second", F.col("orbit").cast("long")).alias("granules"))
    done = pairs.where("granules[0] % 3 <> 0").unionByName(pairs.where("granules[0] % 6 = 1")).select(F.slice("granules", 1, 2).alias("pair")).distinct()
    todo = pairs.select(F.slice("granules", 1, 2).alias("pair")).join(done, "pair", "left_anti")
    return tables.top(todo.select(F.col("pair")[0].alias("first"), F.col("pair")[1].alias("second")), 50, F.col("first"), F.col("second"))


def replayed(spark, sf):
    """A replay: observations reach the site six hours after their acquisition; what an assessment at each one's time sees."""
    obs = views.observations(spark, sf).select("event_id", "site_id", F.col("observed_at").alias("at"), "v")
    known = obs.select("site_id", (F.col("at") + F.expr("INTERVAL 6 HOURS")).alias("at"), F.col("v").alias("seen"))
    out = joins.as_of(obs, known, ["site_id"], "at", "seen")
    return out.select("event_id", *six("seen"))


def merged_baselines(spark, sf):
    """An earlier season and late interferometric observations put beside what is stored; rows stored before stay."""
    obs = views.observations(spark, sf).select("event_id", "site_id", "kind", "observed_at", "v")
    stored = obs.where("kind <> 'insar_los' and event_id % 3 <> 0")
    earlier = obs.where("kind = 'velocity'").withColumn("observed_at", F.col("observed_at") - F.expr("INTERVAL 365 DAYS")).withColumn("event_id", -F.col("event_id") - 1)
    rows = reads.merged_baselines(stored, earlier, obs.where("kind = 'insar_los'"), obs.where("event_id % 3 = 1 and kind <> 'insar_los'"), keys=["event_id"], at="observed_at")
    return rows.groupBy("site_id", "kind").agg(F.count("*").alias("n"), F.date_format(F.min("observed_at"), "yyyy-MM-dd").alias("first"))


def outlet_points(spark, sf):
    """Where a flood would start: the lowest point that a site's attributes name, else the site itself; and its area's box."""
    attrs = F.when(F.col("site_id") % 3 == 0, F.to_json(F.struct(F.array((F.col("lon") + 0.01).alias("x"), F.col("lat") - 0.01).alias("lowest_point")))).otherwise(F.lit("{}"))
    box = F.coalesce(F.when(F.col("aoi") % 4 == 0, F.lit(84.0)), F.lit(85.0))
    out = reads.outlets(views.sites(spark, sf).withColumn("attrs", attrs))
    return out.select("site_id", *six("lon", "lat"), box.alias("west"))


def curated_features(spark, sf):
    """Features of collections' texts, a text for each thousand of an area, and the points of those that have a name."""
    a = views.assets(spark, sf)
    f = F.struct(F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 3), F.round("lat", 3)).alias("coordinates")).alias("geometry"), F.struct(F.when(F.col("asset_id") % 4 != 0, F.col("name")).alias("name"), "kind").alias("properties"))
    text = a.groupBy("aoi", F.floor(F.col("asset_id") / 1000)).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(f).alias("features"))).alias("text"))
    out = reads.collected_features(text.select("aoi", "text"))
    return out.groupBy("aoi", "kind").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 4).alias("lon"))


QUERIES = {f.__name__: f for f in (api_events, api_observations, site_details, hindcast_reports, saved_reports, alert_records, subscriber_records, parsed_times, top_movements, todo_list, redispatched_alerts, near_events, submitted_pairs, replayed, merged_baselines, outlet_points, curated_features)}
_KMS = "sqrt(pow(({a}.lon - {b}.lon) * 111.32::DOUBLE * cos(radians({a}.lat)), 2) + pow(({a}.lat - {b}.lat) * 110.57::DOUBLE, 2))"
_X, _Y = utm_sql("lon", "lat", "zone")
ORACLES = {
    "api_events": f"WITH {CHANGES}, e AS (SELECT id, CASE id % 4 WHEN 0 THEN 'mass_movement' WHEN 1 THEN 'velocity_hotspot' ELSE 'vegetation_loss' END AS kind, strftime(\"at\", '%Y-%m-%d') AS day, round(area, 2) AS area FROM ch WHERE \"at\" BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-12-31' AND area >= 50000) SELECT * FROM e WHERE kind <> 'vegetation_loss' ORDER BY day DESC, id LIMIT 5000",
    "api_observations": f"WITH {views.OBS} SELECT site_id, kind, row_number() OVER (PARTITION BY site_id, kind ORDER BY observed_at, event_id)::INTEGER AS place, event_id, round(v, 6) AS v FROM obs WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAYS",
    "site_details": f"""WITH {views.OBS}, {views.SITES}, {views.ASSETS}, l AS (SELECT site_id, arg_max(event_id, (observed_at, event_id)) AS event_id, round(arg_max(v, (observed_at, event_id)), 6) AS v FROM obs GROUP BY 1), a AS (SELECT site_id, string_agg(event_id, ',' ORDER BY rn) AS alerts FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY observed_at DESC, event_id DESC) AS rn FROM obs WHERE v > 60) WHERE rn <= 10 GROUP BY 1),
 n AS (SELECT site_id, asset_id, row_number() OVER (PARTITION BY site_id ORDER BY round({_KMS.format(a='s', b='t')}, 6), asset_id) AS k FROM site s JOIN asset t ON {_KMS.format(a='s', b='t')} < 5), x AS (SELECT site_id, string_agg(asset_id, ',' ORDER BY k) AS assets FROM n WHERE k <= 3 GROUP BY 1)
 SELECT code, kind, level, event_id, v, coalesce(alerts, '') AS alerts, coalesce(assets, '') AS assets FROM site LEFT JOIN l USING (site_id) LEFT JOIN a USING (site_id) LEFT JOIN x USING (site_id)""",
    "hindcast_reports": f"WITH {views.OBS} SELECT site_id, count(*) AS n, round(max(v), 5) AS top, count(CASE WHEN v > 80 THEN 1 END)::INTEGER AS alerts FROM obs WHERE site_id % 7 <> 0 GROUP BY 1",
    "saved_reports": f"WITH {views.OBS}, g AS (SELECT site_id, count(*) AS n, floor(avg(v) * 100000 + 0.5001::DOUBLE) / 100000 AS mean, string_agg(CASE WHEN v > 95 THEN floor(v * 100000 + 0.5001::DOUBLE) / 100000 END, ',' ORDER BY v) AS top FROM obs GROUP BY 1) SELECT site_id, '{{\"n\":' || n || ',\"mean\":' || mean || ',\"top\":[' || coalesce(top, '') || ']}}' AS report FROM g",
    "alert_records": f"WITH {views.ACQ}, {views.SITES}, a AS (SELECT key AS uid, orbit + 1 + key % 90 AS site_id, CASE WHEN status = 'pending' THEN 'pending_review' ELSE 'dispatched' END AS status, acquired_at FROM acq), r AS (SELECT uid, code, status, kind, acquired_at, row_number() OVER (PARTITION BY code, status ORDER BY acquired_at DESC, uid DESC)::INTEGER AS place FROM a JOIN site USING (site_id)) SELECT uid, code, status, place, CASE kind WHEN 'glacial_lake' THEN 'glacial lake outburst flood (GLOF)' WHEN 'glacier' THEN 'ice avalanche and debris flood' WHEN 'barrier_lake' THEN 'flood from a breaching landslide dam' WHEN 'landslide' THEN 'landslide and debris flow' ELSE 'flood' END AS hazard, strftime(acquired_at, '%Y-%m-%dT%H:%M:%SZ') AS issued FROM r WHERE place <= 200",
    "subscriber_records": f"WITH {views.SUBS}, s AS (SELECT *, 'n' || sub_id // 2 AS name, row_number() OVER (PARTITION BY sub_id // 2 ORDER BY sub_id DESC) AS k FROM sub WHERE sub_id % 4 = 0 OR sub_id % 6 <> 0) SELECT name, sub_id, language, min_level, active, sub_id % 4 <> 0 AS bounded FROM s WHERE k = 1",
    "parsed_times": f"WITH {views.ACQ} SELECT key, epoch_us(date_trunc('second', acquired_at)) AS micros FROM acq",
    "top_movements": f"WITH {CHANGES} SELECT aoi, place, id, round(area, 2) AS area FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY area DESC, id)::INTEGER AS place FROM ch WHERE confidence >= 0.7 AND NOT snow_like) WHERE place <= 10",
    "todo_list": f"WITH {views.ACQ} SELECT sensor, key, row_number() OVER (PARTITION BY sensor ORDER BY acquired_at, key)::INTEGER AS place FROM acq WHERE acquired_at >= TIMESTAMP '2000-06-01' AND status NOT IN ('processed', 'skipped')",
    "redispatched_alerts": "SELECT l_orderkey AS alert_id, string_agg(DISTINCT ['sms', 'email', 'webhook'][l_linenumber % 3 + 1], ',' ORDER BY ['sms', 'email', 'webhook'][l_linenumber % 3 + 1]) FILTER (l_returnflag = 'R') AS channels, max(l_quantity::BIGINT % 4)::INTEGER AS attempts FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R')",
    "near_events": f"WITH {CHANGES}, b AS (SELECT aoi, arg_max(lon, (area, id)) AS x, arg_max(lat, (area, id)) AS y FROM ch GROUP BY 1), d AS (SELECT aoi, sqrt(pow(lon - x, 2) + pow(lat - y, 2)) * 111 AS f, sqrt(pow((lon - x) * 111.32::DOUBLE * cos(radians(lat)), 2) + pow((lat - y) * 110.57::DOUBLE, 2)) AS k FROM ch JOIN b USING (aoi)) SELECT aoi, round(avg(f), 5) AS flat_km, round(avg(k), 5) AS km, count(CASE WHEN round(f, 2) <= 50 THEN 1 END) AS near FROM d GROUP BY 1",
    "submitted_pairs": f"WITH {views.ACQ}, p AS (SELECT key AS first, lead(key) OVER w AS second, date_diff('microsecond', acquired_at, lead(acquired_at) OVER w) / 86400e6::DOUBLE AS gap FROM acq WHERE sensor = 'S1' WINDOW w AS (PARTITION BY orbit ORDER BY acquired_at, key)) SELECT first, second FROM p WHERE gap BETWEEN 1 AND 24 AND first % 3 = 0 ORDER BY first, second LIMIT 50",
    "replayed": f"WITH {views.OBS}, k AS (SELECT site_id, observed_at + INTERVAL 6 HOURS AS t, v FROM obs) SELECT o.event_id, round(k.v, 6) AS seen FROM obs o ASOF LEFT JOIN k ON o.site_id = k.site_id AND o.observed_at >= k.t",
    "merged_baselines": f"WITH {views.OBS}, u AS (SELECT event_id, site_id, kind, observed_at FROM obs WHERE kind = 'insar_los' OR event_id % 3 <> 0 UNION ALL SELECT -event_id - 1, site_id, kind, observed_at - INTERVAL 365 DAYS FROM obs WHERE kind = 'velocity') SELECT site_id, kind, count(*) AS n, strftime(min(observed_at), '%Y-%m-%d') AS first FROM u GROUP BY 1, 2",
    "outlet_points": f"WITH {views.SITES} SELECT site_id, round(CASE WHEN site_id % 3 = 0 THEN lon + 0.01 ELSE lon END, 6) AS lon, round(CASE WHEN site_id % 3 = 0 THEN lat - 0.01 ELSE lat END, 6) AS lat, CASE WHEN aoi % 4 = 0 THEN 84.0::DOUBLE ELSE 85.0::DOUBLE END AS west FROM site",
    "curated_features": f"WITH {views.ASSETS} SELECT aoi, kind, count(*) AS n, round(sum(round(lon, 3)), 4) AS lon FROM asset WHERE asset_id % 4 <> 0 GROUP BY 1, 2",
    # SQL of queries that stand in other modules.
    "utm_positions": f"WITH {views.SITES}, z AS (SELECT *, floor((lon + 180) / 6) + 1 AS zone FROM site), u AS (SELECT site_id, {_X} AS x, {_Y} AS y FROM z) SELECT site_id, round(x, 3) AS x, round(y, 3) AS y, floor((3200000 - y) / 1000)::INTEGER AS row, floor((x - 200000) / 1000)::INTEGER AS col FROM u",
    "site_features": f"WITH {views.SITES} SELECT site_id, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || round(lon, 6) || ',' || round(lat, 6) || ']}},\"properties\":{{\"code\":\"' || code || '\",\"level\":\"' || level || '\"}}}}' AS geojson FROM site",
    "polygons_around": f"WITH {views.SITES} SELECT site_id, round(lon + 0.2, 6) AS x1, round(lat + 0.2, 6) AS y1, (site_id % 20)::DOUBLE / 100 + 0.001 + 0.05 < 0.2 AS inside, (SELECT count(*)::INTEGER FROM (SELECT x, y, lag(x) OVER (ORDER BY i) AS px, lag(y) OVER (ORDER BY i) AS py FROM (VALUES (0, round(lon / 0.5) * 0.5, round(lat / 0.5) * 0.5), (1, round((lon + 0.2) / 0.5) * 0.5, round(lat / 0.5) * 0.5), (2, round(lon / 0.5) * 0.5, round((lat + 0.2) / 0.5) * 0.5), (3, round(lon / 0.5) * 0.5, round(lat / 0.5) * 0.5)) t(i, x, y)) WHERE px IS NULL OR px <> x OR py <> y) AS points FROM site",
    "surface_classes": f"""WITH {BANDS}, c AS (SELECT row, v / 10 AS g, w / 12 AS nir, v / 15 AS swir, (row + col) % 8 AS scl, row * 4 AS slope, col = 2 AS dark FROM b), i AS (SELECT *, (g - nir) / (g + nir) AS ndwi, (g - swir) / (g + swir) AS mndwi FROM c),
 x AS (SELECT *, coalesce(slope < 18 AND (ndwi > CASE WHEN dark THEN 0.45 ELSE 0.25 END AND mndwi > 0.1 AND nir < 0.2 OR nir < 0.04 AND swir < 0.05 AND g < 0.1 AND NOT dark OR scl = 6 AND nir < 0.08 AND mndwi > 0), false) AS water FROM i)
 SELECT row, CASE WHEN scl IN (0, 1, 8, 9, 10) THEN 'none' WHEN water THEN 'water' WHEN mndwi > 0.4 AND nir > 0.15 THEN 'snow' WHEN row > 5 THEN 'debris' ELSE 'other' END AS kind, count(*) AS n FROM x GROUP BY 1, 2""",
}
