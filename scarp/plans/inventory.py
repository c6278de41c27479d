"""Sites from detections: attaching, matching, creating, and what is written for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import detection, inventory, joins, reads, stats, tables
from ..sources import views
from .statistics import CELL_AS_OF, SEASONAL_SQL, as_of, settled_sql, six
from .detections import labels_sql


def _changes(spark, sf):
    """Change events: an order each."""
    k = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(
        k.alias("id"), F.concat(F.lit("s"), F.col("o_custkey") % 50).alias("scene_key"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("area"), (0.5 + k % 50 / 100.0).alias("confidence"), (k % 7 == 0).alias("disturbed"), (k % 11 == 0).alias("snow_like"), (k % 900).cast("double").alias("relief"),
        (85 + k * 37 % 997 / 997.0).alias("lon"), (27.5 + k * 91 % 991 / 991.0).alias("lat"), (k % 3 == 0).alias("confirmed"), (F.col("o_custkey") % 25).alias("aoi"),
    )


CHANGES = f"""{views.SITES}, ch AS (SELECT o_orderkey AS id, 's' || o_custkey % 50 AS scene_key, o_orderdate AS "at", o_totalprice AS area, 0.5::DOUBLE + (o_orderkey % 50)::DOUBLE / 100 AS confidence, o_orderkey % 7 = 0 AS disturbed, o_orderkey % 11 = 0 AS snow_like, (o_orderkey % 900)::DOUBLE AS relief,
 85 + (o_orderkey * 37 % 997)::DOUBLE / 997 AS lon, 27.5::DOUBLE + (o_orderkey * 91 % 991)::DOUBLE / 991 AS lat, o_orderkey % 3 = 0 AS confirmed, o_custkey % 25 AS aoi FROM orders)"""
_KM = "sqrt(pow(({a}.lon - {b}.lon) * 111.32::DOUBLE * cos(radians({a}.lat)), 2) + pow(({a}.lat - {b}.lat) * 110.57::DOUBLE, 2))"


def attached_changes(spark, sf):
    """Changes that pass the gate, as observations of the sites within a kilometre and a half."""
    out = inventory.attached_changes(inventory.attachable(_changes(spark, sf)), views.sites(spark, sf), 1.5)
    return out.select("site_id", "scene_key", F.date_format("observed_at", "yyyy-MM-dd").alias("day"), F.round("v", 2).alias("v"), "quality")


def landslide_events(spark, sf):
    """Large confirmed changes that match a site's box, or ask for a site of their own."""
    ev = inventory.attachable(_changes(spark, sf), 2.5e5, 0.75, 300.0)
    boxes = joins.padded(ev, 0.004)
    sites = joins.padded(views.sites(spark, sf).where("kind = 'landslide'"), 0.01).select("site_id", *joins.BOX)
    return inventory.matched_or_new(boxes, sites, 0.003, 0.05).select("id", "site_id")


def new_landslide_sites(spark, sf):
    """The sites that unmatched events ask for: codes after the existing ones, names of the nearest town."""
    ev = landslide_events(spark, sf).where("site_id is null").join(_changes(spark, sf), "id")
    new = ev.select(F.col("id").alias("key"), F.lit("landslide").alias("site_kind"), "lon", "lat", F.when(F.col("id") % 5 == 0, F.concat(F.lit("Slide "), "id")).otherwise("").alias("own_name"))
    towns = views.assets(spark, sf).where("kind = 'town'").select(F.col("asset_id").alias("place_id"), "name", "lon", "lat")
    have = views.sites(spark, sf).groupBy(F.col("kind").alias("site_kind")).agg(F.count("*").cast("int").alias("most"))
    return inventory.created(new, towns, have, 3.0).select("key", "code", "name")


def _lakes(spark, sf):
    """Lakes found: one a line item."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return views.table(spark, sf, "lineitem").select(
        ((k * 8 + n) * 100_000 + F.col("l_partkey")).alias("id"), F.col("l_shipdate").alias("at"), (85 + (k + n) * 37 % 997 / 997.0).alias("lon"), (27.5 + (k + n) * 91 % 991 / 991.0).alias("lat"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_suppkey")).alias("known"), (0.8 + F.col("l_discount") * 2).alias("quality"), (0.4 + F.col("l_tax") * 5).alias("probability"),
        (n % 2 == 0).alias("was_dry"), F.col("l_quantity").alias("z_range"), (F.col("l_extendedprice") / 20).alias("z"), (k % 5 / 2.0).alias("ice_km"),
    )


LAKES = """lk AS (SELECT (l_orderkey * 8 + l_linenumber) * 100000 + l_partkey AS id, l_shipdate AS "at", 85 + ((l_orderkey + l_linenumber) * 37 % 997)::DOUBLE / 997 AS lon, 27.5::DOUBLE + ((l_orderkey + l_linenumber) * 91 % 991)::DOUBLE / 991 AS lat, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey END AS known, 0.8::DOUBLE + l_discount * 2 AS quality, 0.4::DOUBLE + l_tax * 5 AS probability,
 l_linenumber % 2 = 0 AS was_dry, l_quantity AS z_range, l_extendedprice / 20 AS z, (l_orderkey % 5)::DOUBLE / 2 AS ice_km FROM lineitem)"""


def lake_decisions(spark, sf):
    """What becomes of each lake that was found; barrier lakes are new water on dry ground near a confirmed mass movement."""
    lakes = _lakes(spark, sf).withColumn("glacial", inventory.glacial(F.col("z"), F.col("ice_km"), 2500.0))
    near = inventory.moved_near(lakes.where(inventory.undecided()), _changes(spark, sf).where("area >= 100000"), 45, 0.03, 0.6)
    return inventory.lake_decisions(lakes, near).groupBy("action").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def missing_glacier_sites(spark, sf):
    """Entries of a glacier inventory without a site."""
    c = views.assets(spark, sf).select(F.concat(F.lit("G"), "asset_id").alias("inventory_id"), (F.abs("height_m") / 1000).alias("km2"), "lon", "lat", "name")
    have = views.sites(spark, sf).select(F.concat(F.lit("G"), F.col("site_id") * 3).alias("inventory_id"))
    return inventory.missing_sites(c, have, (85.2, 27.6, 85.9, 28.3), 1.5).select("inventory_id", F.round("km2", 5).alias("km2"))


def renewed_exposures(spark, sf):
    """Exposures of some sites computed anew in place of the old ones; sites that were never computed are named."""
    at = joins.classes(views.assets(spark, sf), "asset_id", ["lon", "lat"])
    near = joins.close_pairs(views.sites(spark, sf).select("lon", "lat").distinct(), at, 3.0)
    places = near.select(F.col("l_lon").alias("lon"), F.col("l_lat").alias("lat"), F.col("r_n").alias("assets"), F.round("km", 3).alias("km"))
    rows = views.sites(spark, sf).select("site_id", "lon", "lat").join(places, ["lon", "lat"]).select("site_id", "assets", "km")
    old, new = rows.where("site_id % 4 <> 0 and km < 2"), rows.where("site_id % 3 = 0")
    todo = views.sites(spark, sf).join(old.select("site_id").distinct(), "site_id", "left_anti").select("site_id", F.lit(True).alias("todo"))
    g = inventory.replaced(old, new, "site_id").groupBy("site_id").agg(F.sum("assets").alias("n"), F.max("km").alias("far"))
    return g.join(todo, "site_id", "left").select("site_id", "n", "far", F.coalesce("todo", F.lit(False)).alias("todo"))


def upserted_cells(spark, sf):
    """Velocities of cells written by cell and pair: a second delivery replaces what it repeats."""
    keys, cells = ["cell", "pair_key"], views.cell_velocities(spark, sf)
    n = cells.count()
    c = tables.dealt(cells, n, keys).groupBy(*keys).agg(F.max("v").alias("v"), F.max("n").alias("n"))
    second = c.where("n > 40").withColumn("v", F.col("v") + 1)
    return tables.upsert(c.where("n < 45"), second, keys, rows=2 * n).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.sum("v"), 5).alias("v"))


def appended_events(spark, sf):
    """Events appended twice are there once."""
    e = _changes(spark, sf).select("id", "scene_key", F.round("area", 2).alias("area"))
    both = inventory.appended_once(e.where("id % 3 <> 0"), e.where("id % 2 = 0").unionByName(e.where("id % 4 = 0")), ["id", "scene_key"])
    return both.groupBy("scene_key").agg(F.count("*").alias("n"), F.round(F.sum("area"), 1).alias("area"))


def _anomalies(spark, sf):
    """Cells on a lattice with their anomaly; weak ones count here, as the table's speeds are drawn at random."""
    out = stats.anomaly(views.cell_velocities(spark, sf), ["cell"], as_of(CELL_AS_OF), recent_days=40, half_season=30, fallback=(60, 300))
    out = out.where(stats.significant(z=-0.5, ratio=0.5, orbits=1))
    return out.select((F.col("cell") % 1).alias("aoi"), F.floor(F.col("cell") / 10).cast("int").alias("row"), (F.col("cell") % 10).cast("int").alias("col"), "cell", stats.settled(F.col("z")).alias("z"), stats.settled(F.col("ratio")).alias("ratio"))


def cell_anomaly_sites(spark, sf):
    """Significant cells that no slope site covers, in clusters, each a site."""
    hot = _anomalies(spark, sf)
    covered = views.sites(spark, sf).where("kind = 'slope' and level = 'high'").select((F.col("site_id") % 1).alias("aoi"), F.floor(F.col("site_id") / 10).cast("int").alias("row"), (F.col("site_id") % 10).cast("int").alias("col"))
    free = hot.join(covered, ["aoi", "row", "col"], "left_anti")
    from ..operators import raster

    labelled = raster.regions(free.select("aoi", "row", "col"), ["aoi"]).join(free, ["aoi", "row", "col"])
    cells = labelled.withColumnRenamed("label", "cluster").withColumn("slope", 15.0 + F.col("cell") % 25).withColumn("height", 3000.0 + F.col("cell") * 13 % 700)
    return inventory.cell_sites(cells).select("cluster", "cells", "row0", "row1", "col0", "col1", *six("slope"), "low", "high", "middle", "best_cell", *six("z", "ratio"))


def cell_site_pairs(spark, sf):
    """Observations of slope sites from their cells, a pair each, over the 400 days before."""
    cells = views.cell_velocities(spark, sf).where(F.col("pair_end").between(as_of(CELL_AS_OF) - F.expr("INTERVAL 400 DAYS"), as_of(CELL_AS_OF)))
    rows = cells.withColumn("pair_key", F.date_format("pair_end", "yyyyMMdd"))
    members = views.sites(spark, sf).select(F.floor(F.col("site_id") / 5).alias("site_id"), F.col("site_id").alias("cell"))
    out = inventory.cell_site_observations(members, rows)
    return out.select("site_id", "pair_key", *six("v", "se"), "cells", F.round("nodes", 2).alias("nodes"))


def velocity_fields(spark, sf):
    """Stored fields of a tile by their end, start and orbit, so that pairs that end together stay apart; those with too much
    noise or too few nodes are not stored. The history that a new field sees."""
    px = views.pixels(spark, sf)
    noise = px.groupBy("label", "scene").agg(F.count_if(F.abs("v") < 0.2).alias("valid"), F.stddev_pop("v").alias("nmad"))
    fields = noise.select(F.col("label").alias("tile"), F.col("scene"), (F.col("scene") % 300).alias("day"), (F.col("scene") % 3).alias("orbit"), (F.col("scene") % 300 - 12 * (1 + F.col("scene") % 2)).alias("from_day"), "valid", "nmad")
    return reads.field_history(reads.kept_fields(fields, 50, 0.14), 150, 18).select("tile", "scene", "history")


def site_velocities(spark, sf):
    """Glacier and slope sites with enough nodes and pixels: the velocity of their region in each pair."""
    sites = views.sites(spark, sf).where("kind in ('glacier', 'slope')").select("site_id", (F.col("site_id") % 10).cast("int").alias("label"))
    region = views.pixels(spark, sf).where("row >= 4").select("label", "scene", F.abs("v").alias("v"))
    return reads.region_velocities(sites, region, ["label"], 30, 20, 0.05).select("site_id", "scene", "nodes", *six("v"))


def optical_gaps(spark, sf):
    """Each scene's pixels against the last clear ones before: the gap, for scenes where it is short and most are seen."""
    px = views.pixels(spark, sf).where("v >= -0.2").withColumn("day", F.col("scene") % 700)
    first = tables.latest(px, ["label", "row", "col", "day"], F.col("scene").desc())
    pairs = detection.reference_pairs(first, ["label"])
    g = pairs.where("gap > 0 and gap <= 40").groupBy("label", "day").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("gap"), F.round(F.avg(F.col("v") - F.col("before")), 6).alias("change"))
    return g.where("n >= 30")


def ensured_areas(spark, sf):
    """Areas of interest from their configuration: new ones are created, known ones take its name and box and keep the day on
    which they came."""
    n = views.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    config = n.select(k.alias("aoi"), F.concat("n_name", F.when(k % 3 == 0, F.lit(" new")).otherwise("")).alias("name"), (84.0 + k / 10.0).alias("x0"), F.lit("2024-01-30").alias("created"))
    known = n.where("n_nationkey % 4 <> 0").select(k.alias("aoi"), F.col("n_name").alias("name"), (84.0 + k / 10.0).alias("x0"), F.lit("2023-01-01").alias("created"))
    return tables.upsert(known, config, ["aoi"], keep=["created"]).select("aoi", "name", F.round("x0", 3).alias("x0"), "created")


def synced_assets(spark, sf):
    """Scanned and curated assets inside the routing box of their area (its exposure box, else its own), by external id, the
    later source wins; names of 200 characters at most, and the source before the colon."""
    k = F.col("asset_id")
    a = views.assets(spark, sf).select(F.concat(F.lit("osm:node/"), k).alias("external_id"), F.repeat("name", F.when(k % 50 == 0, 20).otherwise(1)).alias("name"), "kind", "lon", "lat", "aoi", F.lit(0).alias("_o"))
    curated = views.assets(spark, sf).where("asset_id % 5 = 0").select(F.when(k % 2 == 0, F.concat(F.lit("osm:node/"), k)).otherwise(F.concat(F.lit("own:"), k)).alias("external_id"), F.concat(F.lit("Curated "), k).alias("name"), "kind", "lon", "lat", "aoi", F.lit(1).alias("_o"))
    n = F.col("n_nationkey")
    boxes = views.table(spark, sf, "nation").select(n.alias("aoi"), F.coalesce(F.when(n % 2 == 0, F.lit(85.1)), F.lit(85.4)).alias("x0"), F.coalesce(F.when(n % 2 == 0, F.lit(85.95)), F.lit(85.6)).alias("x1"))
    rows = a.unionByName(curated).join(boxes, "aoi").where(F.col("lon").between(F.col("x0"), F.col("x1")))
    out = tables.latest(rows, ["external_id"], F.col("_o").desc())
    return out.select("external_id", F.substring("name", 1, 200).alias("name"), "kind", F.split_part("external_id", F.lit(":"), F.lit(1)).alias("source"))


def imported_roster(spark, sf):
    """A roster by name: entries whose channel has no address are refused, others are created or updated, and who is missing
    is deactivated; how many of each."""
    c = views.table(spark, sf, "customer")
    k = F.col("c_custkey")
    known = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("address"))
    roster = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("name"), F.when(k % 7 != 0, F.concat("c_mktsegment", F.when(k % 4 == 0, F.lit("x")).otherwise(""))).alias("address"))
    fine = roster.where(F.coalesce("address", F.lit("")) != "")
    status = tables.changed(known, fine, ["name"], ["address"])
    refused = roster.join(fine.select("name"), "name", "left_anti").select("name", F.lit("refused").alias("status"))
    return status.withColumn("status", F.when(F.col("status") == "missing", "deactivated").otherwise(F.col("status"))).unionByName(refused).groupBy("status").agg(F.count("*").alias("n"))


def pruned_files(spark, sf):
    """What a retention of 120 days for cached files and 400 for fields would remove: how many, and megabytes."""
    c = views.cell_velocities(spark, sf).select("pair_end", F.when(F.col("cell") % 3 == 0, "cache").otherwise("velocity").alias("kind"), (F.col("n") * 1e5).alias("bytes"))
    age = stats.age_days(F.col("pair_end"), as_of("2000-06-01 00:00:00"))
    old = c.where(age > F.when(F.col("kind") == "cache", 120).otherwise(400))
    return old.groupBy("kind").agg(F.count("*").alias("files"), F.round(F.sum("bytes") / 1e6, 3).alias("mb"))


QUERIES = {f.__name__: f for f in (ensured_areas, synced_assets, imported_roster, pruned_files, attached_changes, landslide_events, new_landslide_sites, lake_decisions, missing_glacier_sites, renewed_exposures, upserted_cells, appended_events, cell_anomaly_sites, cell_site_pairs, velocity_fields, site_velocities, optical_gaps)}
_GATE = "area >= {a} AND confidence >= {c} AND NOT disturbed AND NOT snow_like AND relief >= {r}"
_MATCH = f"""ev AS (SELECT * FROM ch WHERE {_GATE.format(a=250000, c=0.75, r=300)}), ls AS (SELECT * FROM site WHERE kind = 'landslide'),
 pr AS (SELECT e.id, s.site_id, (least(e.lon + 0.007::DOUBLE, s.lon + 0.01::DOUBLE) - greatest(e.lon - 0.007::DOUBLE, s.lon - 0.01::DOUBLE)) * (least(e.lat + 0.007::DOUBLE, s.lat + 0.01::DOUBLE) - greatest(e.lat - 0.007::DOUBLE, s.lat - 0.01::DOUBLE)) AS area FROM ev e JOIN ls s ON abs(e.lon - s.lon) < 0.017 AND abs(e.lat - s.lat) < 0.017),
 mt AS (SELECT id, arg_min(site_id, (-round(area, 9), site_id)) AS site_id FROM pr WHERE area > 0 GROUP BY 1), le AS (SELECT ev.id, mt.site_id, lon, lat FROM ev LEFT JOIN mt USING (id))"""
_SEASONAL = SEASONAL_SQL[: SEASONAL_SQL.rindex("SELECT cell")]
ORACLES = {
    "ensured_areas": "SELECT n_nationkey AS aoi, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' new' ELSE '' END AS name, round(84 + n_nationkey / 10::DOUBLE, 3) AS x0, CASE WHEN n_nationkey % 4 <> 0 THEN '2023-01-01' ELSE '2024-01-30' END AS created FROM nation",
    "synced_assets": f"""WITH {views.ASSETS}, u AS (SELECT 'osm:node/' || asset_id AS external_id, repeat(name, CASE WHEN asset_id % 50 = 0 THEN 20 ELSE 1 END) AS name, kind, lon, aoi, 0 AS o FROM asset UNION ALL SELECT CASE WHEN asset_id % 2 = 0 THEN 'osm:node/' ELSE 'own:' END || asset_id, 'Curated ' || asset_id, kind, lon, aoi, 1 FROM asset WHERE asset_id % 5 = 0),
 b AS (SELECT * FROM u WHERE CASE WHEN aoi % 2 = 0 THEN lon BETWEEN 85.1 AND 85.95 ELSE lon BETWEEN 85.4 AND 85.6 END) SELECT external_id, arg_max(name, o)[1:200] AS name, arg_max(kind, o) AS kind, split_part(external_id, ':', 1) AS source FROM b GROUP BY external_id""",
    "imported_roster": "WITH k AS (SELECT c_name AS name, c_mktsegment AS a FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE '' END END AS a FROM customer WHERE c_custkey % 3 <> 0), f AS (SELECT * FROM r WHERE a IS NOT NULL) SELECT CASE WHEN k.name IS NULL THEN 'created' WHEN f.name IS NULL THEN 'deactivated' WHEN k.a = f.a THEN 'unchanged' ELSE 'updated' END AS status, count(*) AS n FROM k FULL JOIN f ON k.name = f.name GROUP BY 1 UNION ALL SELECT 'refused', count(*) FROM r WHERE a IS NULL",
    "pruned_files": f"WITH {views.CELLS}, c AS (SELECT CASE WHEN cell % 3 = 0 THEN 'cache' ELSE 'velocity' END AS kind, n * 1e5::DOUBLE AS b, date_diff('microsecond', pair_end, TIMESTAMP '2000-06-01') / 86400e6::DOUBLE AS age FROM cellv) SELECT kind, count(*) AS files, round(sum(b) / 1e6, 3) AS mb FROM c WHERE age > CASE WHEN kind = 'cache' THEN 120 ELSE 400 END GROUP BY 1",
    "attached_changes": f"WITH {CHANGES} SELECT site_id, scene_key || '#ev' || id AS scene_key, strftime(\"at\", '%Y-%m-%d') AS day, round(area, 2) AS v, round(confidence, 3) AS quality FROM ch JOIN site s ON {_KM.format(a='ch', b='s')} < 1.5 WHERE {_GATE.format(a=100000, c=0.7, r=0)}",
    "landslide_events": f"WITH {CHANGES}, {_MATCH} SELECT id, site_id FROM le",
    "new_landslide_sites": f"""WITH {CHANGES}, {_MATCH}, {views.ASSETS}, nw AS (SELECT * FROM le WHERE site_id IS NULL), nr AS (SELECT n.id, arg_min(a.name, (round({_KM.format(a='n', b='a')}, 9), asset_id)) AS place FROM nw n JOIN asset a ON a.kind = 'town' AND {_KM.format(a='n', b='a')} < 3 GROUP BY 1)
 SELECT id AS key, 'LS' || printf('%04d', row_number() OVER (ORDER BY id) + (SELECT count(*) FROM site WHERE kind = 'landslide')) AS code, CASE WHEN id % 5 = 0 THEN 'Slide ' || id WHEN place IS NOT NULL THEN 'Landslide near ' || place ELSE 'Landslide' END AS name FROM nw LEFT JOIN nr USING (id)""",
    "lake_decisions": f"""WITH {CHANGES}, {LAKES}, mv AS (SELECT * FROM ch WHERE area >= 100000 AND confidence >= 0.6 AND confirmed), d AS (SELECT lk.*, EXISTS (SELECT 1 FROM mv WHERE mv."at" <= lk."at" AND mv."at" >= lk."at" - INTERVAL 45 DAYS AND abs(mv.lon - lk.lon) <= 0.03 AND abs(mv.lat - lk.lat) <= 0.03) AS moved FROM lk),
 a AS (SELECT id, CASE WHEN known IS NOT NULL AND quality >= 0.95 AND probability >= 0.6 THEN 'renewed' WHEN known IS NOT NULL THEN 'observed' WHEN quality >= 0.9 AND probability >= 0.5 AND was_dry AND moved THEN 'barrier_lake' WHEN quality >= 0.9 AND probability >= 0.5 AND (z >= 2500 OR ice_km < 1) AND z_range <= 15 THEN 'glacial_lake' ELSE 'none' END AS action FROM d) SELECT action, count(*) AS n, max(id) AS last FROM a GROUP BY 1""",
    "missing_glacier_sites": f"WITH {views.SITES}, {views.ASSETS} SELECT 'G' || asset_id AS inventory_id, round(abs(height_m) / 1000, 5) AS km2 FROM asset WHERE abs(height_m) / 1000 >= 1.5 AND lon BETWEEN 85.2 AND 85.9 AND lat BETWEEN 27.6 AND 28.3 AND asset_id NOT IN (SELECT site_id * 3 FROM site)",
    "renewed_exposures": f"WITH {views.SITES}, {views.ASSETS}, r AS (SELECT site_id, asset_id, round({_KM.format(a='s', b='a')}, 3) AS km FROM site s JOIN asset a ON {_KM.format(a='s', b='a')} < 3), o AS (SELECT * FROM r WHERE site_id % 4 <> 0 AND km < 2), n AS (SELECT * FROM r WHERE site_id % 3 = 0), b AS (SELECT * FROM o WHERE site_id NOT IN (SELECT site_id FROM n) UNION ALL SELECT * FROM n) SELECT site_id, count(*) AS n, max(km) AS far, site_id NOT IN (SELECT site_id FROM o) AS todo FROM b GROUP BY 1",
    "upserted_cells": f"WITH {views.CELLS} SELECT cell, count(*) AS n, round(sum(CASE WHEN n > 40 THEN v + 1 ELSE v END), 5) AS v FROM (SELECT cell, pair_key, max(v) AS v, max(n) AS n FROM cellv GROUP BY 1, 2) GROUP BY 1",
    "appended_events": f"WITH {CHANGES} SELECT scene_key, count(*) AS n, round(sum(round(area, 2)), 1) AS area FROM ch WHERE id % 3 <> 0 OR id % 2 = 0 GROUP BY 1",
    "cell_anomaly_sites": f"""{_SEASONAL.replace('WITH ', 'WITH RECURSIVE ' + views.SITES + ', ', 1)}, hot AS (SELECT 0 AS scene, (cell // 10)::INTEGER AS row, (cell % 10)::INTEGER AS col, cell, {settled_sql("z, ratio")} FROM done WHERE round(z, 9) >= -0.5 AND round(v_recent, 9) >= 0.05 AND round(ratio, 9) >= 0.5 AND orbits >= 1),
 fr AS (SELECT * FROM hot WHERE cell NOT IN (SELECT site_id FROM site WHERE kind = 'slope' AND level = 'high')), {labels_sql("fr")}, j AS (SELECT label AS cluster, fr.*, 15::DOUBLE + cell % 25 AS slope, 3000::DOUBLE + cell * 13 % 700 AS height FROM l JOIN fr USING (scene, row, col))
 SELECT cluster, count(*) AS cells, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1, round(avg(slope), 6) AS slope, min(height) AS low, max(height) AS high, median(height) AS middle, arg_max(cell, (z, -cell)) AS best_cell, max(z) AS z, arg_max(ratio, (z, -cell)) AS ratio FROM j GROUP BY 1""",
    "cell_site_pairs": f"""WITH {views.CELLS}, r AS (SELECT cell // 5 AS site_id, strftime(pair_end, '%Y%m%d') AS pair_key, v, greatest(se, 0.001) AS s, n FROM cellv WHERE pair_end BETWEEN TIMESTAMP '{CELL_AS_OF}' - INTERVAL 400 DAYS AND TIMESTAMP '{CELL_AS_OF}'), m AS (SELECT *, abs(v - median(v) OVER (PARTITION BY site_id, pair_key)) <= 99 * s + 1e-9 AS keep FROM r),
 u AS (SELECT *, keep OR sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER w < greatest(1, count(*) OVER w // 2) AS used FROM m WINDOW w AS (PARTITION BY site_id, pair_key))
 SELECT site_id, pair_key, round(sum(CASE WHEN used THEN v / (s * s) END) / sum(CASE WHEN used THEN 1 / (s * s) END), 6) AS v, round(1 / sqrt(sum(CASE WHEN used THEN 1 / (s * s) END)), 6) AS se, count(*) AS cells, round(sum(n), 2) AS nodes FROM u GROUP BY 1, 2""",
    "velocity_fields": f"WITH {views.PIXELS}, n AS (SELECT label, scene, count(CASE WHEN abs(v) < 0.2 THEN 1 END) AS valid, stddev_pop(v) AS sd FROM px GROUP BY 1, 2), f AS (SELECT label AS tile, scene, scene % 300 AS day, scene % 3 AS orbit, scene % 300 - 12 * (1 + scene % 2) AS f FROM n WHERE valid > 50 AND sd < 0.14), k AS (SELECT tile, day, max(scene) AS scene FROM f GROUP BY tile, day, f, orbit) SELECT tile, scene, (SELECT count(*) FROM k o WHERE o.tile = k.tile AND o.day BETWEEN k.day - 150 AND k.day - 18) AS history FROM k",
    "site_velocities": f"WITH {views.PIXELS}, {views.SITES}, g AS (SELECT label, scene, count(CASE WHEN abs(v) > 0.05 THEN 1 END) AS nodes, median(CASE WHEN abs(v) > 0.05 THEN abs(v) END) AS v FROM px WHERE row >= 4 GROUP BY 1, 2 HAVING count(*) >= 30 AND count(CASE WHEN abs(v) > 0.05 THEN 1 END) >= 20) SELECT site_id, scene, nodes, round(v, 6) AS v FROM site JOIN g ON label = site_id % 10 WHERE kind IN ('glacier', 'slope')",
    "optical_gaps": f"WITH {views.PIXELS}, f AS (SELECT label, row, col, scene % 700 AS day, arg_max(v, scene) AS v FROM px WHERE v >= -0.2 GROUP BY 1, 2, 3, 4), p AS (SELECT *, day - lag(day) OVER w AS gap, lag(v) OVER w AS b FROM f WINDOW w AS (PARTITION BY label, row, col ORDER BY day)) SELECT label, day, count(*) AS n, round(avg(gap), 6) AS gap, round(avg(v - b), 6) AS change FROM p WHERE gap > 0 AND gap <= 40 GROUP BY 1, 2 HAVING count(*) >= 30",
}
