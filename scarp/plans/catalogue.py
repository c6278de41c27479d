"""Catalogue scans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalogue, views
from .statistics import as_of


def _items(spark, sf):
    o = views.table(spark, sf, "orders")
    x, y = 85 + (F.col("o_custkey") % 100) / 100.0, 27 + (F.col("o_orderkey") % 100) / 100.0
    name = F.concat(F.lit("S2A_T"), F.col("o_custkey") % 50, F.format_string("_R%03d_", (F.col("o_orderkey") % 143).cast("int")), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"))
    return o.select(
        F.col("o_orderkey").alias("key"), name.alias("id"), F.col("o_orderdate").alias("at"), x.alias("x0"), y.alias("y0"), (x + 0.1).alias("x1"), (y + 0.1).alias("y1"), F.pmod(F.floor("o_totalprice"), F.lit(100)).alias("cloud"),
        F.format_string("%02d.%02d", (F.col("o_orderkey") % 6).cast("int"), (F.col("o_orderkey") % 12).cast("int")).alias("baseline"), F.when(F.col("o_orderkey") % 3 != 0, F.lit(40.0)).alias("sun_elevation"), (F.col("o_custkey") % 90).cast("double").alias("sun_zenith"),
        F.when(F.col("o_orderkey") % 4 == 0, "EW").when(F.col("o_orderkey") % 4 == 1, "IW").alias("mode"),
        F.map_from_arrays(F.array(F.lit("vv"), F.lit("vh"), F.lit("thumb")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("assets"),
    )


def catalogue_search(spark, sf):
    return catalogue.search(_items(spark, sf), (85.2, 27.3, 85.4, 27.5), as_of("1996-01-01 00:00:00"), as_of("1998-01-01 00:00:00"), 60).select("key", F.col("cloud").cast("int").alias("cloud"))


def normalised_items(spark, sf):
    return catalogue.normalised(_items(spark, sf)).groupBy("orbit").agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"), F.round(F.sum("sun_elevation"), 4).alias("sun"))


def radar_scenes(spark, sf):
    return catalogue.radar_items(_items(spark, sf)).select("key", F.array_join(F.array_sort(F.map_keys("assets")), ",").alias("assets"))


def newest_covers(spark, sf):
    items = _items(spark, sf).withColumn("tile", (F.col("key") % 20).cast("int"))
    return catalogue.newest_year(items, ["tile"]).groupBy("tile").agg(F.count("*").alias("n"), F.max(F.year("at")).alias("year"))


def product_pairs(spark, sf):
    """Times of products named by order and ship date."""
    l = views.table(spark, sf, "lineitem").join(views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    name = F.concat(F.lit("X_"), F.date_format("l_shipdate", "yyyyMMdd'T'HHmmss"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit("_P"))
    first, second = catalogue.product_times(name)
    return l.select("l_orderkey", F.date_format(first, "yyyy-MM-dd HH:mm:ss").alias("reference"), F.date_format(second, "yyyy-MM-dd HH:mm:ss").alias("secondary"))


#: Tags that the parts' map elements take in turn.
_TAGS = (
    ("place", "city"), ("place", "hamlet"), ("power", "plant"), ("waterway", "weir"), ("barrier", "border_control"), ("bridge", "yes"), ("amenity", "school"), ("amenity", "clinic"), ("healthcare", "doctor"), ("amenity", "police"),
    ("amenity", "townhall"), ("tourism", "hostel"), ("bridge", "no"), ("shop", "books"),
)


def _elements(spark, sf):
    """Parts as tagged map elements: two tags each, some with a source of power and a name in Devanagari."""
    k = F.col("p_partkey")
    pick = lambda n: F.get(F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("value")) for a, b in _TAGS]), (n % len(_TAGS)).cast("int"))
    first, second = pick(k), pick(F.floor(k / 14) + k * 3)
    more = [(F.lit("plant:source"), F.when(k % 4 == 2, F.lit("hydro")).otherwise("solar")), (F.lit("name"), F.when(k % 11 == 0, F.lit("पुल")).otherwise(F.col("p_name"))), (F.lit("name:en"), F.when(k % 11 == 0, F.lit("Bridge")).otherwise(""))]
    entries = F.concat(F.array(first), F.when(first["key"] != second["key"], F.array(second)).otherwise(F.array().cast("array<struct<key:string,value:string>>")), F.array(*[F.struct(a.alias("key"), b.alias("value")) for a, b in more]))
    return views.table(spark, sf, "part").select(
        k.alias("place"), F.when(k % 4 == 0, "way").otherwise("node").alias("type"), F.floor(k / 2).alias("id"), F.when(k % 4 != 0, 85.0 + k % 7).alias("lon"), F.when(k % 4 != 0, 27.0 + k % 5).alias("lat"),
        F.when(k % 8 != 0, F.struct((84.0 + k % 7).alias("lon"), (26.0 + k % 5).alias("lat"))).alias("centre"), F.map_from_entries(entries).alias("tags"),
    )


def map_assets(spark, sf):
    out = catalogue.map_features(_elements(spark, sf))
    return out.select("external_id", "kind", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"), "name", "name_ne")


def item_acquisitions(spark, sf):
    """Items of several platforms, every third reprocessed some hours later, as acquisitions."""
    i = _items(spark, sf).select(F.lit("S2").alias("sensor"), F.format_string("S2%s", F.get(F.array(*[F.lit(x) for x in "ABC"]), (F.col("key") % 3).cast("int"))).alias("platform"), "at", F.when(F.col("key") % 10 != 0, (F.col("key") % 4).cast("int")).alias("orbit"), F.col("id"), F.when(F.col("key") % 6 != 0, F.col("cloud").cast("double")).alias("cloud"), "key")
    again = i.where("key % 3 = 0").withColumn("id", F.regexp_replace("id", r"T\d{6}$", "T120000")).withColumn("cloud", F.lit(50.0))
    out = catalogue.acquisitions(i.unionByName(again).drop("key"))
    return out.select(F.col("key").alias("code"), "items", F.round("cloud", 6).alias("cloud"), "middle")


def acquisition_suns(spark, sf):
    """Mean sun angles of acquisitions, of the items that tell them."""
    k = F.col("key")
    i = _items(spark, sf).select(F.lit("S2").alias("sensor"), F.concat(F.lit("P"), k % 3).alias("platform"), "at", (k % 4).cast("int").alias("orbit"), "id", "cloud", "sun_elevation", F.when(k % 5 != 0, (k % 360).cast("double")).alias("sun_azimuth"))
    out = catalogue.acquisitions(i)
    return out.select("platform", "orbit", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(c, 6).alias(c) for c in ("sun_azimuth", "sun_elevation")])


def elevation_hrefs(spark, sf):
    """The data asset of elevation items, else their first one."""
    k = F.col("o_orderkey")
    assets = F.map_from_arrays(F.array(F.lit("thumb"), F.when(k % 3 == 0, F.lit("data")).otherwise("extra")), F.array(F.concat(F.lit("t"), k), F.concat(F.lit("d"), k)))
    return views.table(spark, sf, "orders").select("o_orderkey", catalogue.elevation_href(assets).alias("href"))


def named_bands(spark, sf):
    """Band names of items in the names that the engine uses."""
    names = F.create_map(*[F.lit(x) for p in catalogue.BAND_NAMES.items() for x in p])
    k = F.col("o_orderkey")
    has = F.map_from_arrays(F.array(F.lit("B04"), F.when(k % 2 == 0, F.lit("nir")).otherwise("swir16"), F.lit("thumbnail")), F.array(F.lit(1), F.lit(2), F.lit(3)))
    renamed = F.map_filter(F.transform_keys(has, lambda b, _: F.coalesce(names[b], b)), lambda b, _: b.isin(*set(catalogue.BAND_NAMES.values())))
    return views.table(spark, sf, "orders").select("o_orderkey", F.array_join(F.array_sort(F.map_keys(renamed)), ",").alias("bands"))


def slc_scenes(spark, sf):
    """Radar scenes for interferometry in order of their start, as a search lists them."""
    rows = views.acquisitions(spark, sf).where("sensor = 'S1'").select("key", "orbit", (F.col("key") % 8).alias("frame"), F.col("acquired_at").alias("at"))
    found = catalogue.search_slc(rows, as_of("1996-03-01 00:00:00"), as_of("1996-09-01 00:00:00"))
    return found.select("key", "orbit", "frame", "place")


def glacier_areas(spark, sf):
    """Areas of triangles around the sites; outlines that aren't closed are none."""
    s = views.sites(spark, sf)
    d = F.col("site_id") % 9 / 100.0
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(point(F.col("lon"), F.col("lat")), point(F.col("lon") + d, F.col("lat")), point(F.col("lon"), F.col("lat") + d), point(F.col("lon") + F.when(F.col("site_id") % 5 == 0, d / 2).otherwise(0.0), F.col("lat")))
    return s.select("site_id", F.round(catalogue.ring_area_km2(ring, F.col("lat")), 5).alias("km2")).where("km2 >= 0.1")


def scene_mosaic(spark, sf):
    """First valid pixel of the scenes of a label, voids filled from neighbours."""
    px = views.pixels(spark, sf)
    first = catalogue.first_valid(px.where("v > 0.3"), ["label"], "scene")
    whole = px.select("label", "row", "col").distinct().join(first, ["label", "row", "col"], "left")
    return catalogue.nearest_filled(whole, ["label"], 2).select("label", "row", "col", F.round("v", 6).alias("v"))


QUERIES = {f.__name__: f for f in (catalogue_search, normalised_items, radar_scenes, newest_covers, product_pairs, map_assets, item_acquisitions, acquisition_suns, elevation_hrefs, named_bands, slc_scenes, glacier_areas, scene_mosaic)}
ORACLES = {
    "catalogue_search": "SELECT o_orderkey AS key, (floor(o_totalprice)::BIGINT % 100)::INTEGER AS cloud FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01' AND 85 + (o_custkey % 100)::DOUBLE / 100 <= 85.4::DOUBLE AND 85 + (o_custkey % 100)::DOUBLE / 100 + 0.1::DOUBLE >= 85.2::DOUBLE AND 27 + (o_orderkey % 100)::DOUBLE / 100 <= 27.5::DOUBLE AND 27 + (o_orderkey % 100)::DOUBLE / 100 + 0.1::DOUBLE >= 27.3::DOUBLE AND floor(o_totalprice)::BIGINT % 100 <= 60",
    "normalised_items": "SELECT (o_orderkey % 143)::INTEGER AS orbit, count(*) AS n, sum(CASE WHEN o_orderkey % 6 >= 4 THEN -1000.0::DOUBLE ELSE 0 END) AS offsets, round(sum(CASE WHEN o_orderkey % 3 <> 0 THEN 40 ELSE 90 - o_custkey % 90 END), 4)::DOUBLE AS sun FROM orders GROUP BY 1",
    "radar_scenes": "SELECT o_orderkey AS key, 'VH,VV' AS assets FROM orders WHERE o_orderkey % 4 <> 0",
    "newest_covers": "WITH o AS (SELECT (o_orderkey % 20)::INTEGER AS tile, year(o_orderdate)::INTEGER AS y FROM orders), m AS (SELECT *, max(y) OVER (PARTITION BY tile) AS top FROM o) SELECT tile, count(*) AS n, max(y) AS year FROM m WHERE y = top GROUP BY 1",
    "product_pairs": "SELECT l_orderkey, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d %H:%M:%S') AS reference, strftime(greatest(l_shipdate, o_orderdate), '%Y-%m-%d %H:%M:%S') AS secondary FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "map_assets": f"""WITH t(i, k, v) AS (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_TAGS))}),
 e AS (SELECT p_partkey AS k, p_name, CASE WHEN p_partkey % 4 = 0 THEN 'way' ELSE 'node' END AS ty, a.k AS k1, a.v AS v1, CASE WHEN b.k <> a.k THEN b.k END AS k2, b.v AS v2 FROM part JOIN t a ON a.i = p_partkey % 14 JOIN t b ON b.i = (p_partkey // 14 + p_partkey * 3) % 14),
 g AS (SELECT *, list_filter([{{'k': k1, 'v': v1}}, {{'k': k2, 'v': v2}}], lambda x: x.k IS NOT NULL) AS tg FROM e),
 c AS (SELECT *, list_transform(list_filter(tg, lambda x: x.k = 'place'), lambda x: x.v)[1] AS place, list_transform(list_filter(tg, lambda x: x.k = 'amenity'), lambda x: x.v)[1] AS amenity, list_contains(tg, {{'k': 'power', 'v': 'plant'}}) AS power, list_contains(tg, {{'k': 'waterway', 'v': 'weir'}}) AS weir,
 list_contains(tg, {{'k': 'barrier', 'v': 'border_control'}}) AS border, list_contains(tg, {{'k': 'bridge', 'v': 'yes'}}) AS bridge, list_contains(tg, {{'k': 'healthcare', 'v': 'doctor'}}) AS care, list_contains(tg, {{'k': 'tourism', 'v': 'hostel'}}) AS hostel FROM g),
 kd AS (SELECT *, CASE WHEN place = 'city' THEN 'town' WHEN place = 'hamlet' THEN 'settlement' WHEN power AND k % 4 = 2 THEN 'hydropower' WHEN weir THEN 'dam' WHEN border THEN 'border_crossing' WHEN bridge THEN 'bridge' WHEN amenity = 'school' THEN 'school' WHEN amenity = 'clinic' OR care THEN 'health' WHEN amenity = 'police' THEN 'police' WHEN amenity = 'townhall' THEN 'government' WHEN hostel THEN 'tourism' END AS kind FROM c),
 fe AS (SELECT k, 'osm:' || ty || '/' || k // 2 AS external_id, kind, CASE WHEN ty = 'node' THEN 85.0::DOUBLE + k % 7 WHEN k % 8 <> 0 THEN 84.0::DOUBLE + k % 7 END AS lon, CASE WHEN ty = 'node' THEN 27.0::DOUBLE + k % 5 WHEN k % 8 <> 0 THEN 26.0::DOUBLE + k % 5 END AS lat, CASE WHEN k % 11 = 0 THEN 'Bridge' ELSE p_name END AS name, CASE WHEN k % 11 = 0 THEN 'पुल' ELSE '' END AS name_ne FROM kd)
 SELECT external_id, arg_min(kind, k) AS kind, round(arg_min(lon, k), 4) AS lon, round(arg_min(lat, k), 4) AS lat, arg_min(name, k) AS name, arg_min(name_ne, k) AS name_ne FROM fe WHERE kind IS NOT NULL AND lon IS NOT NULL GROUP BY 1""",
    "item_acquisitions": """WITH i AS (SELECT o_orderkey AS key, 'S2' || substr('ABC', (o_orderkey % 3)::INTEGER + 1, 1) AS platform, o_orderdate AS "at", CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 4 END AS orbit, 'S2A_T' || o_custkey % 50 || printf('_R%03d_', o_orderkey % 143) AS base, strftime(o_orderdate, '%Y%m%dT%H%M%S') AS tail, CASE WHEN o_orderkey % 6 <> 0 THEN (floor(o_totalprice)::BIGINT % 100)::DOUBLE END AS cloud FROM orders),
 u AS (SELECT key, platform, "at", orbit, base || tail AS id, base, cloud FROM i UNION ALL SELECT key, platform, "at", orbit, base || tail[:9] || '120000', base, 50.0 FROM i WHERE key % 3 = 0),
 d AS (SELECT platform, "at"::DATE AS day, orbit, rtrim(base, '_') AS tile, arg_max(coalesce(cloud, -1), (id, "at", coalesce(cloud, -1))) AS cloud, arg_max("at", (id, "at", coalesce(cloud, -1))) AS "at" FROM u GROUP BY 1, 2, 3, 4),
 a AS (SELECT platform, day, orbit, count(*) AS items, avg(CASE WHEN cloud >= 0 THEN cloud END) AS cloud, ((epoch_us(min("at")) + epoch_us(max("at"))) // 2)::BIGINT AS middle FROM d GROUP BY 1, 2, 3)
 SELECT 'S2_' || platform || '_' || strftime(make_timestamp(middle), '%Y%m%dT%H%M') || '_' || CASE WHEN orbit IS NULL THEN 'Rxxx' ELSE printf('R%03d', orbit) END AS code, items, round(cloud, 6) AS cloud, middle FROM a""",
    "acquisition_suns": """WITH i AS (SELECT 'P' || o_orderkey % 3 AS platform, (o_orderkey % 4)::INTEGER AS orbit, o_orderdate::DATE AS d, o_custkey % 50 AS tile, o_orderkey % 143 AS r, o_orderdate AS "at", CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 360)::DOUBLE END AS az, CASE WHEN o_orderkey % 3 <> 0 THEN 40.0::DOUBLE END AS el, strftime(o_orderdate, '%H%M%S') AS t, floor(o_totalprice)::BIGINT % 100 AS cloud FROM orders),
 k AS (SELECT *, row_number() OVER (PARTITION BY platform, orbit, d, tile, r ORDER BY t DESC, "at" DESC, cloud DESC, coalesce(el, -1) DESC, coalesce(az, -1) DESC) AS n FROM i)
 SELECT platform, orbit, strftime(d, '%Y-%m-%d') AS day, round(avg(az), 6) AS sun_azimuth, round(avg(el), 6) AS sun_elevation FROM k WHERE n = 1 GROUP BY 1, 2, d""",
    "elevation_hrefs": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey ELSE 't' || o_orderkey END AS href FROM orders",
    "named_bands": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'red,nir' ELSE 'red,swir16' END AS bands FROM orders".replace("'red,nir'", "'nir,red'"),
    "slc_scenes": f"WITH {views.ACQ} SELECT key, orbit, key % 8 AS frame, row_number() OVER (PARTITION BY orbit, key % 8 ORDER BY acquired_at, key)::INTEGER AS place FROM acq WHERE sensor = 'S1' AND acquired_at BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-09-01'",
    "glacier_areas": f"WITH {views.SITES}, a AS (SELECT site_id, round(pow((site_id % 9)::DOUBLE / 100, 2) / 2 * 111.32::DOUBLE * 111.32::DOUBLE * cos(radians(lat)), 5) AS km2 FROM site WHERE site_id % 5 <> 0 OR site_id % 9 = 0) SELECT * FROM a WHERE km2 >= 0.1",
    "scene_mosaic": f"""WITH {views.PIXELS}, f AS (SELECT label, row, col, arg_min(v, scene) AS v FROM px WHERE v > 0.3 GROUP BY 1, 2, 3), w AS (SELECT DISTINCT label, row, col FROM px),
 n AS (SELECT w.label, w.row, w.col, arg_min(f.v, (pow(w.row - f.row, 2) + pow(w.col - f.col, 2), f.v)) AS v FROM w JOIN f ON w.label = f.label AND abs(w.row - f.row) <= 2 AND abs(w.col - f.col) <= 2 GROUP BY 1, 2, 3)
 SELECT w.label, w.row, w.col, round(coalesce(f.v, n.v), 6) AS v FROM w LEFT JOIN f USING (label, row, col) LEFT JOIN n USING (label, row, col)""",
}
