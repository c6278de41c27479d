"""Detections, clusters and geometry over scenes and sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import detection
from ..sources import views
from .statistics import six


def _scenes(spark, sf):
    """Pixels with a height and a slope, and what else detectors look at."""
    r, c = F.col("row"), F.col("col")
    return views.pixels(spark, sf).select(
        "scene", "row", "col", (F.col("v") * 30).alias("v"), (r * 120.0 + c * 7).alias("z"), (c * 4.0).alias("slope"), (r < 2).alias("ice"), ((r == 7) & (c == 7)).alias("exclude"), ((r + c) % 7 != 0).alias("valid"), (F.abs(r - 2) * 100.0).alias("ice_m"), (r.between(1, 6)).alias("core"),
    )


def sar_change_regions(spark, sf):
    out = detection.change_regions(_scenes(spark, sf), ["scene"], 1.0, 10_000.0, 40_000.0, band_share=0.6, band_pixels=8)
    return out.select("scene", "label", "pixels", *six("relief", "mean", "brighter", "on_ice"), F.round("confidence", 4).alias("confidence"), "disturbed", "snow_like")


def lost_vegetation(spark, sf):
    px = _scenes(spark, sf)
    pre = px.select((F.col("scene") + 1).alias("scene"), "row", "col", (0.7 + F.col("v") / 20).alias("before"), F.col("v").alias("bright0"))
    cover = F.when((F.col("scene") + F.floor(F.col("row") / 4)) % 4 == 0, 40).otherwise(10)
    both = px.withColumn("after", 0.2 + F.col("v") / 20).withColumn("bright1", F.col("v") + 4).withColumn("cover", cover).join(pre, ["scene", "row", "col"])
    out = detection.vegetation_loss(both, ["scene"], 100.0, 300.0)
    return out.select("scene", "label", "pixels", "kind", *six("drop", "confidence"))


def detected_lakes(spark, sf):
    px = _scenes(spark, sf).withColumn("water", F.col("v") > 2)
    return detection.lakes(px, ["scene"], 100.0, 400.0, ring=2, wall=2, max_ice=250.0).select("scene", "label", "pixels", *six("z", "z_range", "quality", "elongation", "wall_slope", "ice_m"))


def radar_lake_area(spark, sf):
    lake = F.col("row").between(2, 5) & F.col("col").between(0, 3)
    px = _scenes(spark, sf).withColumn("v", F.when((F.col("row") * 8 + F.col("col") + F.col("scene")) % 9 != 0, F.col("v") - F.when(lake, 22).otherwise(15))).withColumn("lake", lake)
    return detection.radar_water(px, ["scene"], 100.0, min_pixels=20).select("scene", "area", *six("quality"))


def new_fractures(spark, sf):
    """Ridge indices of each scene and the one before."""
    px = views.pixels(spark, sf).withColumn("v", F.abs("v"))
    pre = px.select((F.col("scene") + 1).alias("scene"), "row", "col", (F.col("v") / 4).alias("before"))
    both = px.withColumnRenamed("v", "after").join(pre, ["scene", "row", "col"]).withColumn("region", F.col("row") < 7).withColumn("valid", F.col("col") > 0)
    return detection.new_fractures(both, ["scene"], 30.0, 30, 0.5).select("scene", *six("length", "energy", "observed"))


def _speeds(spark, sf):
    """Fields of speed on a lattice: each label is a tile, its older half of scenes the history of the newer."""
    px = views.pixels(spark, sf).withColumn("v", F.abs("v") * 10)
    half = px.groupBy("label").agg(F.percentile("scene", F.lit(0.5)).alias("mid"))
    return px.join(half, "label").withColumn("old", F.col("scene") <= F.col("mid"))


def fast_hotspots(spark, sf):
    px = _speeds(spark, sf)
    base = detection.node_baseline(px.where("old").select("label", F.col("scene").alias("field"), "row", "col", "v"), ["label"])
    now = px.where("not old").select("label", "scene", "row", "col", "v", (0.1 + F.col("scene") % 5 / 10.0).alias("corr"), (F.col("row") != 4).alias("watch"))
    base, now = base.withColumnRenamed("label", "tile"), now.withColumnRenamed("label", "tile")
    out = detection.hotspots(now, now.select("tile", "scene").distinct().join(base, "tile"), ["tile", "scene"], 1.0, 1.3, 3)
    return out.select("scene", "tile", "label", "nodes", *six("speed", "top", "ratio", "corr", "confidence"))


def node_ratios(spark, sf):
    """Speed of each newer field against the baseline of its nodes."""
    px = _speeds(spark, sf)
    base = detection.node_baseline(px.where("old").select("label", F.col("scene").alias("field"), "row", "col", "v"), ["label"])
    now = px.where("not old and row < 4").select("label", "scene", "row", "col", "v")
    out = detection.pointwise_ratio(now, now.select("label", "scene").distinct().join(base, "label"), ["label", "scene"])
    return out.select("scene", "n", *six("v", "base", "ratio"))


def opened_masks(spark, sf):
    """Bright pixels that survive an opening by a cross."""
    px = views.pixels(spark, sf).where("v > -0.05").select("scene", "row", "col")
    return detection.opened(px, ["scene"]).groupBy("scene").agg(F.count("*").alias("pixels"))


def cell_clusters(spark, sf):
    """Suppliers' cells on a lattice, strong ones clustered where no site covers them."""
    s = views.sites(spark, sf).select((F.col("site_id") % 1).alias("aoi"), F.floor(F.col("site_id") / 12).cast("int").alias("row"), (F.col("site_id") % 12).cast("int").alias("col"), "z", "kind")
    out = detection.cell_clusters(s.where("z > 2000").drop("kind"), s.where("kind = 'glacial_lake'"), ["aoi"])
    return out.select("label", "cells", F.round("z", 4).alias("z"), "row0", "row1", "col0", "col1")


def utm_positions(spark, sf):
    s = views.sites(spark, sf)
    x, y = geometry.utm(F.col("lon"), F.col("lat"), F.floor((F.col("lon") + 180) / 6) + 1)
    row, col = geometry.pixel_of(x, y, 200_000.0, 3_200_000.0, 1000.0)
    return s.select("site_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), row.alias("row"), col.alias("col"))


def polygons_around(spark, sf):
    """Triangles as GeoJSON and back, their boxes, and which sites' points they hold."""
    s = views.sites(spark, sf)
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    lon, lat = F.col("lon"), F.col("lat")
    ring = F.array(p(lon, lat), p(lon + 0.2, lat), p(lon, lat + 0.2), p(lon, lat))
    s = s.withColumn("json", geometry.to_geojson(ring)).withColumn("ring", geometry.from_geojson(F.col("json"))).withColumn("box", geometry.bounds(F.col("ring")))
    d = F.col("site_id") % 20 / 100.0
    return s.select("site_id", F.round("box.x1", 6).alias("x1"), F.round("box.y1", 6).alias("y1"), geometry.contains(F.col("ring"), lon + d + 0.001, lat + 0.05).alias("inside"), F.size(geometry.thinned(F.col("ring"), 0.5)).alias("points"))


QUERIES = {f.__name__: f for f in (sar_change_regions, lost_vegetation, detected_lakes, radar_lake_area, new_fractures, fast_hotspots, node_ratios, opened_masks, cell_clusters, utm_positions, polygons_around)}
def labels_sql(mask: str, name: str = "l", key: str = "scene") -> str:
    """CTE of the labels of a mask (key, row, col): the smallest place that 8-neighbours reach."""
    return f"""{name}_b AS (SELECT {key}, row, col, row::BIGINT * 1048576 + col AS id FROM {mask}), {name}_r({key}, id, row, col, label) AS (SELECT {key}, id, row, col, id FROM {name}_b UNION SELECT b.{key}, b.id, b.row, b.col, r.label FROM {name}_r r JOIN {name}_b b ON b.{key} = r.{key} AND abs(b.row - r.row) <= 1 AND abs(b.col - r.col) <= 1 AND r.label < b.id),
 {name} AS (SELECT {key}, row, col, min(label) AS label FROM {name}_r GROUP BY 1, 2, 3)"""


_CROSS = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) d(r, c)"


def eroded_sql(name: str, mask: str) -> str:
    return f"{name} AS (SELECT a.scene, a.row, a.col FROM {mask} a JOIN {mask} b ON a.scene = b.scene AND abs(a.row - b.row) + abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 5)"


def dilated_sql(name: str, mask: str) -> str:
    return f"{name} AS (SELECT DISTINCT scene, row, col FROM (SELECT scene, row + r AS row, col + c AS col FROM {mask}, {_CROSS}) WHERE row BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7)"


def shapes_sql(labels: str, name: str) -> str:
    return f"""{name}_g AS (SELECT scene, label, count(*) AS pixels, avg(row) AS row, avg(col) AS col, var_pop(row) AS rr, var_pop(col) AS cc, covar_pop(row, col) AS rc FROM {labels} GROUP BY 1, 2), {name}_m AS (SELECT *, (rr + cc) / 2 + 1.0::DOUBLE / 12 AS m, sqrt(pow((rr - cc) / 2, 2) + rc * rc) AS q FROM {name}_g),
 {name}_s AS (SELECT scene, label, pixels, row, col, 4 * sqrt(m + q) AS major, 4 * sqrt(greatest(m - q, 0)) AS minor FROM {name}_m), {name} AS (SELECT *, sqrt(1 - pow(minor / major, 2)) AS ecc FROM {name}_s)"""


_S = f"{views.PIXELS}, s AS (SELECT scene, row, col, v * 30 AS v, row * 120.0::DOUBLE + col * 7 AS z, col * 4.0::DOUBLE AS slope, row < 2 AS ice, row = 7 AND col = 7 AS exclude, (row + col) % 7 <> 0 AS valid, abs(row - 2) * 100.0::DOUBLE AS ice_m, row BETWEEN 1 AND 6 AS core FROM px)"
_BASE = """half AS (SELECT label, quantile_cont(scene, 0.5) AS mid FROM px GROUP BY 1), sp AS (SELECT px.label, scene, row, col, abs(v) * 10 AS v, scene <= mid AS old FROM px JOIN half USING (label)),
 sm AS (SELECT a.label, a.scene, a.row, a.col, median(b.v) AS v FROM sp a JOIN sp b ON a.old AND b.old AND a.scene = b.scene AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3, 4), bl AS (SELECT label, row, col, median(v) AS base FROM sm GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
ORACLES = {
    "sar_change_regions": f"""WITH RECURSIVE {_S}, bm AS (SELECT *, floor((z - min(z) OVER (PARTITION BY scene)) / 200) AS band FROM s), bs AS (SELECT scene, band, count(*) AS n, avg(CASE WHEN v > 1 THEN 1.0::DOUBLE ELSE 0 END) AS up, avg(CASE WHEN v < -1 THEN 1.0::DOUBLE ELSE 0 END) AS down FROM bm GROUP BY 1, 2),
 m0 AS (SELECT scene, row, col FROM bm JOIN bs USING (scene, band) WHERE abs(v) > 1 AND NOT exclude AND NOT (n >= 8 AND (v > 1 AND up > 0.6 OR v < -1 AND down > 0.6))), {eroded_sql("m1", "m0")}, {dilated_sql("m2", "m1")}, {dilated_sql("m3", "m2")}, {dilated_sql("m4", "m3")}, {eroded_sql("m5", "m4")}, {eroded_sql("m6", "m5")}, {labels_sql("m6")},
 g AS (SELECT scene, label, count(*) AS pixels, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS relief, avg(v) AS mean, avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS brighter, avg(slope) AS slope, avg(CASE WHEN ice THEN 1.0::DOUBLE ELSE 0 END) AS on_ice FROM l JOIN s USING (scene, row, col) GROUP BY 1, 2),
 t AS (SELECT scene, sum(pixels) - list_sum(list_sort(list(pixels), 'DESC')[1:3]) AS rest FROM g GROUP BY 1), x AS (SELECT *, rest / 64.0::DOUBLE > 0.04 AS disturbed FROM g JOIN t USING (scene))
 SELECT scene, label, pixels, round(relief, 6) AS relief, round(mean, 6) AS mean, round(brighter, 6) AS brighter, round(on_ice, 6) AS on_ice, round(least(1, 0.2::DOUBLE + 0.35::DOUBLE * least(relief / 500, 1) + 0.25::DOUBLE * least(slope / 30, 1) + 0.2::DOUBLE * least(pixels * 10000 / 5e5::DOUBLE, 1)) * CASE WHEN disturbed THEN 0.5::DOUBLE ELSE 1 END, 4) AS confidence,
 disturbed, brighter <= 0.1 AND mean <= -3 AND relief < 800 AS snow_like FROM x WHERE pixels >= 4 AND NOT (on_ice > 0.8 AND relief < 400)""",
    "lost_vegetation": f"""WITH RECURSIVE {_S}, bo AS (SELECT b.scene, b.row, b.col, b.slope, b.valid, 0.7::DOUBLE + a.v / 20 AS before, 0.2::DOUBLE + b.v / 20 AS after, a.v AS b0, b.v + 4 AS b1, CASE WHEN (b.scene + b.row // 4) % 4 = 0 THEN 40 ELSE 10 END AS cover FROM s a JOIN s b ON a.scene + 1 = b.scene AND a.row = b.row AND a.col = b.col),
 m0 AS (SELECT scene, row, col FROM bo WHERE valid AND before > 0.45 AND before - after > 0.25 AND b1 > b0), {eroded_sql("m1", "m0")}, {dilated_sql("m2", "m1")}, {labels_sql("m2")}, {shapes_sql("l", "sh")},
 f AS (SELECT scene, label, avg(before - after) AS dr, avg(slope) AS slope, CASE WHEN count(CASE WHEN cover = 10 THEN 1 END) >= count(CASE WHEN cover = 40 THEN 1 END) THEN 10 ELSE 40 END AS cover FROM l JOIN bo USING (scene, row, col) GROUP BY 1, 2)
 SELECT scene, label, pixels, CASE WHEN cover = 40 THEN 'cropland_change' WHEN slope > 25 AND ecc > 0.9 THEN 'mass_movement' ELSE 'vegetation_loss' END AS kind, round(dr, 6) AS drop, round(greatest(0.2, least(0.9, 0.4 + dr - 0.25)), 6) AS confidence FROM sh JOIN f USING (scene, label) WHERE pixels >= 3""",
    "detected_lakes": f"""WITH RECURSIVE {_S}, m AS (SELECT scene, row, col FROM s WHERE v > 2), {labels_sql("m")}, {shapes_sql("l", "sh")},
 h AS (SELECT scene, label, median(z) AS z, quantile_cont(z, 0.9) - quantile_cont(z, 0.1) AS z_range, min(ice_m) AS ice_m FROM l JOIN s USING (scene, row, col) GROUP BY 1, 2),
 q AS (SELECT scene, label, 1 - avg(CASE WHEN valid THEN 0 ELSE 1.0::DOUBLE END) AS quality FROM (SELECT DISTINCT l.scene, l.label, s.row, s.col, s.valid FROM l JOIN s ON l.scene = s.scene AND abs(l.row - s.row) + abs(l.col - s.col) <= 2) GROUP BY 1, 2),
 w AS (SELECT l.scene, l.label, max(s.slope) AS wall_slope FROM l JOIN s ON l.scene = s.scene AND abs(l.row - s.row) <= 2 AND abs(l.col - s.col) <= 2 GROUP BY 1, 2), e AS (SELECT *, major / greatest(minor, 1) AS elongation FROM sh JOIN h USING (scene, label) JOIN q USING (scene, label) JOIN w USING (scene, label))
 SELECT scene, label, pixels, round(z, 6) AS z, round(z_range, 6) AS z_range, round(quality, 6) AS quality, round(elongation, 6) AS elongation, round(wall_slope, 6) AS wall_slope, round(ice_m, 6) AS ice_m FROM e WHERE pixels >= 4 AND (elongation <= 7 OR pixels >= 200) AND ice_m <= 250 AND floor(row + 0.5) BETWEEN 1 AND 6""",
    "radar_lake_area": f"""WITH RECURSIVE {_S}, rl AS (SELECT scene, row, col, slope, row BETWEEN 2 AND 5 AND col BETWEEN 0 AND 3 AS lake, CASE WHEN (row * 8 + col + scene) % 9 <> 0 THEN v - CASE WHEN row BETWEEN 2 AND 5 AND col BETWEEN 0 AND 3 THEN 22 ELSE 15 END END AS v FROM s),
 zn AS (SELECT * FROM rl WHERE EXISTS (SELECT 1 FROM range(2, 6) a(r), range(0, 4) b(c) WHERE abs(r - row) + abs(c - col) <= 2)), fc AS (SELECT scene, count(v) AS n, avg(CASE WHEN v IS NULL THEN 0 ELSE 1.0::DOUBLE END) AS seen, count(CASE WHEN lake THEN 1 END) AS lk FROM zn GROUP BY 1 HAVING count(v) >= 20 AND avg(CASE WHEN v IS NULL THEN 0 ELSE 1.0::DOUBLE END) >= 0.7),
 zv AS (SELECT zn.*, seen, lk FROM zn JOIN fc USING (scene) WHERE v IS NOT NULL), hi AS (SELECT scene, least(39, greatest(0, floor((v + 24) / 10 * 40)))::INTEGER AS bin, count(*) AS n FROM zv GROUP BY 1, 2), mi AS (SELECT *, -24 + (bin + 0.5::DOUBLE) * 10 / 40 AS mid FROM hi),
 cu AS (SELECT scene, bin, sum(n) OVER w AS n0, sum(n * mid) OVER w AS s0, sum(n) OVER (PARTITION BY scene) AS n, sum(n * mid) OVER (PARTITION BY scene) AS s FROM mi WINDOW w AS (PARTITION BY scene ORDER BY bin)), be AS (SELECT scene, bin, coalesce(round(n0::DOUBLE * (n - n0)::DOUBLE * pow(s0 / n0 - (s - s0) / nullif(n - n0, 0), 2), 6), 0) AS b FROM cu),
 th AS (SELECT scene, -24 + (arg_max(bin, (b, -bin)) + 1) * 10 / 40::DOUBLE AS cut FROM be GROUP BY 1), wt AS (SELECT zv.*, v < cut AND slope < 15 AS wet FROM zv JOIN th USING (scene)), m0 AS (SELECT scene, row, col FROM wt WHERE wet), {eroded_sql("m1", "m0")}, {dilated_sql("m2", "m1")}, {labels_sql("m2")},
 lw AS (SELECT l.scene, label, lake FROM l JOIN wt USING (scene, row, col)), tc AS (SELECT scene, sum(p) AS pixels, sum(k) AS shared FROM (SELECT scene, label, bool_or(lake) AS t, count(*) AS p, count(CASE WHEN lake THEN 1 END) AS k FROM lw GROUP BY 1, 2) WHERE t GROUP BY 1),
 lv AS (SELECT scene, avg(CASE WHEN wet THEN v END) AS w, avg(CASE WHEN NOT wet THEN v END) AS d, max(lk) AS lk, max(seen) AS seen FROM wt GROUP BY 1)
 SELECT scene, coalesce(pixels, 0) * 100.0::DOUBLE AS area, round(CASE WHEN pixels IS NULL THEN 0.3 ELSE coalesce(greatest(0, least(1, (d - w) / 8)) * seen * greatest(0, least(1, (shared / nullif(lk, 0)) / 0.7)), 0) END, 6) AS quality FROM lv LEFT JOIN tc USING (scene)""",
    "new_fractures": f"""WITH RECURSIVE {views.PIXELS}, bo AS (SELECT b.scene, b.row, b.col, abs(b.v) AS after, abs(a.v) / 4 AS before FROM px a JOIN px b ON a.scene + 1 = b.scene AND a.row = b.row AND a.col = b.col), sn AS (SELECT * FROM bo WHERE row < 7 AND col > 0),
 fa AS (SELECT scene, count(*) AS n, greatest(quantile_cont(after, 0.5), 0.02) AS cut, avg(after) - avg(before) AS energy FROM sn GROUP BY 1 HAVING count(*) >= 30), m0 AS (SELECT scene, row, col FROM sn JOIN fa USING (scene) WHERE after > cut AND before < 0.5 * cut),
 m1 AS (SELECT DISTINCT a.scene, a.row, a.col FROM m0 a JOIN m0 b ON a.scene = b.scene AND abs(a.row - b.row) + abs(a.col - b.col) = 1), {labels_sql("m1")}, {shapes_sql("l", "sh")}, lo AS (SELECT scene, sum(major) * 30 AS length FROM sh WHERE major >= 3 AND ecc > 0.9 GROUP BY 1)
 SELECT scene, round(coalesce(length, 0), 6) AS length, round(energy, 6) AS energy, round(n / 56.0::DOUBLE, 6) AS observed FROM fa LEFT JOIN lo USING (scene)""",
    "fast_hotspots": f"""WITH RECURSIVE {views.PIXELS}, {_BASE}, ht AS (SELECT scene, label AS tile, row, col, v, base, 0.1::DOUBLE + (scene % 5)::DOUBLE / 10 AS corr FROM sp JOIN bl USING (label, row, col) WHERE NOT old AND row <> 4 AND v >= 1.0 AND v >= 1.3 * greatest(base, 0.05)), {labels_sql("ht")},
 g AS (SELECT l.scene, l.label, count(*) AS nodes, median(v) AS speed, max(v) AS top, median(v / greatest(base, 0.05)) AS ratio, avg(corr) AS corr FROM l JOIN ht USING (scene, row, col) GROUP BY 1, 2)
 SELECT g.scene, (SELECT min(tile) FROM ht WHERE ht.scene = g.scene)::INTEGER AS tile, g.label, nodes, round(speed, 6) AS speed, round(top, 6) AS top, round(ratio, 6) AS ratio, round(corr, 6) AS corr, round(least(1, 2 * corr), 6) AS confidence FROM g WHERE nodes >= 3 AND round(corr, 9) >= 0.2""",
    "node_ratios": f"WITH {views.PIXELS}, {_BASE}, g AS (SELECT scene, count(*) AS n, median(v) AS v, median(base) AS base FROM sp JOIN bl USING (label, row, col) WHERE NOT old AND row < 4 GROUP BY 1) SELECT scene, n, round(v, 6) AS v, round(base, 6) AS base, round(CASE WHEN v > 0.05 THEN v / greatest(base, 0.05) ELSE 1 END, 6) AS ratio FROM g WHERE n >= 4",
    "opened_masks": f"""WITH {views.PIXELS}, m AS (SELECT scene, row, col FROM px WHERE v > -0.05), e AS (SELECT a.scene, a.row, a.col FROM m a JOIN m b ON a.scene = b.scene AND abs(a.row - b.row) + abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 5),
 d(r, c) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) SELECT scene, count(*) AS pixels FROM (SELECT DISTINCT scene, row + r, col + c FROM e, d) GROUP BY 1""",
    "cell_clusters": f"""WITH RECURSIVE {views.SITES}, b AS (SELECT 0 AS scene, (site_id // 12)::INTEGER AS row, (site_id % 12)::INTEGER AS col, z FROM site WHERE z > 2000 AND kind <> 'glacial_lake'), {labels_sql("b")}
 SELECT label, count(*) AS cells, round(max(z), 4) AS z, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1 FROM l JOIN b USING (scene, row, col) GROUP BY 1""",
}
