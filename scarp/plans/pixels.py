"""Pixel operators over scenes of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectral
from ..operators import raster, routing, tracking
from ..sources import views
from .statistics import six

RAW = "raw AS (SELECT vec_id AS scene, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)"


def _bands(spark, sf):
    """Two neighbouring pixels and their rows as bands, shifted to be positive."""
    px = views.pixels(spark, sf)
    even, odd = px.where("col % 2 = 0").withColumn("v", F.col("v") + 3), px.where("col % 2 = 1").withColumn("col", F.col("col") - 1).select("scene", "row", "col", (F.col("v") + 3).alias("w"))
    return even.join(odd, ["scene", "row", "col"])


BANDS = f"{views.PIXELS}, b AS (SELECT p.scene, p.row, p.col, p.v + 3 AS v, q.v + 3 AS w FROM px p JOIN px q ON p.scene = q.scene AND p.row = q.row AND p.col + 1 = q.col WHERE p.col % 2 = 0)"


def band_indices(spark, sf):
    a, b = F.col("v"), F.col("w")
    out = {"ndwi": spectral.ndwi(a, b), "bright": spectral.brightness(a, b), "turbidity": spectral.turbidity(a, b), "p": spectral.logistic(a, 3.0, 0.5), "db": spectral.decibels(a)}
    return _bands(spark, sf).select("scene", "row", "col", *[F.round(c, 6).alias(k) for k, c in out.items()])


def surface_classes(spark, sf):
    g, nir, swir = F.col("v") / 10, F.col("w") / 12, F.col("v") / 15
    scl, slope = (F.col("row") + F.col("col")) % 8, F.col("row") * 4.0
    water = spectral.is_water(g, nir, swir, g, scl, slope, F.col("col") == 2)
    kind = spectral.classified(water, spectral.is_snow(g, nir, swir, water), F.col("row") > 5, ~scl.isin(*spectral.CLOUD))
    return _bands(spark, sf).groupBy("row", kind.alias("kind")).agg(F.count("*").alias("n"))


def scene_medians(spark, sf):
    return raster.region_summary(views.pixels(spark, sf), ["scene"], 0.1).select("scene", "n", *six("median", "mean", "p90", "se"))


def median_filtered(spark, sf):
    out = raster.median_filter(views.pixels(spark, sf).select("scene", "row", "col", "v"), ["scene"])
    return out.select("scene", "row", "col", F.round("median", 6).alias("median"))


def lee_filtered(spark, sf):
    out = raster.lee_filter(views.pixels(spark, sf).select("scene", "row", "col", "v"), ["scene"])
    return out.select("scene", "row", "col", F.round("filtered", 5).alias("filtered"))


def slopes(spark, sf):
    out = raster.slope_aspect(views.pixels(spark, sf).select("scene", "row", "col", "v"), ["scene"], 1.0)
    return out.select("scene", "row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 4).alias("aspect"))


def change_of_scenes(spark, sf):
    """Each scene against the one before, both without speckle, by pixel, and the bands that change together."""
    px = views.pixels(spark, sf).select("scene", "row", "col", "v")
    pre = px.withColumn("scene", F.col("scene") + 1)
    change = raster.log_ratio(pre, px, ["scene"], 2).withColumnRenamed("change", "v").withColumn("z", F.col("row") * 100.0)
    out = raster.seasonal_bands(change, ["scene"], "z", 200.0, 0.1, 0.35, 10)
    return out.groupBy("scene", "band").agg(F.count("*").alias("n"), F.sum(F.col("seasonal").cast("int")).alias("flagged"), F.round(F.avg("v"), 6).alias("mean"))


def bright_regions(spark, sf):
    """8-connected regions of bright pixels, with their shapes."""
    px = views.pixels(spark, sf).where("v > 0.08").select("scene", "row", "col")
    out = raster.region_shapes(raster.regions(px, ["scene"]), ["scene"])
    return out.select("scene", "label", "pixels", *six("row", "col", "major", "minor"))


def otsu_thresholds(spark, sf):
    out = raster.otsu(views.pixels(spark, sf), ["label"], 32, -0.5, 0.5)
    return out.select("label", "bin", F.round("threshold", 6).alias("threshold"))


def corrected_offsets(spark, sf):
    """Offsets in both directions, each less that of stable ground."""
    px = views.pixels(spark, sf)
    out = raster.stable_ground(px, ["scene"], F.col("row") < 5).withColumnsRenamed({"corrected": "dx", "nmad": "nmad_x"})
    both = raster.stable_ground(out.withColumn("v", F.col("v") * 0.5 + F.col("col") / 10), ["scene"], F.col("row") < 5).withColumnsRenamed({"corrected": "dy", "nmad": "nmad_y"})
    return both.select("scene", "row", "col", *six("dx", "nmad_x", "dy", "nmad_y"))


def cell_speeds(spark, sf):
    """Of watched nodes in the tile's core, by cell."""
    nodes = views.pixels(spark, sf).where((F.col("row") > 0) & (F.col("col") != 3))
    out = raster.cell_medians(nodes, ["scene"], 4, 0.1)
    return out.select("scene", "cell_row", "cell_col", "n", *six("v", "se"))


def flow_receivers(spark, sf):
    out = routing.receivers(views.pixels(spark, sf).select("scene", "row", "col", "v"), ["scene"], 10.0)
    return out.select("scene", "row", "col", "to_row", "to_col", F.round("drop", 8).alias("drop"))


def flow_paths(spark, sf):
    scenes = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile"), F.col("embedding").cast("array<double>").alias("z"))
    starts = scenes.select(F.col("tile").alias("start_id"), "tile", F.lit(3).alias("row"), (F.col("tile") % 6 + 1).cast("int").alias("col"))
    starts = routing.snapped_starts(views.pixels(spark, sf).select(F.col("scene").alias("tile"), "row", "col", "v"), ["tile"], starts, 1)
    out = routing.paths(scenes, starts, 8, 8, 30.0, 1.0)
    return out.select("start_id", "step", "row", "col", F.round("along_km", 6).alias("along_km"))


def chip_offsets(spark, sf):
    """Offsets of each scene against itself shifted by one row and two columns: they come back as they were."""
    e = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("pair"), F.col("embedding").cast("array<double>").alias("ref"))
    place = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("ref", (F.floor((i / 8)) + 7) % 8 * 8 + (i + 6) % 8))
    return raster.offsets(e.withColumn("sec", place), 8).select("pair", *six("dr", "dc", "corr"))


def offset_lattice(spark, sf):
    """Scenes laid out as mosaics of 64 x 64 pixels, and the same shifted by one row and two columns: offsets on a lattice of
    overlapping chips, with what holds of them."""
    px = views.pixels(spark, sf).select((F.col("scene") / 64).cast("int").alias("mosaic"), (F.floor(F.col("scene") % 64 / 8) * 8 + F.col("row")).cast("int").alias("row"), (F.col("scene") % 8 * 8 + F.col("col")).cast("int").alias("col"), "v")
    moved = px.select("mosaic", ((F.col("row") + 1) % 64).alias("row"), ((F.col("col") + 2) % 64).alias("col"), F.col("v").alias("sec"))
    pair = px.withColumnRenamed("v", "ref").join(moved, ["mosaic", "row", "col"], "left")
    out = tracking.offset_field(pair, ["mosaic"], 32, 8)
    return out.select("mosaic", "row", "col", *six("dx", "dy", "corr"))


def tracked_nodes(spark, sf):
    """Offsets of a lattice's nodes that hold against peaks, shifts and their neighbours."""
    px = views.pixels(spark, sf)
    nodes = px.select("scene", "row", "col", (F.col("v") * 8).alias("dr"), (F.col("v") * 4 + F.col("row") / 4).alias("dc"), F.abs(F.col("v") * 3).alias("corr"), (F.col("col") + 2.0).alias("snr"))
    return raster.tracked(nodes, ["scene"], 8, 0.1, 4.0, 1.0).select("scene", "row", "col", *six("dx", "dy"))


QUERIES = {f.__name__: f for f in (offset_lattice, tracked_nodes, band_indices, surface_classes, scene_medians, median_filtered, lee_filtered, slopes, change_of_scenes, bright_regions, otsu_thresholds, corrected_offsets, cell_speeds, flow_receivers, flow_paths, chip_offsets)}
ORACLES = {
    "tracked_nodes": f"WITH {views.PIXELS}, n AS (SELECT scene, row, col, v * 8 AS dr, v * 4 + row / 4::DOUBLE AS dc FROM px WHERE abs(v * 3) >= 0.1 AND col + 2 >= 4 AND abs(v * 8) <= 2 AND abs(v * 4 + row / 4::DOUBLE) <= 2), m AS (SELECT a.scene, a.row, a.col, any_value(a.dr) AS dr, any_value(a.dc) AS dc, median(b.dr) AS mr, median(b.dc) AS mc FROM n a JOIN n b ON a.scene = b.scene AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3) SELECT scene, row, col, round(dc, 6) AS dx, round(-dr, 6) AS dy FROM m WHERE abs(dr - mr) <= 1 AND abs(dc - mc) <= 1",
    "band_indices": f"WITH {BANDS} SELECT scene, row, col, round((v - w) / (v + w), 6) AS ndwi, round((v + w) / 2, 6) AS bright, round(v / w, 6) AS turbidity, round(1 / (1 + exp(-(v - 3) / 0.5::DOUBLE)), 6) AS p, round(10 * log10(v), 6) AS db FROM b",
    "scene_medians": f"WITH {RAW} SELECT scene, count(v) AS n, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, round(0.1::DOUBLE / sqrt(greatest(1, count(v) / 16)), 6) AS se FROM raw GROUP BY 1",
    "median_filtered": f"WITH {views.PIXELS} SELECT a.scene, a.row, a.col, round(median(b.v), 6) AS median FROM px a JOIN px b ON a.scene = b.scene AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3",
    "lee_filtered": f"WITH {views.PIXELS}, l AS (SELECT *, pow(10, v / 10) AS x FROM px), f AS (SELECT a.scene, a.row, a.col, any_value(a.x) AS x, avg(b.x) AS m, var_pop(b.x) AS s FROM l a JOIN l b ON a.scene = b.scene AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2, 3), w AS (SELECT *, avg(s) OVER (PARTITION BY scene) AS t FROM f) SELECT scene, row, col, round(10 * log10(m + s / (s + t) * (x - m)), 5) AS filtered FROM w",
    "slopes": f"""WITH {views.PIXELS}, n AS (SELECT *, lag(v) OVER r AS r0, lead(v) OVER r AS r1, lag(v) OVER c AS c0, lead(v) OVER c AS c1 FROM px WINDOW r AS (PARTITION BY scene, col ORDER BY row), c AS (PARTITION BY scene, row ORDER BY col)),
 g AS (SELECT *, CASE WHEN r0 IS NULL THEN r1 - v WHEN r1 IS NULL THEN v - r0 ELSE (r1 - r0) / 2 END AS y, CASE WHEN c0 IS NULL THEN c1 - v WHEN c1 IS NULL THEN v - c0 ELSE (c1 - c0) / 2 END AS x FROM n)
 SELECT scene, row, col, round(degrees(atan(sqrt(x * x + y * y))), 5) AS slope, round((degrees(atan2(-x, y)) + 360) % 360, 4) AS aspect FROM g""",
    "change_of_scenes": f"""WITH {views.PIXELS}, l AS (SELECT *, pow(10, v / 10) AS x FROM px), f AS (SELECT a.scene, a.row, a.col, any_value(a.x) AS x, avg(b.x) AS m, var_pop(b.x) AS s FROM l a JOIN l b ON a.scene = b.scene AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2, 3), w AS (SELECT *, avg(s) OVER (PARTITION BY scene) AS t FROM f), fl AS (SELECT scene, row, col, 10 * log10(m + s / (s + t) * (x - m)) AS v FROM w),
 c AS (SELECT b.scene, b.row, b.v - a.v AS v, floor(b.row * 100 / 200.0)::INTEGER AS band FROM fl a JOIN fl b ON a.scene + 1 = b.scene AND a.row = b.row AND a.col = b.col),
 e AS (SELECT scene, band, count(*) AS n, avg(CASE WHEN v > 0.1 THEN 1.0 ELSE 0 END) AS up, avg(CASE WHEN v < -0.1 THEN 1.0 ELSE 0 END) AS down FROM c GROUP BY 1, 2)
 SELECT scene, band, count(*) AS n, sum(CASE WHEN e.n >= 10 AND ((v > 0.1 AND up > 0.35) OR (v < -0.1 AND down > 0.35)) THEN 1 ELSE 0 END)::BIGINT AS flagged, round(avg(v), 6) AS mean FROM c JOIN e USING (scene, band) GROUP BY 1, 2""",
    "corrected_offsets": f"WITH {views.PIXELS}, p AS (SELECT scene, row, col, v, v * 0.5::DOUBLE + col / 10::DOUBLE AS w FROM px), m AS (SELECT scene, median(v) AS m, median(w) AS mw FROM p WHERE row < 5 GROUP BY 1), s AS (SELECT scene, 1.4826::DOUBLE * median(abs(v - m)) AS nx, 1.4826::DOUBLE * median(abs(w - mw)) AS ny FROM p JOIN m USING (scene) WHERE row < 5 GROUP BY 1) SELECT scene, row, col, round(v - m, 6) AS dx, round(nx, 6) AS nmad_x, round(w - mw, 6) AS dy, round(ny, 6) AS nmad_y FROM p JOIN m USING (scene) JOIN s USING (scene)",
    "cell_speeds": f"WITH {views.PIXELS} SELECT scene, (row // 4)::INTEGER AS cell_row, (col // 4)::INTEGER AS cell_col, count(v) AS n, round(median(v), 6) AS v, round(1.2533::DOUBLE * 0.1::DOUBLE / sqrt(greatest(1, count(v) / 16)), 6) AS se FROM px WHERE row > 0 AND col <> 3 GROUP BY 1, 2, 3 HAVING count(v) >= 8",
    "flow_receivers": f"""WITH {views.PIXELS}, d AS (SELECT a.scene, a.row, a.col, b.row AS to_row, b.col AS to_col, (a.v - b.v) / (10 * CASE WHEN a.row <> b.row AND a.col <> b.col THEN 1.4142135::DOUBLE ELSE 1 END) AS dr FROM px a JOIN px b ON a.scene = b.scene AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)),
 m AS (SELECT scene, row, col, arg_max(to_row, dr) AS to_row, arg_max(to_col, dr) AS to_col, max(dr) AS dr FROM d WHERE dr > 0 GROUP BY 1, 2, 3) SELECT scene, row, col, to_row, to_col, round(dr, 8) AS drop FROM px LEFT JOIN m USING (scene, row, col)""",
    "bright_regions": f"""WITH RECURSIVE {views.PIXELS}, b AS (SELECT scene, row, col, row::BIGINT * 1048576 + col AS id FROM px WHERE v > 0.08), r(scene, id, row, col, label) AS (SELECT scene, id, row, col, id FROM b UNION SELECT b.scene, b.id, b.row, b.col, r.label FROM r JOIN b ON b.scene = r.scene AND abs(b.row - r.row) <= 1 AND abs(b.col - r.col) <= 1 AND r.label < b.id),
 l AS (SELECT scene, row, col, min(label) AS label FROM r GROUP BY 1, 2, 3), g AS (SELECT scene, label, count(*) AS pixels, avg(row) AS row, avg(col) AS col, var_pop(row) AS rr, var_pop(col) AS cc, covar_pop(row, col) AS rc FROM l GROUP BY 1, 2),
 x AS (SELECT *, (rr + cc) / 2 + 1.0::DOUBLE / 12 AS m, sqrt(pow((rr - cc) / 2, 2) + rc * rc) AS q FROM g) SELECT scene, label, pixels, round(row, 6) AS row, round(col, 6) AS col, round(4 * sqrt(m + q), 6) AS major, round(4 * sqrt(greatest(m - q, 0)), 6) AS minor FROM x""",
    "otsu_thresholds": f"""WITH {views.PIXELS}, h AS (SELECT label, least(31, greatest(0, floor((v + 0.5) * 32)))::INTEGER AS bin, count(*) AS n FROM px GROUP BY 1, 2), m AS (SELECT *, -0.5::DOUBLE + (bin + 0.5::DOUBLE) / 32 AS mid FROM h),
 c AS (SELECT label, bin, sum(n) OVER w AS n0, sum(n * mid) OVER w AS s0, sum(n) OVER (PARTITION BY label) AS n, sum(n * mid) OVER (PARTITION BY label) AS s FROM m WINDOW w AS (PARTITION BY label ORDER BY bin)), b AS (SELECT label, bin, coalesce(round(n0::DOUBLE * (n - n0)::DOUBLE * pow(s0 / n0 - (s - s0) / nullif(n - n0, 0), 2), 6), 0) AS b FROM c)
 SELECT label, arg_max(bin, (b, -bin)) AS bin, round(-0.5::DOUBLE + (arg_max(bin, (b, -bin)) + 1) / 32::DOUBLE, 6) AS threshold FROM b GROUP BY 1""",
    "chip_offsets": None,
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
