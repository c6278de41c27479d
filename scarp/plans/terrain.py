"""Terrain, masks, grids and velocity products over scenes and areas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry, spectral
from ..operators import raster, tables, terrain
from ..sources import views
from .detections import labels_sql
from .statistics import r6, six


def _heights(spark, sf):
    """Scenes as terrain: a slope to the south with bumps, 30 m a pixel."""
    return views.pixels(spark, sf).select("scene", "row", "col", (3300 - F.col("row") * 12.0 + F.col("v") * 200).alias("v"))


HEIGHTS = f"{views.PIXELS}, h AS (SELECT scene, row, col, 3300 - row * 12.0::DOUBLE + v * 200 AS v FROM px)"
SUN, UP = 135.0, 20.0


def cast_shadows(spark, sf):
    out = terrain.cast_shadow(_heights(spark, sf), ["scene"], 30.0, SUN, UP, 210.0)
    return out.where("shadow").select("scene", "row", "col")


def terrain_shadows(spark, sf):
    out = terrain.terrain_shadow(_heights(spark, sf), ["scene"], 10.0, SUN, UP, every=2)
    return out.groupBy("scene").agg(F.count_if("shadow").alias("shadow"), F.count("*").alias("n"))


def hillshades(spark, sf):
    s = raster.slope_aspect(_heights(spark, sf), ["scene"], 30.0)
    return s.select("scene", "row", "col", F.round(spectral.hillshade(F.col("slope"), F.col("aspect"), SUN, UP), 6).alias("light"))


def highpassed(spark, sf):
    px = views.pixels(spark, sf).withColumn("v", F.when((F.col("row") * 8 + F.col("col")) % 11 != 0, F.col("v")))
    return terrain.highpass(px.select("scene", "row", "col", "v"), ["scene"], 1.0).select("scene", "row", "col", F.round("high", 6).alias("high"))


def static_layers(spark, sf):
    px = _heights(spark, sf).withColumn("glacier", (F.col("row") == 0) & (F.col("col") < 3))
    out = terrain.tile_static(px, ["scene"], 30.0, 3280.0, 70.0, 4)
    return out.select("scene", "row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 3).alias("aspect"), "watch", "stable", "sample")


def dry_land(spark, sf):
    """Whether lakes stand on what was dry in the composite of their label's earlier scenes."""
    px = views.pixels(spark, sf)
    lakes = px.where("v > 0.15").select("label", F.col("scene").alias("lake"), "row", "col")
    comp = px.groupBy("label", "row", "col").agg(F.max_by("v", "scene").alias("v")).where("row < 7").select("label", "row", "col", (F.col("v") - 0.02).alias("ndwi"), (0.1 - F.col("v") / 10).alias("nir"))
    out = terrain.was_dry(lakes.withColumnRenamed("lake", "_l").withColumn("label2", F.col("_l")).select("label", "row", "col", F.col("label2").alias("scene")).withColumnRenamed("label", "tile").withColumnRenamed("scene", "label"), comp.withColumnRenamed("label", "tile"), ["tile"])
    return out.select(F.col("label").alias("scene"), *six("seen", "dry"), "was_dry")


def clear_scenes(spark, sf):
    """Scenes with enough clear pixels, and their mean reflectance."""
    px = views.pixels(spark, sf).withColumn("scl", (F.col("row") + F.col("col") + F.col("scene")) % 12).withColumn("dn", F.round(F.col("v") * 1000) + 3000)
    fine = terrain.clear_share(px, ["scene"], 0.5)
    mean = px.groupBy("scene").agg(F.round(F.avg(terrain.reflectance(F.col("dn"), F.lit(-1000.0))), 8).alias("mean"))
    return fine.join(mean, "scene").select("scene", *six("clear"), "mean")


def false_colours(spark, sf):
    return terrain.stretched(views.pixels(spark, sf), ["label"]).groupBy("label", "byte").agg(F.count("*").alias("n"))


def surface_masks(spark, sf):
    """Water and snow by spectral rules under shadow, what clouds hide left out; the share that is valid."""
    px = views.pixels(spark, sf)
    g, nir, swir = (F.col("v") + 3) / 10, (3 - F.col("v")) / 30, (3 - F.col("v")) / 25
    scl, slope, dark = (F.col("row") + F.col("col")) % 8, F.col("row") * 4.0, F.col("col") == 2
    water = spectral.is_water(g, nir, swir, g, scl, slope, dark)
    kind = spectral.classified(water, spectral.is_snow(g, nir, swir, water), F.col("row") > 5, ~scl.isin(*spectral.CLOUD) & ~((scl == 3) & ~water))
    out = px.withColumn("kind", kind).withColumn("veg", spectral.ndvi(nir, g))
    return out.groupBy("scene").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("water", "snow", "debris", "other")], F.round(F.avg((F.col("kind") != "none").cast("double")), 6).alias("valid"), F.round(F.avg("veg"), 6).alias("ndvi"))


def surface_probabilities(spark, sf):
    """How sure the rules are of water and of snow at each pixel."""
    g, nir, swir = (F.col("v") + 3) / 10, (3 - F.col("v")) / 30, (3 - F.col("v")) / 25
    water = spectral.water_probability(g, nir, swir, g, F.col("row") * 4.0, F.col("col") == 2)
    return views.pixels(spark, sf).select("scene", "row", "col", F.round(water, 6).alias("water"), F.round(spectral.snow_probability(g, nir, swir), 6).alias("snow"))


def _nodes(spark, sf):
    """Offsets on a lattice from a scene and the next: what correlates badly is not valid."""
    px = views.pixels(spark, sf)
    nxt = px.select((F.col("scene") - 1).alias("scene"), "row", "col", F.col("v").alias("w"))
    ok = F.col("corr") >= 0.1
    both = px.join(nxt, ["scene", "row", "col"]).withColumn("corr", F.abs(F.col("v") + F.col("w")))
    return both.select("scene", "row", "col", F.when(ok, F.col("v")).alias("dx"), F.when(ok, F.col("w")).alias("dy"), (F.col("col") * 45.0).alias("aspect"), "corr", ok.alias("valid"))


NODES = f"{views.PIXELS}, nd0 AS (SELECT a.scene, a.row, a.col, a.v AS v, b.v AS w, abs(a.v + b.v) AS corr FROM px a JOIN px b ON a.scene + 1 = b.scene AND a.row = b.row AND a.col = b.col), nd AS (SELECT scene, row, col, CASE WHEN corr >= 0.1 THEN v END AS dx, CASE WHEN corr >= 0.1 THEN w END AS dy, col * 45.0::DOUBLE AS aspect, corr, corr >= 0.1 AS valid FROM nd0)"


def velocity_summaries(spark, sf):
    nodes = _nodes(spark, sf).withColumn("region", F.floor(F.col("row") / 4).cast("int"))
    out = terrain.velocity_summary(nodes, ["scene", "region"], 0.1, 10.0, 12.0)
    return out.select("scene", "region", "n", *six("coverage", "down_median", "down_mean", "down_p90", "median", "p90", "most", "corr", "se"))


def lattice_watch(spark, sf):
    """Nodes of a coarser lattice under a full mask, and the tile's core that their site lies in."""
    mask = views.pixels(spark, sf).select("scene", "row", "col", (F.col("v") > 0).alias("watch"))
    nodes = _nodes(spark, sf).where("row % 2 = 0 and col % 2 = 0").select("scene", "row", "col", "valid")
    out = nodes.join(mask, ["scene", "row", "col"]).withColumn("core", F.col("row").between(2, 5) & F.col("col").between(2, 5))
    return out.groupBy("scene").agg(F.count_if(F.col("watch") & F.col("valid")).alias("watched"), F.count_if(F.col("watch") & F.col("core")).alias("core"), F.count("*").alias("n"))


def spread_points(spark, sf):
    """At most ten valid nodes of each pair, evenly spaced."""
    return terrain.spread_nodes(_nodes(spark, sf), ["scene"], 10).select("scene", "row", "col", F.round("dx", 3).alias("dx"))


def los_speeds(spark, sf):
    """Line-of-sight products: a region's speed against stable ground."""
    px = views.pixels(spark, sf).select("scene", "v", F.abs(F.col("v") * 4).alias("corr"), (F.col("row") < 6).alias("stable"), (F.col("row") >= 6).alias("region"))
    out = terrain.los_velocity(px, ["scene"], 12.0, 0.35, 12, 4)
    return out.select("scene", *six("v", "se", "coverage"), "n")


def ingested_products(spark, sf):
    """Products' speeds as observations of their sites: by site and product, a newer product replaces an older one."""
    px = views.pixels(spark, sf).select("scene", "label", "v", F.abs(F.col("v") * 4).alias("corr"), (F.col("row") < 6).alias("stable"), (F.col("row") >= 6).alias("region"))
    new = terrain.los_velocity(px, ["scene", "label"], 12.0, 0.35, 12, 4).select(F.col("label").cast("long").alias("site_id"), F.concat(F.lit("p"), F.col("scene") % 20).alias("scene_key"), "v", F.col("scene").alias("at"))
    obs = lambda df: tables.latest(df, ["site_id", "scene_key"], F.col("at").desc())
    half = F.col("at") % 2
    merged = tables.upsert(obs(new.where(half == 0)), obs(new.where(half == 1)), ["site_id", "scene_key"])
    return merged.select("site_id", "scene_key", "at", *six("v"))


def region_outlines(spark, sf):
    """Bright regions as polygons: their rings, the pixels inside them, and their length."""
    px = views.pixels(spark, sf).where("v > 0.08").select("scene", "row", "col")
    rings = terrain.outlines(raster.regions(px, ["scene"]), ["scene"], 4)
    return rings.groupBy("scene", "label").agg(F.sum(terrain.ring_area(F.col("ring"))).cast("long").alias("pixels"), F.sum(F.size("ring") - 1).alias("length"))


def _triangles(spark, sf):
    s = views.sites(spark, sf)
    d = (F.col("site_id") % 6) * 0.011 + 0.0005
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    lon, lat = F.col("lon") + 0.0003, F.col("lat") + 0.0003
    return s.select(F.col("site_id").alias("id"), F.array(p(lon, lat), p(lon + d, lat), p(lon, lat + d), p(lon, lat)).alias("ring"), lon.alias("lon"), lat.alias("lat"))


def site_pixels(spark, sf):
    """Masks of sites on a grid of a hundredth of a degree; the smallest are one pixel."""
    return terrain.site_masks(_triangles(spark, sf), 85.0, 29.0, 0.01).groupBy("id").agg(F.count("*").alias("n"), F.min("row").alias("row0"), F.max("col").alias("col1"))


def lowest_of_sites(spark, sf):
    """The lowest point of each site's outline, on a terrain that scenes make up, pixel by pixel."""
    masks = terrain.rasterized(_triangles(spark, sf), 85.0, 29.0, 0.01, True).withColumn("scene", (F.col("row") * 13 + F.col("col")) % 100)
    at = masks.select("id", "scene", F.col("row").alias("r"), F.col("col").alias("c"), (F.col("row") % 8).cast("int").alias("row"), (F.col("col") % 8).cast("int").alias("col"))
    z = at.join(_heights(spark, sf).withColumn("scene", F.col("scene").cast("int")), ["scene", "row", "col"])
    out = z.groupBy("id").agg(F.min(F.struct("v", "r", "c")).alias("m"))
    return out.select("id", F.round("m.v", 5).alias("z"), F.col("m.r").alias("row"), F.col("m.c").alias("col"))


def tiles_of_areas(spark, sf):
    """Tiles of each nation's grid, and that their cores hold each pixel once."""
    n = F.col("n_nationkey")
    areas = views.table(spark, sf, "nation").select(n.alias("area"), (200 + n * 37).cast("int").alias("height"), (150 + n * 53).cast("int").alias("width"))
    t = terrain.tiles_of(areas, 128, 16)
    core = (F.col("core_r1") - F.col("core_r0")) * (F.col("core_c1") - F.col("core_c0"))
    return t.groupBy("area").agg(F.count("*").alias("tiles"), F.sum(core).alias("core"), F.max(F.col("height") * F.col("width")).cast("long").alias("pixels"))


def _zone():
    return F.floor((F.col("lon") + 180) / 6) + 1


def grid_positions(spark, sf):
    """Sites on grids around them: the grid, the site's pixel and whether it holds it, its part around the site, and back to degrees."""
    s = views.sites(spark, sf).withColumn("zone", _zone())
    box = F.struct((F.col("lon") - 0.02).alias("x0"), (F.col("lat") - 0.01).alias("y0"), (F.col("lon") + 0.02).alias("x1"), (F.col("lat") + 0.01).alias("y1"))
    s = s.withColumn("g", geometry.grid_around(box, F.col("zone"), 30.0))
    x, y = geometry.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    s = s.withColumn("row", F.floor((F.col("g.y1") - y) / 30).cast("int")).withColumn("col", F.floor((x - F.col("g.x0")) / 30).cast("int"))
    s = s.withColumn("w", geometry.window(F.col("g"), F.col("row") - 4, F.col("col") - 200, F.lit(9), F.lit(260), 30.0))
    lon, lat = geometry.lonlat(x, y, F.col("zone"), F.lit(True))
    return s.select("site_id", F.round("g.x0", 1).alias("x0"), F.round("g.y1", 1).alias("y1"), F.col("g.width").alias("width"), F.col("g.height").alias("height"), "row", "col", geometry.contains_rc(F.col("g"), F.col("row"), F.col("col")).alias("inside"), F.col("w.width").alias("part_width"), F.col("w.height").alias("part_height"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def cell_polygons(spark, sf):
    """Cells of a kilometre as boxes in degrees, their tile's origin, and the extent of the area."""
    cells = views.cell_velocities(spark, sf).select((F.col("cell") % 40).alias("r"), (F.floor(F.col("cell") / 40) % 40).alias("c")).distinct()
    grid = F.struct(F.lit(300_000.0).alias("x0"), F.lit(3_100_000.0).alias("y1"), F.lit(5000).alias("width"), F.lit(4000).alias("height"))
    name = F.concat_ws("_", F.col("r").cast("string"), F.col("c").cast("string"))
    box = geometry.degrees_box(geometry.cell_box(name, grid, 1000.0), F.lit(45), F.lit(True))
    out = cells.withColumn("cell", name).withColumn("b", box).withColumn("json", geometry.to_geojson(geometry.box_ring(F.col("b")), 5))
    whole = geometry.grid_bounds(grid, 10.0)
    return out.select("cell", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.length("json").alias("n"), whole["x1"].alias("area_x1"), whole["y0"].alias("area_y0"))


def tile_offsets(spark, sf):
    """Where the grids of sites, each a tile around its point, begin in the grid of their area."""
    s = views.sites(spark, sf).withColumn("zone", F.lit(45))
    box = lambda d: F.struct((F.col("lon") - d).alias("x0"), (F.col("lat") - d).alias("y0"), (F.col("lon") + d).alias("x1"), (F.col("lat") + d).alias("y1"))
    tiles = s.withColumn("t", geometry.grid_around(box(0.01), F.col("zone"), 30.0))
    area = tiles.groupBy("aoi").agg(F.struct(F.min("t.x0").alias("x0"), F.max("t.y1").alias("y1")).alias("g"))
    row, col = geometry.tile_offset(F.col("g"), F.col("t"), 30.0)
    out = tiles.join(area, "aoi").select("aoi", "site_id", row.alias("row"), col.alias("col"), "t.height", "t.width", F.col("t.y1").alias("y1"), F.col("t.x0").alias("x0"), F.col("g.y1").alias("gy"), F.col("g.x0").alias("gx"))
    return out.groupBy("aoi").agg(F.count("*").alias("n"), F.min("row").alias("least_row"), F.min("col").alias("least_col"), F.count_if((F.col("gy") - F.col("row") * 30 == F.col("y1")) & (F.col("gx") + F.col("col") * 30 == F.col("x0"))).alias("exact"))


def thinned_paths(spark, sf):
    """Paths of the areas without points that lie near the line that is left."""
    from .relations import flow_paths_of_areas

    p = flow_paths_of_areas(spark, sf)
    lines = p.groupBy(F.col("path_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("along_km", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y"))).alias("points"))
    out = terrain.thinned_lines(lines, 1e-9)
    return out.select("id", F.size("points").alias("points"))


QUERIES = {f.__name__: f for f in (cast_shadows, terrain_shadows, hillshades, highpassed, static_layers, dry_land, clear_scenes, false_colours, surface_masks, surface_probabilities, velocity_summaries, lattice_watch, spread_points, los_speeds, ingested_products, region_outlines, site_pixels, lowest_of_sites, tiles_of_areas, grid_positions, cell_polygons, tile_offsets, thinned_paths)}


def shadow_sql(name: str, src: str, res: float, reach: int) -> str:
    """CTE: pixels with whether they are in shadow."""
    rays = ", ".join(f"({k}, {-round(k * math.cos(math.radians(SUN)))}, {round(k * math.sin(math.radians(SUN)))})" for k in range(1, reach + 1))
    rise = math.tan(math.radians(UP)) * res
    return f"{name} AS (SELECT a.scene, a.row, a.col, any_value(a.v) AS v, coalesce(bool_or(b.v - k * {rise!r}::DOUBLE > a.v), false) AS shadow FROM {src} a CROSS JOIN (VALUES {rays}) t(k, r, c) LEFT JOIN {src} b ON b.scene = a.scene AND b.row = a.row + r AND b.col = a.col + c GROUP BY 1, 2, 3)"


def slope_sql(name: str, src: str, res: float) -> str:
    return f"""{name}_n AS (SELECT *, lag(v) OVER r AS r0, lead(v) OVER r AS r1, lag(v) OVER c AS c0, lead(v) OVER c AS c1 FROM {src} WINDOW r AS (PARTITION BY scene, col ORDER BY row), c AS (PARTITION BY scene, row ORDER BY col)),
 {name}_g AS (SELECT *, CASE WHEN r0 IS NULL THEN r1 - v WHEN r1 IS NULL THEN v - r0 ELSE (r1 - r0) / 2 END / {res}::DOUBLE AS y, CASE WHEN c0 IS NULL THEN c1 - v WHEN c1 IS NULL THEN v - c0 ELSE (c1 - c0) / 2 END / {res}::DOUBLE AS x FROM {name}_n),
 {name} AS (SELECT *, degrees(atan(sqrt(x * x + y * y))) AS slope, (degrees(atan2(-x, y)) + 360) % 360 AS aspect FROM {name}_g)"""


_LIGHT = f"cos(radians({90 - UP}::DOUBLE)) * cos(radians(slope)) + sin(radians({90 - UP}::DOUBLE)) * sin(radians(slope)) * cos(radians({SUN}::DOUBLE - aspect))"


def utm_sql(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """Easting and northing of the series (northern half)."""
    n = geometry.FLATTENING / (2 - geometry.FLATTENING)
    radius = geometry.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s, lam = f"sin(radians({lat}))", f"radians({lon} - ({zone} * 6 - 183))"
    t = f"sinh(atanh({s}) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * {s}))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    x = eta + "".join(f" + {a!r}::DOUBLE * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, a in enumerate(series, 1))
    y = xi + "".join(f" + {a!r}::DOUBLE * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, a in enumerate(series, 1))
    return f"(500000 + {0.9996 * radius!r}::DOUBLE * ({x}))", f"({0.9996 * radius!r}::DOUBLE * ({y}))"


def lonlat_sql(x: str, y: str, zone: str) -> tuple[str, str]:
    n = geometry.FLATTENING / (2 - geometry.FLATTENING)
    radius = geometry.AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    back = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = f"({y} / {0.9996 * radius!r}::DOUBLE)", f"(({x} - 500000) / {0.9996 * radius!r}::DOUBLE)"
    a = f"({xi}" + "".join(f" - {c!r}::DOUBLE * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, c in enumerate(series, 1)) + ")"
    b = f"({eta}" + "".join(f" - {c!r}::DOUBLE * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, c in enumerate(series, 1)) + ")"
    chi = f"asin(sin({a}) / cosh({b}))"
    return f"(degrees(atan2(sinh({b}), cos({a}))) + {zone} * 6 - 183)", f"degrees({chi}" + "".join(f" + {c!r}::DOUBLE * sin({2 * k} * {chi})" for k, c in enumerate(back, 1)) + ")"


_TRI = f"{views.SITES}, tr AS (SELECT site_id AS id, lon + 0.0003::DOUBLE AS lon, lat + 0.0003::DOUBLE AS lat, (site_id % 6) * 0.011::DOUBLE + 0.0005::DOUBLE AS d FROM site), gr AS (SELECT r::INTEGER AS row, c::INTEGER AS col, 85 + (c + 0.5::DOUBLE) * 0.01::DOUBLE AS x, 29 - (r + 0.5::DOUBLE) * 0.01::DOUBLE AS y FROM range(0, 200) a(r), range(0, 200) b(c))"
_INSIDE = "ins AS (SELECT id, row, col FROM tr JOIN gr ON x > lon AND y > lat AND (x - lon) + (y - lat) < d)"
_SX, _SY = utm_sql("lon", "lat", "zone")
_CORNERS = [utm_sql(f"(lon {a} 0.02::DOUBLE)", f"(lat {b} 0.01::DOUBLE)", "zone") for a in "-+" for b in "-+"]
_BACK = lonlat_sql("x", "y", "zone")
_CC = [lonlat_sql(x, y, "45") for x in ("(300000 + c * 1000)", "(301000 + c * 1000)") for y in ("(3100000 - r * 1000)", "(3099000 - r * 1000)")]
_LOS = """ls AS (SELECT {keys}, median(CASE WHEN v <> 0 AND abs(v * 4) >= 0.35 AND row < 6 THEN v END) AS ref, count(CASE WHEN v <> 0 AND abs(v * 4) >= 0.35 AND row < 6 THEN 1 END) AS ns, median(CASE WHEN v <> 0 AND abs(v * 4) >= 0.35 AND row >= 6 THEN v END) AS mid, count(CASE WHEN v <> 0 AND abs(v * 4) >= 0.35 AND row >= 6 THEN 1 END) AS n, count(CASE WHEN row >= 6 THEN 1 END) AS al FROM px GROUP BY {keys}),
 lsn AS (SELECT {keys}, 1.4826::DOUBLE * median(CASE WHEN v <> 0 AND abs(v * 4) >= 0.35 AND row < 6 THEN abs(v - ref) END) AS noise FROM px JOIN ls USING ({keys}) GROUP BY {keys}), lv AS (SELECT {keys}, (mid - ref) / 12 AS v, greatest(1.2533::DOUBLE * noise / sqrt(greatest(n / 4, 1)) / 12, 1e-5) AS se, n / al AS coverage, n FROM ls JOIN lsn USING ({keys}) WHERE ns >= 12 AND n >= 4)"""
ORACLES = {
    "cast_shadows": f"WITH {HEIGHTS}, {shadow_sql('sh', 'h', 30.0, 7)} SELECT scene, row, col FROM sh WHERE shadow",
    "terrain_shadows": f"WITH {HEIGHTS}, co AS (SELECT scene, (row // 2)::INTEGER AS row, (col // 2)::INTEGER AS col, v FROM h WHERE row % 2 = 0 AND col % 2 = 0), {shadow_sql('sh', 'co', 20.0, 300)}, {slope_sql('sl', 'sh', 20.0)} SELECT scene, 4 * count(CASE WHEN shadow OR coalesce({_LIGHT} < 0.05, false) THEN 1 END) AS shadow, 4 * count(*) AS n FROM sl GROUP BY 1",
    "hillshades": f"WITH {HEIGHTS}, {slope_sql('sl', 'h', 30.0)} SELECT scene, row, col, round({_LIGHT}, 6) AS light FROM sl",
    "highpassed": f"WITH {views.PIXELS}, p AS (SELECT scene, row, col, CASE WHEN (row * 8 + col) % 11 <> 0 THEN v END AS v FROM px), f AS (SELECT *, coalesce(v, avg(v) OVER (PARTITION BY scene)) AS f FROM p), l AS (SELECT a.scene, a.row, a.col, sum(exp(-(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) / 2) * b.f) / sum(exp(-(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) / 2)) AS low FROM f a JOIN f b ON a.scene = b.scene AND abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY 1, 2, 3) SELECT scene, row, col, round(CASE WHEN v IS NULL THEN 0 ELSE v - low END, 6) AS high FROM f JOIN l USING (scene, row, col)",
    "static_layers": f"""WITH {HEIGHTS}, g AS (SELECT *, row = 0 AND col < 3 AS glacier FROM h), {slope_sql("sl", "g", 30.0)}, sm AS (SELECT a.scene, a.row, a.col, (degrees(atan2(avg(sin(radians(b.aspect))), avg(cos(radians(b.aspect))))) + 360) % 360 AS asp FROM sl a JOIN sl b ON a.scene = b.scene AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3),
 w AS (SELECT sl.scene, sl.row, sl.col, slope, asp, v >= 3280 AND (glacier OR slope >= 20) AS watch, EXISTS (SELECT 1 FROM range(0, 3) t(c) WHERE sqrt(pow(sl.row, 2) + pow(sl.col - c, 2)) * 30 <= 70 AND sl.row <= 2 AND abs(sl.col - c) <= 2) AS near FROM sl JOIN sm USING (scene, row, col)),
 s AS (SELECT *, NOT near AND NOT watch AND slope > 3 AND slope < 30 AS stable FROM w) SELECT scene, row, col, round(slope, 5) AS slope, round(asp, 3) AS aspect, watch, stable, stable AND (row // 4 + col // 4) % 2 = 0 AS sample FROM s""",
    "dry_land": f"WITH {views.PIXELS}, c AS (SELECT label, row, col, arg_max(v, scene) AS v FROM px WHERE row < 7 GROUP BY 1, 2, 3), g AS (SELECT p.label, p.scene, avg(CASE WHEN c.v IS NULL THEN 0 ELSE 1.0::DOUBLE END) AS seen, avg(CASE WHEN c.v IS NULL THEN NULL WHEN c.v - 0.02 < 0 AND 0.1::DOUBLE - c.v / 10 > 0.08 THEN 1.0::DOUBLE ELSE 0 END) AS dry FROM px p LEFT JOIN c ON p.label = c.label AND p.row = c.row AND p.col = c.col WHERE p.v > 0.15 GROUP BY 1, 2) SELECT scene, round(seen, 6) AS seen, round(dry, 6) AS dry, coalesce(seen >= 0.7 AND dry >= 0.7, false) AS was_dry FROM g",
    "clear_scenes": f"WITH {views.PIXELS}, g AS (SELECT scene, avg(CASE WHEN (row + col + scene) % 12 IN (2, 4, 5, 6, 7, 11) THEN 1.0::DOUBLE ELSE 0 END) AS clear, avg((round(v * 1000) + 2000) * 1e-4::DOUBLE) AS mean FROM px GROUP BY 1) SELECT scene, round(clear, 6) AS clear, round(mean, 8) AS mean FROM g WHERE clear >= 0.5",
    "false_colours": f"WITH {views.PIXELS}, q AS (SELECT label, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM px GROUP BY 1) SELECT label, floor(greatest(0, least(1, (v - a) / (b - a))) * 255)::INTEGER AS byte, count(*) AS n FROM px JOIN q USING (label) GROUP BY 1, 2",
    "surface_masks": f"""WITH {views.PIXELS}, b AS (SELECT scene, row, col, (v + 3) / 10 AS g, (3 - v) / 30 AS nir, (3 - v) / 25 AS swir, (row + col) % 8 AS scl, row * 4 AS slope, col = 2 AS dark FROM px), i AS (SELECT *, (g - nir) / (g + nir) AS ndwi, (g - swir) / (g + swir) AS mndwi FROM b),
 w AS (SELECT *, slope < 18 AND (ndwi > CASE WHEN dark THEN 0.45 ELSE 0.25 END AND mndwi > 0.1 AND nir < 0.2 OR nir < 0.04 AND swir < 0.05 AND g < 0.1 AND NOT dark OR scl = 6 AND nir < 0.08 AND mndwi > 0) AS water FROM i),
 k AS (SELECT scene, (nir - g) / (nir + g) AS veg, CASE WHEN scl IN (0, 1, 8, 9, 10) OR scl = 3 AND NOT water THEN 'none' WHEN water THEN 'water' WHEN mndwi > 0.4 AND nir > 0.15 THEN 'snow' WHEN row > 5 THEN 'debris' ELSE 'other' END AS kind FROM w)
 SELECT scene, count(CASE WHEN kind = 'water' THEN 1 END) AS water, count(CASE WHEN kind = 'snow' THEN 1 END) AS snow, count(CASE WHEN kind = 'debris' THEN 1 END) AS debris, count(CASE WHEN kind = 'other' THEN 1 END) AS other, round(avg(CASE WHEN kind <> 'none' THEN 1.0::DOUBLE ELSE 0 END), 6) AS valid, round(avg(veg), 6) AS ndvi FROM k GROUP BY 1""",
    "surface_probabilities": f"""WITH {views.PIXELS}, b AS (SELECT scene, row, col, (v + 3) / 10 AS g, (3 - v) / 30 AS nir, (3 - v) / 25 AS swir, row * 4 AS slope, col = 2 AS dark FROM px), i AS (SELECT *, (g - nir) / (g + nir) AS w, (g - swir) / (g + swir) AS m FROM b),
 p AS (SELECT *, 1 / (1 + exp(-(w - CASE WHEN dark THEN 0.45 ELSE 0.25 END) / 0.05)) / (1 + exp(-(m - 0.1) / 0.05)) / (1 + exp(-(0.2 - nir) / 0.03)) AS po, CASE WHEN dark THEN 0 ELSE 1 / (1 + exp(-(0.04 - nir) / 0.008)) / (1 + exp(-(0.05 - swir) / 0.01)) / (1 + exp(-(0.1 - g) / 0.02)) END AS pd FROM i)
 SELECT scene, row, col, round(greatest(po, pd) / (1 + exp(-(18 - slope) / 3)), 6) AS water, round(1 / (1 + exp(-(m - 0.4) / 0.05)) / (1 + exp(-(nir - 0.15) / 0.03)), 6) AS snow FROM p""",
    "velocity_summaries": f"""WITH {NODES}, x AS (SELECT scene, (row // 4)::INTEGER AS region, corr, sqrt(dx * dx + dy * dy) * 10 / 12 AS v, (dx * sin(radians(aspect)) + dy * cos(radians(aspect))) * 10 / 12 AS d FROM nd),
 g AS (SELECT scene, region, count(v) AS n, count(v) / count(*) AS coverage, median(d) AS down_median, avg(d) AS down_mean, quantile_cont(d, 0.9) AS down_p90, median(v) AS median, quantile_cont(v, 0.9) AS p90, max(v) AS most, avg(CASE WHEN v IS NOT NULL THEN corr END) AS corr FROM x GROUP BY 1, 2)
 SELECT scene, region, n, round(coverage, 6) AS coverage, {", ".join(f"round(CASE WHEN n >= 3 THEN {c} END, 6) AS {c}" for c in ("down_median", "down_mean", "down_p90", "median", "p90", "most", "corr"))}, round(CASE WHEN n >= 3 THEN 0.1::DOUBLE * 10 / 12 / sqrt(greatest(1, n / 16)) END, 6) AS se FROM g""",
    "lattice_watch": f"WITH {NODES} SELECT scene, count(CASE WHEN p.v > 0 AND valid THEN 1 END) AS watched, count(CASE WHEN p.v > 0 AND row BETWEEN 2 AND 5 AND col BETWEEN 2 AND 5 THEN 1 END) AS core, count(*) AS n FROM nd JOIN px p USING (scene, row, col) WHERE row % 2 = 0 AND col % 2 = 0 GROUP BY 1",
    "spread_points": f"WITH {NODES}, k AS (SELECT scene, row, col, dx, row_number() OVER (PARTITION BY scene ORDER BY row, col) - 1 AS k, count(*) OVER (PARTITION BY scene) AS n FROM nd WHERE valid) SELECT scene, row, col, round(dx, 3) AS dx FROM k WHERE n <= 10 OR k IN (SELECT i * (n - 1) // 9 FROM range(0, 10) t(i))",
    "los_speeds": f"WITH {views.PIXELS}, {_LOS.format(keys='scene')} SELECT scene, {r6('v, se, coverage')}, n FROM lv",
    "ingested_products": f"WITH {views.PIXELS}, {_LOS.format(keys='scene, label')}, o AS (SELECT label::BIGINT AS site_id, 'p' || scene % 20 AS scene_key, v, scene AS \"at\" FROM lv) SELECT site_id, scene_key, arg_max(\"at\", (\"at\" % 2, \"at\")) AS \"at\", round(arg_max(v, (\"at\" % 2, \"at\")), 6) AS v FROM o GROUP BY 1, 2",
    "region_outlines": f"WITH RECURSIVE {views.PIXELS}, m AS (SELECT scene, row, col FROM px WHERE v > 0.08), {labels_sql('m')}, n AS (SELECT scene, label, count(*) AS pixels FROM l GROUP BY 1, 2 HAVING count(*) >= 4), s AS (SELECT a.scene, a.label, count(*) AS shared FROM l a JOIN l b ON a.scene = b.scene AND a.label = b.label AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY 1, 2) SELECT scene, label, pixels, 4 * pixels - coalesce(shared, 0) AS length FROM n LEFT JOIN s USING (scene, label)",
    "site_pixels": f"WITH {_TRI}, {_INSIDE}, al AS (SELECT * FROM ins UNION ALL SELECT id, floor((29 - lat) / 0.01)::INTEGER, floor((lon - 85) / 0.01)::INTEGER FROM tr WHERE id NOT IN (SELECT id FROM ins)) SELECT id, count(*) AS n, min(row) AS row0, max(col) AS col1 FROM al GROUP BY 1",
    "lowest_of_sites": f"""WITH {_TRI.replace('site AS', 'site AS')}, {_INSIDE}, co AS (SELECT id, floor((29 - lat) / 0.01)::INTEGER AS row, floor((lon - 85) / 0.01)::INTEGER AS col FROM tr UNION SELECT id, floor((29 - lat) / 0.01)::INTEGER, floor((lon + d - 85) / 0.01)::INTEGER FROM tr UNION SELECT id, floor((29 - (lat + d)) / 0.01)::INTEGER, floor((lon - 85) / 0.01)::INTEGER FROM tr),
 al AS (SELECT * FROM ins UNION SELECT * FROM co), {HEIGHTS}, z AS (SELECT id, al.row AS r, al.col AS c, h.v FROM al JOIN h ON h.scene = (al.row * 13 + al.col) % 100 AND h.row = al.row % 8 AND h.col = al.col % 8) SELECT id, round(min(v), 5) AS z, arg_min(r, (v, r, c)) AS row, arg_min(c, (v, r, c)) AS col FROM z GROUP BY 1""",
    "tiles_of_areas": "SELECT n_nationkey AS area, ((200 + n_nationkey * 37 - 16 - 1) // 112 + 1) * ((150 + n_nationkey * 53 - 16 - 1) // 112 + 1) AS tiles, (200 + n_nationkey * 37) * (150 + n_nationkey * 53) AS core, (200 + n_nationkey * 37) * (150 + n_nationkey * 53) AS pixels FROM nation",
    "grid_positions": f"""WITH {views.SITES}, s AS (SELECT *, floor((lon + 180) / 6) + 1 AS zone FROM site), u AS (SELECT site_id, zone, lon, lat, {_SX} AS x, {_SY} AS y, least({", ".join(c[0] for c in _CORNERS)}) AS xa, greatest({", ".join(c[0] for c in _CORNERS)}) AS xb, least({", ".join(c[1] for c in _CORNERS)}) AS ya, greatest({", ".join(c[1] for c in _CORNERS)}) AS yb FROM s),
 g AS (SELECT *, floor(xa / 30) * 30 AS x0, ceil(yb / 30) * 30 AS y1, ((ceil(xb / 30) - floor(xa / 30)))::INTEGER AS width, ((ceil(yb / 30) - floor(ya / 30)))::INTEGER AS height FROM u), p AS (SELECT *, floor((y1 - y) / 30)::INTEGER AS row, floor((x - x0) / 30)::INTEGER AS col FROM g)
 SELECT site_id, round(x0, 1) AS x0, round(y1, 1) AS y1, width, height, row, col, row BETWEEN 0 AND height - 1 AND col BETWEEN 0 AND width - 1 AS inside, (least(col - 200 + 260, width) - greatest(col - 200, 0))::INTEGER AS part_width, (least(row - 4 + 9, height) - greatest(row - 4, 0))::INTEGER AS part_height, round(lon, 7) AS lon, round(lat, 7) AS lat FROM p""",
    "tile_offsets": f"WITH {views.SITES} SELECT aoi, count(*) AS n, 0 AS least_row, 0 AS least_col, count(*) AS exact FROM site GROUP BY 1",
    "cell_polygons": f"""WITH c AS (SELECT DISTINCT l_suppkey % 40 AS r, l_suppkey // 40 % 40 AS c FROM lineitem), b AS (SELECT r, c, least({", ".join(x[0] for x in _CC)}) AS x0, least({", ".join(x[1] for x in _CC)}) AS y0, greatest({", ".join(x[0] for x in _CC)}) AS x1, greatest({", ".join(x[1] for x in _CC)}) AS y1 FROM c),
 j AS (SELECT *, '{{"type":"Polygon","coordinates":[[[' || array_to_string(list_transform([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], lambda p: round(p[1], 5) || ',' || round(p[2], 5)), '],[') || ']]]}}' AS json FROM b) SELECT r || '_' || c AS cell, {r6("x0, y0, x1, y1")}, length(json)::INTEGER AS n, 350000.0::DOUBLE AS area_x1, 3060000.0::DOUBLE AS area_y0 FROM j""",
    # Of twenty points on each straight leg those at its ends are left, and none where two legs go on in one line.
    # A point stays if the path turns there, or goes back on itself; stops at one place are one point.
    "thinned_paths": f"WITH {views.SITES}, p AS (SELECT aoi, site_id, lon, lat, lag(lon) OVER w IS NULL OR lag(lon) OVER w <> lon OR lag(lat) OVER w <> lat AS moved, count(*) OVER (PARTITION BY aoi) AS n FROM site WINDOW w AS (PARTITION BY aoi ORDER BY site_id)), t AS (SELECT aoi, n, lag(lon) OVER w AS x0, lead(lon) OVER w AS x1, (lon - lag(lon) OVER w) * (lead(lat) OVER w - lat) - (lat - lag(lat) OVER w) * (lead(lon) OVER w - lon) AS turn, (lon - lag(lon) OVER w) * (lead(lon) OVER w - lon) + (lat - lag(lat) OVER w) * (lead(lat) OVER w - lat) < 0 AS back FROM p WHERE moved WINDOW w AS (PARTITION BY aoi ORDER BY site_id)) SELECT aoi AS id, (2 + count(CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL AND (abs(turn) > 1e-9 OR back) THEN 1 END))::INTEGER AS points FROM t GROUP BY 1 HAVING max(n) > 1",
}
