"""Detections from pixel rows: change regions, lakes, water by radar, vegetation loss, fast cells and their clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import raster
from .joins import prefixed


def eroded(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels whose four neighbours are all there: erosion by a cross."""
    cross = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
    near = px.select(*keys, "row", "col", cross.alias("m")).select(*keys, (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"))
    return near.groupBy(*keys, "row", "col").agg(F.count("*").alias("k")).where("k = 5").drop("k")


def dilated(px: DataFrame, keys: list[str]) -> DataFrame:
    cross = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
    return px.select(*keys, "row", "col", cross.alias("m")).select(*keys, (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col")).distinct()


def opened(px: DataFrame, keys: list[str]) -> DataFrame:
    """Erosion, then dilation: specks go."""
    return dilated(eroded(px, keys), keys)


def closed(mask: DataFrame, px: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """Dilations within the pixels that exist, then as many erosions: gaps close."""
    for _ in range(times):
        mask = dilated(mask, keys).join(px.select(*keys, "row", "col"), [*keys, "row", "col"])
    for _ in range(times):
        mask = eroded(mask, keys)
    return mask


def paired(px: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with a neighbour in their row or column: the union of openings by two pixels, either way."""
    beside = raster.shifted(px.withColumn("v", F.lit(1)), keys, 1).where("abs(dr) + abs(dc) = 1").select(*keys, "row", "col").distinct()
    return px.join(beside, [*keys, "row", "col"], "left_semi")


def change_confidence(relief: Column, slope: Column, area: Column, disturbed: Column) -> Column:
    raw = 0.2 + 0.35 * F.least(relief / 500, F.lit(1.0)) + 0.25 * F.least(slope / 30, F.lit(1.0)) + 0.2 * F.least(area / 5e5, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * F.when(disturbed, 0.5).otherwise(1.0)


def change_regions(px: DataFrame, keys: list[str], threshold: float, pixel_m2: float, min_area: float, disturbed_share: float = 0.04, band_m: float = 200.0, band_share: float = 0.35, band_pixels: int = 500) -> DataFrame:
    """Regions of strong change (v in dB) with z, slope, ice and exclude at each pixel: area, relief, mean change, share that
    brightens, share on ice, whether the scene is disturbed (strong pixels outside the three largest regions), whether it
    looks like snow, and confidence. Height bands that change together are no events; specks are opened away and gaps
    closed; flat regions on ice are melt."""
    seasonal = raster.seasonal_bands(px.where(F.col("v").isNotNull()), keys, "z", band_m, threshold, band_share, band_pixels)
    strong = seasonal.where((F.abs("v") > threshold) & ~F.col("seasonal") & ~F.col("exclude")).select(*keys, "row", "col")
    strong = closed(opened(strong, keys).join(px.select(*keys, "row", "col"), [*keys, "row", "col"]), px, keys, 2)
    labelled = raster.regions(strong, keys).join(px, [*keys, "row", "col"])
    g = labelled.groupBy(*keys, "label").agg(
        F.count("*").alias("pixels"), (F.percentile("z", F.lit(0.95)) - F.percentile("z", F.lit(0.05))).alias("relief"), F.avg("v").alias("mean"), F.avg((F.col("v") > 0).cast("double")).alias("brighter"), F.avg("slope").alias("slope"),
        F.avg(F.col("ice").cast("double")).alias("on_ice"),
    )
    largest = g.groupBy(*keys).agg(F.sum("pixels").alias("_strong"), F.slice(F.sort_array(F.collect_list("pixels"), False), 1, 3).alias("_top"))
    total = px.where(F.col("v").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_all"))
    out = g.join(largest, keys).join(total, keys).withColumn("disturbed", (F.col("_strong") - F.aggregate("_top", F.lit(0).cast("long"), lambda a, x: a + x)) / F.col("_all") > disturbed_share)
    out = out.withColumn("area", F.col("pixels") * pixel_m2).withColumn("snow_like", (F.col("brighter") <= 0.1) & (F.col("mean") <= -3) & (F.col("relief") < 800))
    kept = (F.col("area") >= min_area) & ~((F.col("on_ice") > 0.8) & (F.col("relief") < 400))
    return out.withColumn("confidence", change_confidence(F.col("relief"), F.col("slope"), F.col("area"), F.col("disturbed"))).where(kept).drop("_strong", "_top", "_all")


#: Land-cover codes of crops and trees (fixed values).
CROPS, TREES = 40, 10


def vegetation_loss(px: DataFrame, keys: list[str], pixel_m2: float, min_area: float, least=0.45, drop=0.25) -> DataFrame:
    """Regions whose index (before, after) fell and which became brighter (bright0, bright1), where both scenes are valid;
    elongated ones on steep ground are mass movements, unless crops (cover) prevail."""
    lost = px.where(F.col("valid") & (F.col("before") > least) & (F.col("before") - F.col("after") > drop) & (F.col("bright1") > F.col("bright0")))
    mask = opened(lost.select(*keys, "row", "col"), keys).join(px.select(*keys, "row", "col"), [*keys, "row", "col"])
    labelled = raster.regions(mask, keys)
    facts = labelled.join(px, [*keys, "row", "col"]).groupBy(*keys, "label").agg(F.avg(F.col("before") - F.col("after")).alias("drop"), F.avg("slope").alias("slope"), F.mode("cover", True).alias("cover"))
    shaped = raster.region_shapes(labelled, keys).join(facts, [*keys, "label"]).withColumn("area", F.col("pixels") * pixel_m2)
    moved = (F.col("slope") > 25) & (eccentricity() > 0.9)
    kind = F.when(F.col("cover") == CROPS, "cropland_change").when(moved, "mass_movement").otherwise("vegetation_loss")
    return shaped.withColumn("kind", kind).withColumn("confidence", F.greatest(F.lit(0.2), F.least(F.lit(0.9), 0.4 + F.col("drop") - drop))).where(F.col("area") >= min_area)


def eccentricity() -> Column:
    return F.sqrt(1 - F.pow(F.try_divide(F.col("minor"), F.col("major")), 2))


def new_fractures(px: DataFrame, keys: list[str], resolution: float, min_pixels: int = 200, share: float = 0.97, floor: float = 0.02) -> DataFrame:
    """Dark lines that are new in a region (ridge index before and after, region, valid at each pixel): their length, the
    change of the index, and the share of the region that both scenes show. A line is a long thin group of pixels."""
    seen = px.where("region and valid")
    facts = seen.groupBy(*keys).agg(F.count("*").alias("n"), F.greatest(F.percentile("after", F.lit(share)), F.lit(floor)).alias("cut"), (F.avg("after") - F.avg("before")).alias("energy")).where(F.col("n") >= min_pixels)
    new = seen.join(facts, keys).where((F.col("after") > F.col("cut")) & (F.col("before") < 0.5 * F.col("cut"))).select(*keys, "row", "col")
    shaped = raster.region_shapes(raster.regions(paired(new, keys), keys), keys)
    long = shaped.where((F.col("major") >= max(3.0, float(int(60 / resolution)))) & (eccentricity() > 0.9)).groupBy(*keys).agg((F.sum("major") * resolution).alias("length"))
    whole = px.where("region").groupBy(*keys).agg(F.count("*").alias("_region"))
    return facts.join(whole, keys).join(long, keys, "left").select(*keys, F.coalesce("length", F.lit(0.0)).alias("length"), "energy", (F.col("n") / F.greatest("_region", F.lit(1))).alias("observed"))


def lakes(px: DataFrame, keys: list[str], pixel_m2: float, min_area: float, max_elongation: float = 7.0, ring: int = 1, wall: int = 1, max_ice: float | None = None) -> DataFrame:
    """Water regions (water, valid, z, slope, and core, ice_m at each pixel): area, centre, elevation and its range,
    elongation, quality, which falls with invalid pixels in the region and in a ring of ``ring`` pixels, the steepest slope
    within ``wall`` pixels, and the distance to ice. Regions whose centre is outside the core belong to another tile; those
    farther than ``max_ice`` are left out. Pixels outgrow what the planner expects of exploded scenes, so no side is collected
    for a broadcast: all joins are merges of shuffled sides."""
    labelled = raster.regions(px.where("water").select(*keys, "row", "col"), keys)
    shaped = raster.region_shapes(labelled, keys).withColumn("area", F.col("pixels") * pixel_m2).withColumn("elongation", F.col("major") / F.greatest("minor", F.lit(1.0)))
    height = labelled.join(px.hint("merge"), [*keys, "row", "col"]).groupBy(*keys, "label").agg(F.median("z").alias("z"), (F.percentile("z", F.lit(0.9)) - F.percentile("z", F.lit(0.1))).alias("z_range"), F.min("ice_m").alias("ice_m"))

    def around(reach: int) -> DataFrame:
        near = raster.shifted(labelled, [*keys, "label"], reach, "label").select(*keys, "label", "row", "col").distinct()
        return near.join(px.select(*keys, "row", "col", "slope").hint("merge"), [*keys, "row", "col"]).groupBy(*keys, "label")

    grown = labelled.select(*keys, "label", "row", "col")
    for _ in range(ring):
        grown = dilated(grown, [*keys, "label"])
    seen = grown.join(px.select(*keys, "row", "col", "valid").hint("merge"), [*keys, "row", "col"]).groupBy(*keys, "label").agg((1 - F.avg((~F.col("valid")).cast("double"))).alias("quality"))
    steep = around(wall).agg(F.max("slope").alias("wall_slope"))
    centre = px.where("core").select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"))
    out = shaped.join(height.hint("merge"), [*keys, "label"]).join(seen.hint("merge"), [*keys, "label"]).join(steep.hint("merge"), [*keys, "label"])
    out = out.withColumn("_r", F.floor(F.col("row") + 0.5).cast("int")).withColumn("_c", F.floor(F.col("col") + 0.5).cast("int")).join(centre.hint("merge"), [*keys, "_r", "_c"], "left_semi").drop("_r", "_c")
    fine = (F.col("area") >= min_area) & ((F.col("elongation") <= max_elongation) | (F.col("area") >= 50 * min_area))
    return out.where(fine if max_ice is None else fine & (F.col("ice_m") <= max_ice))


def radar_water(px: DataFrame, keys: list[str], pixel_m2: float, lo=-24.0, hi=-14.0, bins=40, min_pixels=50, min_seen=0.7, max_slope=15.0, reach: int = 2) -> DataFrame:
    """Water area around a lake (v in dB, lake, slope) in a zone of ``reach`` pixels of which enough is seen: below a
    threshold found by Otsu's method within bounds, flat, opened, and connected to the known lake. Quality rises with
    contrast, the share seen and the overlap."""
    zone = px.where("lake").select(*keys, "row", "col")
    for _ in range(reach):
        zone = dilated(zone, keys)
    zone = px.join(zone, [*keys, "row", "col"], "left_semi")
    facts = zone.groupBy(*keys).agg(F.count("v").alias("_n"), F.avg(F.col("v").isNotNull().cast("double")).alias("seen"), F.count_if("lake").alias("_lake")).where((F.col("_n") >= min_pixels) & (F.col("seen") >= min_seen))
    zone = zone.where(F.col("v").isNotNull()).join(facts, keys)
    cut = raster.otsu(zone, keys, bins, lo, hi).select(*keys, "threshold")
    wet = zone.join(cut, keys).withColumn("wet", (F.col("v") < F.col("threshold")) & (F.col("slope") < max_slope))
    mask = opened(wet.where("wet").select(*keys, "row", "col"), keys).join(px.select(*keys, "row", "col"), [*keys, "row", "col"])
    labelled = raster.regions(mask, keys).join(wet, [*keys, "row", "col"])
    touching = labelled.groupBy(*keys, "label").agg(F.bool_or("lake").alias("_t"), F.count("*").alias("_p"), F.count_if("lake").alias("_l")).where("_t").groupBy(*keys).agg(F.sum("_p").alias("pixels"), F.sum("_l").alias("shared"))
    levels = wet.groupBy(*keys).agg(F.avg(F.when(F.col("wet"), F.col("v"))).alias("_w"), F.avg(F.when(~F.col("wet"), F.col("v"))).alias("_d"), F.max("_lake").alias("_lake"), F.max("seen").alias("seen"))
    out = levels.join(touching, keys, "left")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    quality = clip((F.col("_d") - F.col("_w")) / 8) * F.col("seen") * clip(F.try_divide(F.col("shared"), F.col("_lake")) / 0.7)
    return out.select(*keys, (F.coalesce("pixels", F.lit(0)) * pixel_m2).alias("area"), F.when(F.col("pixels").isNull(), 0.3).otherwise(F.coalesce(quality, F.lit(0.0))).alias("quality"))


def node_baseline(history: DataFrame, keys: list[str], min_fields: int = 2) -> DataFrame:
    """Median of a node's earlier speeds, each field smoothed by the median of its neighbourhood (column ``field`` tells
    them apart), of at least ``min_fields``."""
    smooth = raster.median_filter(history.select(*keys, "field", "row", "col", "v"), [*keys, "field"]).withColumnRenamed("median", "_s")
    return smooth.groupBy(*keys, "row", "col").agg(F.median("_s").alias("base"), F.count("_s").alias("_n")).where(F.col("_n") >= min_fields).drop("_n")


def hotspots(now: DataFrame, baseline: DataFrame, keys: list[str], least: float | Column, factor: float = 3.0, min_nodes: int = 6, min_corr: float = 0.2) -> DataFrame:
    """Regions of watched nodes (v, corr, watch) that are fast, by a floor that grows with the noise of the field, and fast
    against their own baseline; their mean correlation must be enough. With the event's confidence."""
    hot = now.join(baseline, [*keys, "row", "col"]).where(F.col("watch") & (F.col("v") >= least) & (F.col("v") >= factor * F.greatest(F.col("base"), F.lit(0.05))))
    labelled = raster.regions(hot.select(*keys, "row", "col"), keys).join(hot, [*keys, "row", "col"])
    g = labelled.groupBy(*keys, "label").agg(F.count("*").alias("nodes"), F.median("v").alias("speed"), F.max("v").alias("top"), F.median(F.col("v") / F.greatest("base", F.lit(0.05))).alias("ratio"), F.avg("corr").alias("corr"))
    return g.where((F.col("nodes") >= min_nodes) & (F.round("corr", 9) >= min_corr)).withColumn("confidence", F.least(F.lit(1.0), 2 * F.col("corr")))


def pointwise_ratio(now: DataFrame, baseline: DataFrame, keys: list[str], min_nodes: int = 4) -> DataFrame:
    """Median speed over the median baseline of the same nodes, 1 where it hardly moves, of keys with enough nodes."""
    g = now.join(baseline, [*keys, "row", "col"]).groupBy(*keys).agg(F.median("v").alias("v"), F.median("base").alias("base"), F.count("*").alias("n")).where(F.col("n") >= min_nodes)
    return g.withColumn("ratio", F.when(F.col("v") > 0.05, F.col("v") / F.greatest("base", F.lit(0.05))).otherwise(1.0))


def cell_clusters(cells: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of significant cells (row, col, z) that no site covers: the cells, the strongest, and the box."""
    free = cells.join(covered.select(*keys, "row", "col"), [*keys, "row", "col"], "left_anti")
    labelled = raster.regions(free.select(*keys, "row", "col"), keys).join(free, [*keys, "row", "col"])
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("cells"), F.max("z").alias("z"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def reference_pairs(history: DataFrame, keys: list[str]) -> DataFrame:
    """Each scene's pixels beside those of the scene before (by key): v and its predecessor, the as-of gap in days."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys, "row", "col").orderBy("day")
    return history.withColumn("before", F.lag("v").over(by)).withColumn("gap", F.col("day") - F.lag("day").over(by)).where(F.col("before").isNotNull())


def confusion_of_lakes(found: DataFrame, known: DataFrame, max_km: float) -> DataFrame:
    """The found lake nearest each known one and the error of its area in percent."""
    from .joins import nearest

    near = nearest(known.select("id", "lon", "lat"), found.select(F.col("id").alias("fid"), "lon", "lat"), max_km, "id", "fid")
    a, b = prefixed(known, "k_"), prefixed(found, "f_")
    return near.join(a, F.col("id") == F.col("k_id")).join(b, F.col("nearest") == F.col("f_id")).select("id", "nearest", (100 * (F.col("f_area") - F.col("k_area")) / F.col("k_area")).alias("error_pct"))
