"""Terrain and masks: shadows, static layers of a tile, stretches, statistics of regions, outlines of masks and their reverse."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, spectral
from . import raster, tiles
from .stats import MAD_SCALE


def cast_shadow(px: DataFrame, keys: list[str], resolution: float, azimuth: float, elevation: float, reach_m: float = 6000.0) -> DataFrame:
    """``shadow``: whether terrain towards the sun (degrees) rises above its rays within ``reach_m``. A tile's halo reaches only
    towards the sun."""
    steps = tiles.ray_steps(resolution, azimuth, elevation, reach_m)
    return tiles.over_tiles(px, keys, ["v"], tiles.shaded("v", steps), {"shadow": "boolean"}, tiles.halo_of(steps))


def upsampled(coarse: DataFrame, fine: DataFrame, keys: list[str], factor: int, columns: list[str]) -> DataFrame:
    """``fine`` with columns of the coarse pixel that it lies in; past the coarse edge, of the last one."""
    last = coarse.groupBy(*keys).agg(F.max("row").alias("_lr"), F.max("col").alias("_lc"))
    at = lambda c, most: F.least(F.floor(F.col(c) / factor).cast("int"), F.col(most))
    side = coarse.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), *columns)
    return fine.join(last, keys).withColumn("_r", at("row", "_lr")).withColumn("_c", at("col", "_lc")).join(side, [*keys, "_r", "_c"], "left").drop("_r", "_c", "_lr", "_lc")


def terrain_shadow(px: DataFrame, keys: list[str], resolution: float, azimuth: float, elevation: float, every: int = 3, dark: float = 0.05) -> DataFrame:
    """Shadow at every ``every``-th pixel, cast or turned away from the sun, and spread to all."""
    coarse = px.where((F.col("row") % every == 0) & (F.col("col") % every == 0)).select(*keys, (F.col("row") / every).cast("int").alias("row"), (F.col("col") / every).cast("int").alias("col"), "v")
    lit = raster.slope_aspect(cast_shadow(coarse, keys, resolution * every, azimuth, elevation), keys, resolution * every)
    away = F.coalesce(spectral.hillshade(F.col("slope"), F.col("aspect"), azimuth, elevation) < dark, F.lit(False))
    return upsampled(lit.withColumn("shadow", F.col("shadow") | away), px, keys, every, ["shadow"])


def highpass(px: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """``high``: the value less its Gaussian surroundings; missing values count as the key's mean and become 0."""
    reach = int(3 * sigma + 0.5)
    filled = px.join(px.groupBy(*keys).agg(F.avg("v").alias("_mean")), keys).withColumn("_f", F.coalesce("v", "_mean", F.lit(0.0))).drop("_mean")
    low = tiles.over_tiles(filled, keys, ["_f"], tiles.gaussian("_f", sigma, reach), {"low": "double"}, reach)
    return low.withColumn("high", F.when(F.col("v").isNull(), 0.0).otherwise(F.col("v") - F.col("low"))).drop("_f", "low")


def tile_static(px: DataFrame, keys: list[str], resolution: float, min_z: float = 3300.0, far_m: float = 300.0, check: int = 48) -> DataFrame:
    """Static layers (z as v, glacier at each pixel): slope, aspect smoothed over neighbours, watch (high, and ice or steep),
    stable ground (far from ice, not watched, of middling slope) and its checkerboard sample. One kernel makes all that looks
    beyond a pixel."""
    reach = int(far_m / resolution)
    kernel = tiles.static_layers("v", "_ice", resolution, reach, far_m)
    rows = px.withColumn("_ice", F.col("glacier").cast("double"))
    out = tiles.over_tiles(rows, keys, ["v", "_ice"], kernel, {"slope": "double", "aspect": "double", "near_ice": "boolean"}, max(reach, 2))
    watch = (F.col("v") >= min_z) & (F.col("glacier") | (F.col("slope") >= 20))
    stable = ~F.col("near_ice") & ~watch & (F.col("slope") > 3) & (F.col("slope") < 30)
    sampled = (F.floor(F.col("row") / check) + F.floor(F.col("col") / check)) % 2 == 0
    return out.withColumn("watch", watch).withColumn("stable", stable).withColumn("sample", stable & sampled).drop("near_ice", "_ice")


def was_dry(lakes: DataFrame, composite: DataFrame, keys: list[str], min_seen: float = 0.7, min_dry: float = 0.7) -> DataFrame:
    """Whether the pixels of each lake (keys, label, row, col) were dry ground when last seen (ndwi, nir in ``composite``);
    not if too few of them ever were seen."""
    both = lakes.join(composite, [*keys, "row", "col"], "left")
    dry = F.when(F.col("nir").isNotNull(), ((F.col("ndwi") < 0) & (F.col("nir") > 0.08)).cast("double"))
    g = both.groupBy(*keys, "label").agg(F.avg(F.col("nir").isNotNull().cast("double")).alias("seen"), F.avg(dry).alias("dry"))
    return g.withColumn("was_dry", F.coalesce((F.col("seen") >= min_seen) & (F.col("dry") >= min_dry), F.lit(False)))


def clear_share(px: DataFrame, keys: list[str], least: float = 0.05) -> DataFrame:
    """Share of clear pixels (class ``scl``) of the scenes that have enough."""
    return px.groupBy(*keys).agg(F.avg(F.col("scl").isin(*spectral.CLEAR).cast("double")).alias("clear"), F.count("*").alias("n")).where(F.col("clear") >= least)


def reflectance(dn: Column, offset: Column, scale: float = 1e-4) -> Column:
    return (dn + offset) * scale


def stretched(px: DataFrame, keys: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``byte``: values stretched between two quantiles of the key to 0 to 255."""
    q = px.groupBy(*keys).agg(F.percentile("v", F.lit(low)).alias("_a"), F.percentile("v", F.lit(high)).alias("_b"))
    part = F.try_divide(F.col("v") - F.col("_a"), F.col("_b") - F.col("_a"))
    return px.join(q, keys).withColumn("byte", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0)))) * 255).cast("int")).drop("_a", "_b")


def speed(dx: Column, dy: Column, resolution: float, days: Column | float) -> Column:
    return F.hypot(dx, dy) * resolution / days


def velocity_summary(nodes: DataFrame, keys: list[str], noise_px: float, resolution: float, days: float) -> DataFrame:
    """Summary of a region's nodes (dx, dy, aspect, corr; null where not valid): how many, the share that is valid, speed and
    its downslope part, and the error of the median; with fewer than three nodes only the first two."""
    v, down = speed(F.col("dx"), F.col("dy"), resolution, days), spectral.downslope(F.col("dx"), F.col("dy"), F.col("aspect"), resolution, F.lit(days))
    g = nodes.withColumn("_v", v).withColumn("_d", down).groupBy(*keys).agg(
        F.count("_v").alias("n"), (F.count("_v") / F.count("*")).alias("coverage"), F.median("_d").alias("down_median"), F.avg("_d").alias("down_mean"), F.percentile("_d", F.lit(0.9)).alias("down_p90"),
        F.median("_v").alias("median"), F.percentile("_v", F.lit(0.9)).alias("p90"), F.max("_v").alias("most"), F.avg(F.when(F.col("_v").isNotNull(), F.col("corr"))).alias("corr"),
    )
    enough = F.col("n") >= 3
    noise = noise_px * resolution / days
    told = [F.when(enough, F.col(c)).alias(c) for c in ("down_median", "down_mean", "down_p90", "median", "p90", "most", "corr")]
    return g.select(*keys, "n", "coverage", *told, F.when(enough, noise / F.sqrt(F.greatest(F.lit(1.0), F.col("n") / 16))).alias("se"))


def los_velocity(px: DataFrame, keys: list[str], days: Column | float, min_corr: float = 0.35, min_stable: int = 30, min_region: int = 10) -> DataFrame:
    """Line-of-sight speed of a region (v, corr, stable, region at each pixel; a value of 0 is missing) against stable ground:
    its speed, error and coverage, where both have enough coherent pixels."""
    fine = F.col("v").isNotNull() & (F.col("v") != 0) & (F.col("corr") >= min_corr)
    rows = px.withColumn("_s", F.when(fine & F.col("stable"), F.col("v"))).withColumn("_r", F.when(fine & F.col("region"), F.col("v")))
    mid = rows.groupBy(*keys).agg(F.median("_s").alias("_ref"), F.count("_s").alias("_ns"), F.count("_r").alias("n"), F.count_if("region").alias("_all"), F.median("_r").alias("_mid"))
    spread = rows.join(mid.select(*keys, "_ref"), keys).groupBy(*keys).agg((MAD_SCALE * F.median(F.abs(F.col("_s") - F.col("_ref")))).alias("_noise"))
    out = mid.join(spread, keys).where((F.col("_ns") >= min_stable) & (F.col("n") >= min_region))
    error = F.greatest(1.2533 * F.col("_noise") / F.sqrt(F.greatest(F.col("n") / 4, F.lit(1.0))) / days, F.lit(1e-5))
    return out.select(*keys, ((F.col("_mid") - F.col("_ref")) / days).alias("v"), error.alias("se"), "n", (F.col("n") / F.col("_all")).alias("coverage"))


def spread_nodes(nodes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Valid nodes in order of row and col, or, where a key has more than ``most``, that many evenly spaced ones with the
    first and the last."""
    by = Window.partitionBy(*keys)
    rows = nodes.where("valid").withColumn("_k", F.row_number().over(by.orderBy("row", "col")) - 1).withColumn("_n", F.count("*").over(by))
    slot = F.floor(F.col("_k") * (most - 1) / (F.col("_n") - 1))
    start = lambda j: F.floor(j * (F.col("_n") - 1) / (most - 1))
    chosen = (F.col("_n") <= most) | (F.col("_k") == start(slot)) | (F.col("_k") == start(slot + 1))
    return rows.where(chosen).drop("_k", "_n")


def mask_edges(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Sides of pixels that a region (keys, label) doesn't share with itself: from (r0, c0) to (r1, c1), the region on the
    right hand."""
    sides = [(0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0)]
    each = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("a", "b", "c", "d"), s)]) for s in sides]))
    at = labelled.select(*keys, "label", "row", "col", each.alias("s"))
    edges = at.select(*keys, "label", *[(F.col(p) + F.col(f"s.{q}")).alias(n) for n, p, q in (("r0", "row", "a"), ("c0", "col", "b"), ("r1", "row", "c"), ("c1", "col", "d"))])
    a, b = (F.struct(F.col(f"r{k}").alias("r"), F.col(f"c{k}").alias("c")) for k in (0, 1))
    lo, hi = F.least(a, b), F.greatest(a, b)
    own = edges.groupBy(*keys, "label", lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("k"), F.first(F.struct("r0", "c0", "r1", "c1")).alias("e")).where("k = 1")
    return own.select(*keys, "label", "e.*")


def outlines(labelled: DataFrame, keys: list[str], min_pixels: int = 1) -> DataFrame:
    """Rings of each region of at least ``min_pixels``: (keys, label, ring: array of (row, col) corners, closed). Only outer
    sides reach the walk that chains them, a region's in one group."""
    big = labelled.groupBy(*keys, "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pixels).drop("_n")
    edges = mask_edges(labelled.join(big, [*keys, "label"], "left_semi"), keys)
    kinds = dict(labelled.dtypes)

    def chained(table: pa.Table) -> pa.Table:
        after: dict[tuple, list[tuple]] = {}
        for r0, c0, r1, c1 in zip(*(table[c].to_pylist() for c in ("r0", "c0", "r1", "c1"))):
            after.setdefault((r0, c0), []).append((r1, c1))
        for ends in after.values():
            ends.sort()
        rings = []
        for start in sorted(after):
            while after[start]:
                ring, at, way = [start], after[start].pop(0), None
                way = (at[0] - start[0], at[1] - start[1])
                while at != start:
                    ring.append(at)
                    # Where two sides leave a corner, turn right, so that corners that only touch part into rings.
                    turn = (at[0] + way[1], at[1] - way[0])
                    to = turn if turn in after[at] else after[at][0]
                    after[at].remove(to)
                    way, at = (to[0] - at[0], to[1] - at[1]), to
                rings.append([*ring, start])
        one = table.slice(0, 1)
        columns = [pa.array([one[c][0].as_py()] * len(rings), table.schema.field(c).type) for c in (*keys, "label")]
        ring_type = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32())]))
        return pa.table([*columns, pa.array([[{"row": r, "col": c} for r, c in x] for x in rings], ring_type)], names=[*keys, "label", "ring"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "label")) + ", ring array<struct<row:int,col:int>>"
    return edges.groupBy(*keys, "label").applyInArrow(chained, schema)


def ring_area(ring: Column) -> Column:
    """Pixels inside a ring of corners; negative for holes."""
    cross = F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda p, i: p["col"] * F.get(ring, i + 1)["row"] - F.get(ring, i + 1)["col"] * p["row"])
    return F.aggregate(cross, F.lit(0).cast("long"), lambda a, x: a + x) / 2


def rasterized(shapes: DataFrame, x0: float, y1: float, resolution: float, touched: bool = False) -> DataFrame:
    """Pixels (id, row, col) whose centre lies in a closed ring (id, ring of lon, lat in the grid's units); with ``touched``
    also those that hold one of its corners. Only the pixels of a ring's box are tried."""
    box = geometry.bounds(F.col("ring"))
    r0, r1 = F.floor((y1 - box["y1"]) / resolution).cast("int"), F.floor((y1 - box["y0"]) / resolution).cast("int")
    c0, c1 = F.floor((box["x0"] - x0) / resolution).cast("int"), F.floor((box["x1"] - x0) / resolution).cast("int")
    tried = shapes.select("id", "ring", F.explode(F.sequence(r0, r1)).alias("row"), c0.alias("_c0"), c1.alias("_c1")).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    x, y = geometry.pixel_centre(F.col("row"), F.col("col"), x0, y1, resolution)
    inside = tried.where(geometry.contains(F.col("ring"), x, y)).select("id", "row", "col")
    if not touched:
        return inside
    corner = shapes.select("id", F.explode("ring").alias("p")).select("id", *[c.alias(n) for n, c in zip(("row", "col"), geometry.pixel_of(F.col("p.lon"), F.col("p.lat"), x0, y1, resolution))])
    return inside.union(corner).distinct()


def site_masks(shapes: DataFrame, x0: float, y1: float, resolution: float) -> DataFrame:
    """Pixels of sites (id, ring, lon, lat): those inside the outline, or, for one too small to hold a centre, the pixel at
    the site's point."""
    inside = rasterized(shapes, x0, y1, resolution)
    tiny = shapes.join(inside.select("id").distinct(), "id", "left_anti")
    row, col = geometry.pixel_of(F.col("lon"), F.col("lat"), x0, y1, resolution)
    return inside.union(tiny.select("id", row.alias("row"), col.alias("col")))


def lowest_points(masks: DataFrame, px: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest pixel of each mask (id, row, col, keys): ties to the smaller place."""
    return masks.join(px, [*keys, "row", "col"]).groupBy("id").agg(F.min(F.struct("v", "row", "col")).alias("m")).select("id", "m.row", "m.col", F.col("m.v").alias("z"))


def tiles_of(areas: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping tiles of areas (area, height, width): place, size, and the core (first and last row and column, the last
    exclusive) that is theirs alone, so each pixel is in one core."""
    step, half = size - overlap, overlap // 2
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n) - overlap - 1, F.lit(0)), F.lit(step)))
    out = areas.withColumn("row", starts("height")).withColumn("col", starts("width"))
    for at, whole, n, first, last in (("row", "height", "rows", "core_r0", "core_r1"), ("col", "width", "cols", "core_c0", "core_c1")):
        a, w = F.col(at), F.col(whole)
        ends = (a + size >= w) | (a + step > F.greatest(w - overlap - 1, F.lit(0)))
        out = out.withColumn(n, F.least(F.lit(size), w - a)).withColumn(first, F.when(a > 0, a + half).otherwise(0)).withColumn(last, F.when(ends, w).otherwise(a + step + half))
    return out


def thinned_lines(lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines (id, points: array of x, y) without the points that lie within ``tolerance`` of the line that is left, by halving
    at the farthest point, on Arrow batches."""

    def kept(points: list[dict]) -> list[dict]:
        keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
        while todo:
            a, b = todo.pop()
            (x0, y0), (x1, y1) = ((points[k]["x"], points[k]["y"]) for k in (a, b))
            length = math.hypot(x1 - x0, y1 - y0)
            far, at = tolerance, None
            for k in range(a + 1, b):
                x, y = points[k]["x"], points[k]["y"]
                t = 0.0 if length == 0 else max(0.0, min(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / length**2))
                d = math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0))
                if d > far + (0.0 if at is None else tolerance / 1000):  # of equally far points the first, a corner
                    far, at = d, k
            if at is not None:
                keep.add(at)
                todo += [(a, at), (at, b)]
        return [points[k] for k in sorted(keep)] if points else []

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else kept(x) for x in batch.column(1).to_pylist()], batch.column(1).type)], ["id", "points"])

    return lines.select("id", "points").mapInArrow(run, f"id {dict(lines.dtypes)['id']}, points {dict(lines.dtypes)['points']}")
