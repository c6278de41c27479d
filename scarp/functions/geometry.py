"""Grids, projections and polygons as Column expressions; rings are arrays of (lon, lat) structs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Axis and flattening of the ellipsoid, scale and false easting of the projection (fixed values).
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
SOUTH = 10_000_000.0


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by the series in the third flattening, exact to millimetres within a zone."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(series, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EASTING + SCALE * radius * x, SCALE * radius * y + F.when(lat < 0, SOUTH).otherwise(0.0)


def lonlat(x: Column, y: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of easting and northing, by the inverse series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    back = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (y - F.when(north, 0.0).otherwise(SOUTH)) / (SCALE * radius), (x - EASTING) / (SCALE * radius)
    a, b = xi, eta
    for k, c in enumerate(series, 1):
        a = a - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        b = b - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for k, c in enumerate(back, 1):
        lat = lat + c * F.sin(2 * k * chi)
    return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + zone * 6 - 183, F.degrees(lat)


def grid_around(box: Column, zone: Column, resolution: float) -> Column:
    """Grid (x0, y1, width, height) that covers a box of degrees (x0, y0, x1, y1): its corners' box, snapped outward."""
    corners = [utm(box[a], box[b], zone) for a in ("x0", "x1") for b in ("y0", "y1")]
    xs, ys = F.array(*[c[0] for c in corners]), F.array(*[c[1] for c in corners])
    x0, x1 = snapped(F.array_min(xs), resolution, False), snapped(F.array_max(xs), resolution, True)
    y0, y1 = snapped(F.array_min(ys), resolution, False), snapped(F.array_max(ys), resolution, True)
    return F.struct(x0.alias("x0"), y1.alias("y1"), ((x1 - x0) / resolution).cast("int").alias("width"), ((y1 - y0) / resolution).cast("int").alias("height"))


def grid_bounds(grid: Column, resolution: float) -> Column:
    """Extent of a grid in metres."""
    return F.struct(grid["x0"].alias("x0"), (grid["y1"] - grid["height"] * resolution).alias("y0"), (grid["x0"] + grid["width"] * resolution).alias("x1"), grid["y1"].alias("y1"))


def degrees_box(bounds_m: Column, zone: Column, north: Column) -> Column:
    """Box in degrees of an extent in metres."""
    corners = [lonlat(bounds_m[a], bounds_m[b], zone, north) for a in ("x0", "x1") for b in ("y0", "y1")]
    lon, lat = F.array(*[c[0] for c in corners]), F.array(*[c[1] for c in corners])
    return F.struct(F.array_min(lon).alias("x0"), F.array_min(lat).alias("y0"), F.array_max(lon).alias("x1"), F.array_max(lat).alias("y1"))


def window(grid: Column, row: Column, col: Column, height: Column, width: Column, resolution: float) -> Column:
    """Part of a grid, clipped to it."""
    r, c = F.greatest(row, F.lit(0)), F.greatest(col, F.lit(0))
    h, w = F.least(row + height, grid["height"]) - r, F.least(col + width, grid["width"]) - c
    return F.struct((grid["x0"] + c * resolution).alias("x0"), (grid["y1"] - r * resolution).alias("y1"), F.greatest(w, F.lit(0)).alias("width"), F.greatest(h, F.lit(0)).alias("height"))


def cell_box(cell: Column, grid: Column, cell_m: float) -> Column:
    """Extent in metres of a cell named row_col."""
    row, col = (F.split_part(cell, F.lit("_"), F.lit(k)).cast("int") for k in (1, 2))
    x, y = grid["x0"] + col * cell_m, grid["y1"] - row * cell_m
    return F.struct(x.alias("x0"), (y - cell_m).alias("y0"), (x + cell_m).alias("x1"), y.alias("y1"))


def tile_offset(area: Column, tile: Column, resolution: float) -> tuple[Column, Column]:
    """Rows and columns from the corner of an area's grid to that of a tile of it."""
    return F.round((area["y1"] - tile["y1"]) / resolution).cast("int"), F.round((tile["x0"] - area["x0"]) / resolution).cast("int")


def contains_rc(grid: Column, row: Column, col: Column) -> Column:
    return row.between(F.lit(0), grid["height"] - 1) & col.between(F.lit(0), grid["width"] - 1)


def box_ring(box: Column) -> Column:
    """A box as a closed ring."""
    p = lambda a, b: F.struct(box[a].alias("lon"), box[b].alias("lat"))
    return F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))


def snapped(x: Column, resolution: float, up: bool) -> Column:
    """An edge moved outward to a multiple of the resolution."""
    return (F.ceil(x / resolution) if up else F.floor(x / resolution)) * resolution


def pixel_centre(row: Column, col: Column, x0: float, y1: float, resolution: float) -> tuple[Column, Column]:
    return x0 + (col + 0.5) * resolution, y1 - (row + 0.5) * resolution


def pixel_of(x: Column, y: Column, x0: float, y1: float, resolution: float) -> tuple[Column, Column]:
    return F.floor((y1 - y) / resolution).cast("int"), F.floor((x - x0) / resolution).cast("int")


def bounds(ring: Column) -> Column:
    """Box of a ring."""
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("x0"), F.array_min(lat).alias("y0"), F.array_max(lon).alias("x1"), F.array_max(lat).alias("y1"))


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a point is inside a closed ring: an odd number of edges crosses the line to its right."""
    edges = F.sequence(F.lit(0), F.size(ring) - 2)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        beside = (a["lat"] > lat) != (b["lat"] > lat)
        return beside & (lon < F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(edges, lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


def thinned(ring: Column, tolerance: float) -> Column:
    """A ring on a grid of ``tolerance`` degrees without repeated points in a row."""
    grid = F.transform(ring, lambda p: F.struct((F.round(p["lon"] / tolerance) * tolerance).alias("lon"), (F.round(p["lat"] / tolerance) * tolerance).alias("lat")))
    return F.filter(grid, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(grid, i - 1)))


def to_geojson(ring: Column, precision: int = 6) -> Column:
    """A polygon as compact text; null for null or empty rings."""
    points = F.transform(ring, lambda p: F.array(F.round(p["lon"], precision), F.round(p["lat"], precision)))
    return F.when(F.size(ring) > 0, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))))


def from_geojson(text: Column) -> Column:
    """The outer ring of a polygon's text."""
    parsed = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    return F.transform(F.get(parsed["coordinates"], F.lit(0)), lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))
