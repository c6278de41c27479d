"""Joins with polygons by covers of grid cells.

A shape (id, rings) has closed rings of (lon, lat) structs: its outline, further parts and holes; a place is inside if an odd
number of edges crosses the line to its right. A cover names the cells that a shape touches: those that an edge passes are
border cells, the others lie inside as a whole. Points meet shapes by an equi-join on cells; only points in border cells
are tested, with the edges of their row of cells, by the same arithmetic as a test against all edges. Work follows the
number of edges and cells; nothing compares all points with all shapes. Cells outgrow what the planner expects of shapes, so
joins with them are merges, never broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import bucket

#: Share of a cell by which an edge counts as touching it from outside: more than rounding moves it.
MARGIN = 1e-6


def edges(shapes: DataFrame) -> DataFrame:
    """(id, x0, y0, x1, y1) of all sides; places without coordinates end a ring's sides there."""
    ring = F.explode("rings").alias("ring")
    each = shapes.select("id", ring).where(F.size("ring") > 1).select("id", F.explode(F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", i + 1).alias("b")))).alias("e"))
    return each.select("id", F.col("e.a.lon").alias("x0"), F.col("e.a.lat").alias("y0"), F.col("e.b.lon").alias("x1"), F.col("e.b.lat").alias("y1")).dropna()


def border_cells(sides: DataFrame, size: float) -> DataFrame:
    """(id, bx, by) of the cells that a side touches: in each column of cells the rows between its ends there."""
    near = MARGIN * size
    lo, hi = F.least("x0", "x1"), F.greatest("x0", "x1")
    cols = sides.withColumn("bx", F.explode(F.sequence(bucket(lo - near, size), bucket(hi + near, size))))
    left, right = F.greatest(lo, F.col("bx") * size - near), F.least(hi, (F.col("bx") + 1) * size + near)
    at = lambda x: F.coalesce(F.col("y0") + F.try_divide((F.col("y1") - F.col("y0")) * (x - F.col("x0")), F.col("x1") - F.col("x0")), F.col("y0"))
    steep = hi - lo <= near  # no slope to speak of: all of its height
    ends = [F.when(steep, F.col("y0")).otherwise(at(left)), F.when(steep, F.col("y1")).otherwise(at(right))]
    rows = F.sequence(bucket(F.least(*ends) - near, size), bucket(F.greatest(*ends) + near, size))
    return cols.select("id", "bx", F.explode(rows).alias("by")).distinct()


def crossings(sides: DataFrame, size: float) -> DataFrame:
    """(id, by, x): where sides cross the middle line of each row of cells."""
    rows = sides.withColumn("by", F.explode(F.sequence(bucket(F.least("y0", "y1"), size), bucket(F.greatest("y0", "y1"), size))))
    y = (F.col("by") + 0.5) * size
    x = F.col("x0") + (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0"))
    return rows.where((F.col("y0") > y) != (F.col("y1") > y)).select("id", "by", x.alias("x"))


def cover(shapes: DataFrame, size: float) -> DataFrame:
    """(id, bx, by, border): all cells of each shape. Inner cells are those between an odd and the next crossing of their
    row's middle line that no side touches."""
    sides = edges(shapes)
    border = border_cells(sides, size)
    rows = crossings(sides, size).groupBy("id", "by").agg(F.sort_array(F.collect_list("x")).alias("x"))
    spans = rows.select("id", "by", F.explode(F.transform(F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.get("x", 2 * i).alias("a"), F.get("x", 2 * i + 1).alias("b")))).alias("s"))
    first, last = F.ceil(F.col("s.a") / size - 0.5), F.floor(F.col("s.b") / size - 0.5)
    inner = spans.where(first <= last).select("id", F.explode(F.sequence(first, last)).alias("bx"), "by").distinct()
    inner = inner.join(border.hint("merge"), ["id", "bx", "by"], "left_anti")
    return border.withColumn("border", F.lit(True)).unionByName(inner.withColumn("border", F.lit(False)))


def row_sides(sides: DataFrame, size: float) -> DataFrame:
    """(id, by, sides): the sides that reach into each row of cells."""
    rows = sides.withColumn("by", F.explode(F.sequence(bucket(F.least("y0", "y1"), size), bucket(F.greatest("y0", "y1"), size))))
    return rows.groupBy("id", "by").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("sides"))


def crossed(sides: Column, lon: Column, lat: Column) -> Column:
    """Whether an odd number of sides crosses the line to the right of a place."""
    beside = lambda e: (e["y0"] > lat) != (e["y1"] > lat)
    right = lambda e: lon < F.try_divide((e["x1"] - e["x0"]) * (lat - e["y0"]), e["y1"] - e["y0"]) + e["x0"]
    return F.size(F.filter(sides, lambda e: F.coalesce(beside(e) & right(e), F.lit(False)))) % 2 == 1


def inside(points: DataFrame, shapes: DataFrame, size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``points`` (lon, lat, ...) with the ``id`` of each shape that they lie in. ``keys`` are columns of both sides that must be
    equal; shapes with several parts or holes are one row. Places that are null lie nowhere."""
    sides = edges(shapes)
    cells = cover(shapes, size).join(row_sides(sides, size).hint("merge"), ["id", "by"], "left")
    cells = cells.select("id", "bx", "by", "border", F.when(F.col("border"), F.col("sides")).alias("sides"))
    if keys:
        cells = cells.join(shapes.select("id", *keys), "id")
    placed = points.withColumn("bx", bucket(F.col("lon"), size)).withColumn("by", bucket(F.col("lat"), size))
    met = placed.join(cells.hint("merge"), ["bx", "by", *keys])
    return met.where(~F.col("border") | crossed(F.col("sides"), F.col("lon"), F.col("lat"))).drop("bx", "by", "border", "sides")


def area(rings: Column) -> Column:
    """Area of a shape whose holes run the other way round than its outline, in square units of its coordinates."""

    def of(ring: Column) -> Column:
        cross = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.get(ring, i)["lon"] * F.get(ring, i + 1)["lat"] - F.get(ring, i + 1)["lon"] * F.get(ring, i)["lat"])
        return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2

    return F.abs(F.aggregate(F.transform(F.filter(rings, lambda r: F.size(r) > 3), of), F.lit(0.0), lambda a, v: a + v))


def shared_cells(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """(l_id, r_id, cells): how many cells whose middle lies in both a pair of shapes shares. Cells of a fine grid make it the
    common area."""

    def middles(shapes: DataFrame, name: str) -> DataFrame:
        own = cover(shapes, size)
        sides = row_sides(edges(shapes), size)
        x, y = (F.col("bx") + 0.5) * size, (F.col("by") + 0.5) * size
        return own.join(sides.hint("merge"), ["id", "by"], "left").where(~F.col("border") | crossed(F.col("sides"), x, y)).select(F.col("id").alias(name), "bx", "by")

    return middles(left, "l_id").join(middles(right, "r_id").hint("merge"), ["bx", "by"]).groupBy("l_id", "r_id").agg(F.count("*").alias("cells"))


def best_shared(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """For each left shape the right one that it shares the most cells with; ties to the smaller id."""
    shared = shared_cells(left, right, size)
    return shared.groupBy(F.col("l_id").alias("id")).agg(F.min_by(F.struct("r_id", "cells"), F.struct((-F.col("cells")).alias("n"), "r_id")).alias("m")).select("id", F.col("m.r_id").alias("match"), "m.cells")


def area_recipients(alerts: DataFrame, subscribers: DataFrame, size: float) -> DataFrame:
    """(alert_id, sub_id): subscribers (id, rings) whose area holds the alert's site or one of its exposed places. ``alerts``:
    alert_id and a row for each such place (lon, lat)."""
    return inside(alerts.select("alert_id", "lon", "lat"), subscribers, size).select("alert_id", F.col("id").alias("sub_id")).distinct()
