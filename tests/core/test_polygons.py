"""Polygon joins against a test of every place with every side."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F
from scarp.operators import polygons

SHAPES = "id long, rings array<array<struct<lon: double, lat: double>>>, aoi long"


def held(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def star(rng, x, y, r):
    n = rng.randint(3, 12)
    p = [(x + rng.uniform(0.2, 1) * r * math.cos(2 * math.pi * k / n), y + rng.uniform(0.2, 1) * r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*p, p[0]]


def shapes_of(rng):
    out = []
    for k in range(25):
        x, y, r = rng.uniform(-2, 2), rng.uniform(-2, 2), rng.choice([0.01, 0.1, 0.7, 1.5])
        rings = [star(rng, x, y, r)]
        if k % 3 == 0:
            rings.append(star(rng, x, y, r * 0.15)[::-1])  # a hole
        if k % 4 == 0:
            rings.append(star(rng, x + 3 * r, y, r))  # a second part
        out.append((k, rings))
    square = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    out += [(100, [square(0.0, 0.0, 1.0, 1.0), square(0.25, 0.25, 0.75, 0.75)]), (101, [square(-0.1, -0.1, 0.1, 0.1)]), (102, []), (103, [[(0.0, 0.0)]]), (104, [[(0.0, 0.0), (1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]])]
    return out


def frame(spark, shapes):
    return spark.createDataFrame([(k, [[{"lon": x, "lat": y} for x, y in ring] for ring in rings], k % 3) for k, rings in shapes], SHAPES)


def test_points_in_shapes(spark):
    rng = random.Random(12)
    shapes = shapes_of(rng)
    places = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(1500)]
    places += [p for _, rings in shapes for ring in rings for p in ring]  # corners, and places on sides of squares
    places += [(a / 4, b / 4) for a in range(-2, 6) for b in range(-2, 6)] + [(None, 1.0), (1.0, None)]
    points = spark.createDataFrame([(i, x, y, i % 3) for i, (x, y) in enumerate(places)], "p long, lon double, lat double, aoi long")
    expected = {(i, k) for i, (x, y) in enumerate(places) if x is not None and y is not None for k, rings in shapes if held(rings, x, y)}
    assert len(expected) > 500
    for size in (0.05, 0.25, 3.0):
        got = [(r["p"], r["id"]) for r in polygons.inside(points.drop("aoi"), frame(spark, shapes), size).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    keyed = {(r["p"], r["id"]) for r in polygons.inside(points, frame(spark, shapes), 0.25, ("aoi",)).collect()}
    assert keyed == {(i, k) for i, k in expected if i % 3 == k % 3}
    assert polygons.inside(points.limit(0).drop("aoi"), frame(spark, shapes), 0.25).count() == 0


def test_covers_hold_no_more_cells_than_they_touch(spark):
    shapes = frame(spark, [(1, [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]])])
    cells = polygons.cover(shapes, 0.5).groupBy("border").count().collect()
    counts = {r["border"]: r["count"] for r in cells}
    assert counts[False] >= 18 * 18
    assert counts[True] + counts[False] <= 22 * 22


def test_areas_and_shared_cells(spark):
    square = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d), (a, b)]
    left = frame(spark, [(1, [square(0.0, 0.0, 2.0, 2.0), square(0.5, 0.5, 1.5, 1.5)[::-1]]), (2, [square(5.0, 5.0, 6.0, 6.0)])])
    right = frame(spark, [(7, [square(1.0, 0.0, 3.0, 1.0)]), (8, [square(0.0, 0.0, 1.0, 2.0)])])
    assert {r["id"]: r["a"] for r in left.select("id", polygons.area(F.col("rings")).alias("a")).collect()} == {1: 3.0, 2: 1.0}
    shared = {(r["l_id"], r["r_id"]): r["cells"] * 0.01 for r in polygons.shared_cells(left, right, 0.1).collect()}
    assert {k: round(v, 6) for k, v in shared.items()} == {(1, 7): 0.75, (1, 8): 1.5}
    assert [(r["id"], r["match"]) for r in polygons.best_shared(left, right, 0.1).collect()] == [(1, 8)]
