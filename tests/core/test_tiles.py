"""Kernels over tiles against plain loops: across borders, with gaps, at negative places, and on a large scene."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from scarp.operators import raster, terrain, tiles
from scarp.sources import catalogue


def scene(rng, height, width, gaps=0.1, nulls=0.1, r0=-7, c0=250):
    """{(row, col): value}, some pixels missing, some null."""
    at = [(r + r0, c + c0) for r in range(height) for c in range(width)]
    return {p: None if rng.random() < nulls else float(rng.normal(0, 3)) for p in at if rng.random() >= gaps}


@pytest.fixture(scope="module")
def scenes():
    rng = np.random.default_rng(4)
    return {"a": scene(rng, 40, 45), "b": scene(rng, 3, 60), "c": scene(rng, 1, 1, 0, 0), None: scene(rng, 9, 9, 0, 0)}


def rows_of(spark, scenes):
    return spark.createDataFrame([(k, r, c, v, "x") for k, px in scenes.items() for (r, c), v in px.items()], "scene string, row int, col int, v double, mean string").drop("mean")


def around(px, p, reach):
    return [px[r, c] for r in range(p[0] - reach, p[0] + reach + 1) for c in range(p[1] - reach, p[1] + reach + 1) if px.get((r, c)) is not None]


@pytest.mark.parametrize("size", [8, 256])
@pytest.mark.parametrize("reach", [1, 2])
def test_median_and_moments(spark, scenes, size, reach):
    px = rows_of(spark, scenes)
    out = tiles.over_tiles(px, ["scene"], ["v"], tiles.local_median("v", reach), {"median": "double"}, reach, size)
    out = tiles.over_tiles(out, ["scene"], ["v"], tiles.local_moments("v", reach), {"mean": "double", "var": "double"}, reach, size).collect()
    assert len(out) == sum(map(len, scenes.values()))
    for r in out:
        x = around(scenes[r["scene"]], (r["row"], r["col"]), reach)
        if not x:
            assert r["median"] is r["mean"] is r["var"] is None
        else:
            assert math.isclose(r["median"], np.median(x)) and math.isclose(r["mean"], np.mean(x), abs_tol=1e-12) and math.isclose(r["var"], np.var(x), abs_tol=1e-12)


@pytest.mark.parametrize("reach", [1, 4])
def test_voids_take_the_nearest_value(spark, scenes, reach):
    for r in catalogue.nearest_filled(rows_of(spark, scenes), ["scene"], reach).collect():
        px, at = scenes[r["scene"]], (r["row"], r["col"])
        near = [((a - at[0]) ** 2 + (b - at[1]) ** 2, v) for (a, b), v in px.items() if v is not None and max(abs(a - at[0]), abs(b - at[1])) <= reach]
        assert r["v"] == (min(near)[1] if near else None)


def test_shadow_reaches_across_tiles(spark):
    wall = {(r, c): 500.0 if r == 70 and 20 <= c < 60 else 0.0 for r in range(72) for c in range(80)}
    px = rows_of(spark, {"a": wall})
    for azimuth in (180.0, 135.0, 20.0):
        steps = tiles.ray_steps(30.0, azimuth, 20.0, 1200.0)
        out = tiles.over_tiles(px, ["scene"], ["v"], tiles.shaded("v", steps), {"shadow": "boolean"}, tiles.halo_of(steps), 16).collect()
        for r in out:
            expected = any(wall.get((r["row"] + dr, r["col"] + dc), -1e9) - rise > r["v"] for dr, dc, rise in steps)
            assert r["shadow"] == expected
        assert azimuth == 20.0 or sum(r["shadow"] for r in out) > 500


def test_gaussian_and_static_layers(spark):
    rng = np.random.default_rng(8)
    z = {(r, c): 3000 + 15.0 * r + float(rng.normal(0, 20)) for r in range(30) for c in range(33)}
    px = rows_of(spark, {"a": z}).withColumn("glacier", (F.col("row") < 3) & (F.col("col") < 5))
    small, large = (tiles.over_tiles(px, ["scene"], ["v"], tiles.gaussian("v", 2.0, 6), {"low": "double"}, 6, n).collect() for n in (9, 256))
    low = {(r["row"], r["col"]): r["low"] for r in large}
    for r in small:
        w = {(a, b): math.exp(-((a - r["row"]) ** 2 + (b - r["col"]) ** 2) / 8.0) for a in range(r["row"] - 6, r["row"] + 7) for b in range(r["col"] - 6, r["col"] + 7) if (a, b) in z}
        assert math.isclose(r["low"], sum(v * z[p] for p, v in w.items()) / sum(w.values())) and math.isclose(r["low"], low[r["row"], r["col"]])
    old = raster.slope_aspect(px, ["scene"], 30.0).select("row", "col", F.col("slope").alias("s"))
    out = terrain.tile_static(px, ["scene"], 30.0, 3200.0, 100.0, 4).join(old, ["row", "col"]).collect()
    assert len(out) == len(z) and all(math.isclose(r["slope"], r["s"]) for r in out)
    ice = [(r, c) for r in range(3) for c in range(5)]
    for r in out:
        near = min(math.hypot(r["row"] - a, r["col"] - b) * 30.0 for a, b in ice) <= 100.0
        watch = r["v"] >= 3200 and (r["glacier"] or r["slope"] >= 20)
        assert r["watch"] == watch and r["stable"] == (not near and not watch and 3 < r["slope"] < 30)


def test_a_large_scene_is_shuffled_once(spark):
    n = 2000
    px = spark.range(n * n).select(F.lit(1).alias("scene"), (F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col")).withColumn("v", F.pmod(F.xxhash64("row", "col"), F.lit(1000)).cast("double"))
    assert tiles.dealt(px, ["scene"], (1, 1, 1, 1)).count() < 1.02 * n * n
    got = raster.median_filter(px, ["scene"]).select("row", "col", "v", "median").toArrow()
    row, col = (got[c].to_numpy() for c in ("row", "col"))
    v, median = np.full((n + 2, n + 2), np.nan), np.zeros((n, n))
    v[row + 1, col + 1], median[row, col] = got["v"].to_numpy(), got["median"].to_numpy()
    assert len(row) == n * n
    for r0 in range(0, n, 250):
        block = np.stack([v[r0 + dr : r0 + dr + 250, dc : dc + n] for dr in range(3) for dc in range(3)])
        inner = np.s_[1:-1] if 0 < r0 < n - 250 else np.s_[2:-2]
        assert (np.sort(block, axis=0)[4][inner, 1:-1] == median[r0 : r0 + 250][inner, 1:-1]).all()
    assert median[0, 0] == np.median(v[1:3, 1:3]) and median[-1, 5] == np.median(v[-3:-1, 5:8])


def test_empty_and_repeated(spark):
    px = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 0, 1.0), ("a", 0, 1, 3.0)], "scene string, row int, col int, v double")
    assert sorted(r["median"] for r in raster.median_filter(px, ["scene"]).collect()) == [2.0, 2.0, 2.0]
    assert raster.median_filter(px.limit(0), ["scene"]).count() == 0
    with pytest.raises(ValueError):
        tiles.over_tiles(px.withColumn("_own", F.lit(1)), ["scene"], ["v"], tiles.local_median("v", 1), {"median": "double"}, 1)
