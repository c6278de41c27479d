"""Rows that agree are paired once: counts and ids are those of all pairs, and what is paired doesn't grow with copies."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from scarp.operators import detection, joins
from scarp.plans import inventory, lifecycle, reads, registry, relations, rescoring, shapes


def test_lakes_collect_no_pixels_for_a_broadcast(spark, capsys):
    rows = [(1, r, c, r < 3 and c < 3, True, 10.0 * r, 5.0, 100.0, True) for r in range(8) for c in range(8)]
    px = spark.createDataFrame(rows, "scene int, row int, col int, water boolean, valid boolean, z double, slope double, ice_m double, core boolean")
    out = detection.lakes(px, ["scene"], 100.0, 400.0)
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out and [r.pixels for r in out.collect()] == [9]


def copies(spark, n, places=3):
    return spark.createDataFrame([(k, 85.0 + k % places / 100, 27.5) for k in range(n)], "id long, lon double, lat double")


def test_copies_at_a_place_are_paired_once(spark):
    left, right = copies(spark, 300), copies(spark, 600, 4).withColumn("id", F.col("id") + 1000)
    assert joins.close_places(left, right, 0.5).count() == 3
    assert {(r.id, r.nearest) for r in joins.nearest(left, right, 0.5, "id", "id").collect()} == {(k, 1000 + k % 3) for k in range(300)}


def test_few_nearest_are_those_of_all_pairs(spark):
    left, right = copies(spark, 6), copies(spark, 20, 4).withColumn("id", F.col("id") + 1000)
    a, b = left.collect(), right.collect()
    km = lambda p, q: round(math.hypot((p.lon - q.lon) * 111.32 * math.cos(math.radians(p.lat)), (p.lat - q.lat) * 110.57), 6)
    want = {(p.id, q.id) for p in a for q in sorted(b, key=lambda q: (km(p, q), q.id))[:7]}
    assert {(r.l, r.id) for r in joins.nearest_few(left.withColumnRenamed("id", "l"), right, 9.0, 7, "l", "id").collect()} == want


def test_best_match_of_equal_boxes(spark):
    left = joins.padded(copies(spark, 30), 0.004).withColumn("kind", F.when(F.col("id") % 2 == 0, "a"))
    right = joins.padded(copies(spark, 30).withColumn("id", F.col("id") + 100), 0.004).withColumn("kind", F.when(F.col("id") < 110, "a").otherwise("b"))
    got = {r.id: r.match for r in joins.best_match(left, right, 0.01, "id", "id", F.col("l_kind").isNull() | (F.col("l_kind") != F.col("r_kind")), ("kind",)).collect()}
    first = lambda k: min(x for x in range(100, 130) if (x - 100) % 3 == k % 3 and (k % 2 or x >= 110))
    assert got == {k: first(k) for k in range(30)}


def test_partners_meet_once_from_each_side(spark):
    rows = [(1, 1, "2024-01-01"), (2, 2, "2024-01-01"), (3, 1, "2024-01-20"), (4, 2, "2024-05-01")]
    ev = joins.padded(spark.createDataFrame(rows, "id long, orbit int, at string").withColumns({"at": F.col("at").cast("timestamp_ntz"), "lon": F.lit(85.0), "lat": F.lit(27.5), "aoi": F.lit(1)}), 0.02)
    got = sorted((r.l_id, r.r_id) for r in joins.partners(ev, 0.1, 60, ("aoi",), F.col("l_orbit") != F.col("r_orbit")).collect())
    assert got == [(1, 2), (2, 1), (2, 3), (3, 2)]


class Tables:
    """Tables with copies: keys shifted by whole periods of the places."""

    def __init__(self, spark, path, times):
        self.path = str(path)
        for name, key in (("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey")):
            one = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
            many = one.join(spark.range(times), how="cross").withColumn(key, (F.col(key) + F.col("id") * 42000).cast(one.schema[key].dataType)).drop("id")
            many.write.parquet(f"{self.path}/{name}.parquet")


def test_recipients_of_copies_are_counted_by_class(spark, tmp_path, monkeypatch):
    one, many = Tables(spark, tmp_path / "one", 1), Tables(spark, tmp_path / "many", 3)
    seen = []
    plain = joins.recipients
    monkeypatch.setattr(joins, "recipients", lambda a, s: seen.append((a.count(), s.count())) or plain(a, s))
    for query in (relations.recipients_theta, lifecycle.pending_deliveries, lifecycle.dispatched_deliveries):
        a, b = query(spark, one.path).collect(), query(spark, many.path).collect()
        assert a and len(b) == 3 * len(a)
        assert seen.pop() == seen.pop(), query.__name__  # copies add no class
    n = {r.alert_id: r.n for r in lifecycle.pending_deliveries(spark, one.path).collect()}
    assert {r.alert_id: r.n for r in lifecycle.pending_deliveries(spark, many.path).collect() if r.alert_id < 42000} == {k: 3 * v for k, v in n.items()}


def test_places_of_copies_are_sought_once(spark, tmp_path, monkeypatch):
    one, many = Tables(spark, tmp_path / "one", 1), Tables(spark, tmp_path / "many", 3)
    seen = []
    plain = joins.close_pairs
    monkeypatch.setattr(joins, "close_pairs", lambda a, b, *more: seen.append(a.count()) or plain(a, b, *more))
    for query in (relations.nearest_place, inventory.renewed_exposures, lifecycle.matched_recipients, shapes.shape_recipients, relations.path_exposure):
        query(spark, one.path), query(spark, many.path)
        assert seen.pop() == seen.pop(), query.__name__


def test_shapes_of_copies(spark, tmp_path):
    one, many = Tables(spark, tmp_path / "one", 1), Tables(spark, tmp_path / "many", 2)
    assert shapes.assets_in_shapes(spark, many.path).count() == 4 * shapes.assets_in_shapes(spark, one.path).count()
    a = {(r.asset_id, r.site_id) for r in shapes.matched_shapes(spark, one.path).collect()}
    assert {(r.asset_id % 42000, r.site_id) for r in shapes.matched_shapes(spark, many.path).collect()} == a
