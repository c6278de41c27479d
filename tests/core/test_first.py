"""The first match is that of all pairs, but not all pairs are formed; lakes that share an id are told apart."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from scarp.operators import inventory, joins, tables


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(2), rng.randrange(3), dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(200)), 85 + rng.random() / 3, 27.5 + rng.random() / 3) for k in range(1500)]
    return joins.padded(spark.createDataFrame(rows, "id long, aoi int, orbit int, at timestamp_ntz, lon double, lat double"), 0.02).cache()


def matches(events):
    rows = events.collect()
    meets = lambda a, b: a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1
    return {a.id: [b.id for b in rows if a.aoi == b.aoi and a.orbit != b.orbit and dt.timedelta(0) <= a.at - b.at <= dt.timedelta(days=60) and meets(a, b)] for a in rows}


def test_the_first_match_is_that_of_all_pairs(spark, events):
    want = {k: v for k, v in matches(events).items() if v}
    on = F.col("l_orbit") != F.col("r_orbit")
    assert {r.id: r.found for r in joins.first_before(events, events, 0.1, 60, ("aoi",), on).collect()} == {k: min(v) for k, v in want.items()}
    some = {r.id: r.found for r in joins.first_before(events, events, 0.1, 60, ("aoi",), on, least=False).collect()}
    assert some.keys() == want.keys() and all(v in want[k] for k, v in some.items())
    assert joins.first_before(events, events.where("id < 0"), 0.1, 60, ("aoi",), on).count() == 0


def test_copies_do_not_form_all_pairs(spark, events, monkeypatch):
    """What the rounds write beside the right events themselves grows with the rows, not with their pairs."""
    from scarp.sources import shared

    def written(n):
        many = events.join(spark.range(n).select(F.col("id").alias("c")), how="cross").withColumn("id", F.col("id") + F.col("c") * 10_000).drop("c")
        sizes = []
        plain = shared.saved
        monkeypatch.setattr(shared, "saved", lambda df: sizes.append((out := plain(df)).count()) or out)
        got = {r.id: r.found for r in joins.first_before(many, many, 0.1, 60, ("aoi",), F.col("l_orbit") != F.col("r_orbit")).collect()}
        monkeypatch.setattr(shared, "saved", plain)
        return got, sizes

    one, _ = written(1)
    many, sizes = written(8)
    assert many == {k + c * 10_000: v for k, v in one.items() for c in range(8)}
    assert max(sizes) < 8 * 1500 * 8 and sizes[-1] <= 8 * 1500


def test_lakes_of_one_id_are_told_apart(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    lakes = spark.createDataFrame([(1, day(20), 85.0, 27.5), (1, day(2), 85.0, 27.5)], "id long, at timestamp_ntz, lon double, lat double")
    facts = {"known": F.lit(None).cast("long"), "quality": F.lit(0.95), "probability": F.lit(0.9), "was_dry": F.lit(True), "glacial": F.lit(False), "z_range": F.lit(5.0)}
    moves = spark.createDataFrame([(7, day(10), 85.01, 27.51, 0.9, True)], "id long, at timestamp_ntz, lon double, lat double, confidence double, confirmed boolean")
    lakes = lakes.withColumns(facts)
    out = inventory.lake_decisions(lakes, inventory.moved_near(lakes, moves, 45, 0.03, 0.6))
    assert {(r.at.day, r.action) for r in out.collect()} == {(20, "barrier_lake"), (2, "none")}


def test_tasks_of_an_upsert_follow_its_rows(spark):
    old, new = spark.range(10).selectExpr("id", "1 AS v"), spark.range(5, 15).selectExpr("id", "2 AS v")
    few, many = (tables.upsert(old, new, ["id"], rows=n) for n in (20, 40 * tables.ROWS_A_TASK))
    assert many.rdd.getNumPartitions() == 41 > few.rdd.getNumPartitions() == 1
    assert {tuple(r) for r in many.collect()} == {tuple(r) for r in few.collect()} == {(k, 1 if k < 5 else 2) for k in range(15)}
