"""Ties and halves have one outcome, whatever the order of rows."""

from __future__ import annotations

import datetime as dt
import itertools

import duckdb
from pyspark.sql import functions as F
from scarp.functions import phrases as P
from scarp.operators import alerts, risk, stats
from scarp.plans import messages, terrain
from scarp.sources import catalogue


def test_products_of_one_id_leave_the_largest_row(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("S2", "A", at, 1, "T1_R001_20240101T000000", c) for c in (7.0, None, 9.0, 8.0)]
    for order in (rows, rows[::-1]):
        out = catalogue.acquisitions(spark.createDataFrame(order, "sensor string, platform string, at timestamp_ntz, orbit int, id string, cloud double").repartition(1))
        assert [(r.items, r.cloud) for r in out.collect()] == [(1, 9.0)]


def test_halves_are_settled(spark):
    df = spark.createDataFrame([(0.9140625,), (0.9140625 - 1e-12,), (-0.0,), (0.1,)], "x double")
    assert [r.y for r in df.select(stats.settled(F.col("x")).alias("y")).collect()] == [0.914063, 0.914063, 0.0, 0.1]
    near = spark.createDataFrame([(0.5 - 1e-14, 0.05 - 1e-15, 1.0 - 1e-14, 2)], "z double, v_recent double, ratio double, orbits int")
    assert near.select(stats.significant(0.5, 0.05, 1.0)).first()[0]


def test_a_path_that_goes_back_keeps_its_tip(spark, tmp_path):
    spark.createDataFrame([(k, f"s{k}", 1, 0.0) for k in (0, 500, 250, 750)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(r) for r in terrain.thinned_paths(spark, str(tmp_path)).collect()}
    sql = terrain.ORACLES["thinned_paths"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == set(duckdb.sql(sql).fetchall())


def test_the_hotline_is_a_number_of_its_own(spark):
    footer = P.FOOTER["en"].replace("{hotline}", "1155")
    text = spark.createDataFrame([("1155", f"Place 21155, 27.1155N. {footer}"), ("1155", "Place 21155, 27.1155N.")], "hotline string, body string")
    facts = {k: F.lit("x 1155") for k in alerts.TEXTS} | {"body_en": F.col("body")}
    columns = {c: F.lit("x") for c in ("code", "site_en", "site_ne", "seen_at", "url", "kind", "level")} | {c: F.lit(1.5) for c in ("lat", "lon", "elevation_m")}
    empty = {"reasons": F.array().cast("array<struct<code:string,text_en:string,text_ne:string>>"), "places": F.array().cast(alerts.PLACES)}
    got = text.withColumns(columns | empty).select(alerts.issues(facts).alias("i")).collect()
    assert ["hotline_en" in r.i for r in got] == [False, True] and messages.NO_FACT.isdigit()


def test_a_value_at_its_bound_is_not_above_it(spark):
    """Equal errors make the base 0.2 and the bound of a fast row 0.2 + 2 * 0.1, in whatever order the base is added."""
    for order in itertools.permutations([0.11, 0.18, 0.31]):
        rows = [(1, 10.0 + k, v) for k, v in enumerate(order)] + [(1, 1.0, 0.4), (1, 2.0, 0.4), (1, 3.0, 0.8)]
        df = spark.createDataFrame(rows, "site_id long, age double, v double").repartition(1)
        df = df.withColumns({"kind": F.lit("velocity"), "se": F.lit(0.1), "coverage": F.lit(1.0), "n_points": F.lit(9), "slope": F.lit(30.0), "observed_at": F.timestamp_seconds(-F.col("age") * 86400)})
        w = risk.Windows(recent=8, season=(22, 26), fallback=(9, 21), min_z=0.5)
        out = risk.ice_features(df, ["site_id"], w).first()
        assert out.ratio > 1 and out.trend == 0
