"""Domain views over the driver's tables: projections only, so column pruning and filters reach the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"view": "lake_area", "click": "velocity", "purchase": "sar_change", "signup": "surface_change", "error": "insar_los"}
ORBITS = (19, 85, 121)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(values, key: Column) -> Column:
    """The value at place ``key`` of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def observations(spark, sf_dir) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("site_id"),
        kind.alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "S1").otherwise("S2").alias("sensor"),
        F.col("ts").alias("observed_at"),
        F.col("value").alias("v"),
        (0.5 + 0.25 * (F.col("event_id") % 7)).alias("se"),
        chosen(ORBITS, F.col("event_id") % 3).alias("orbit"),
        (0.5 + (F.col("event_id") % 50) / 100.0).alias("quality"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.get_json_object("props", "$.k").cast("double").alias("reference"),
        (F.col("event_id") % 1200).cast("double").alias("glacier_m"),
        (0.2 + F.col("event_id") % 40 / 100.0).alias("turbidity"),
        (F.col("event_id") % 100 / 100.0).alias("coverage"),
        (F.col("event_id") % 40).cast("int").alias("n_points"),
    )


OBS = """obs AS (SELECT event_id, user_id AS site_id, CASE event_type WHEN 'view' THEN 'lake_area' WHEN 'click' THEN 'velocity' WHEN 'purchase' THEN 'sar_change'
 WHEN 'signup' THEN 'surface_change' WHEN 'error' THEN 'insar_los' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'S1' ELSE 'S2' END AS sensor, ts AS observed_at, value AS v,
 0.5::DOUBLE + 0.25::DOUBLE * (event_id % 7) AS se, CASE event_id % 3 WHEN 0 THEN 19 WHEN 1 THEN 85 ELSE 121 END AS orbit,
 0.5::DOUBLE + (event_id % 50)::DOUBLE / 100::DOUBLE AS quality, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS reference, (event_id % 1200)::DOUBLE AS glacier_m,
 0.2::DOUBLE + (event_id % 40)::DOUBLE / 100::DOUBLE AS turbidity, (event_id % 100)::DOUBLE / 100::DOUBLE AS coverage, (event_id % 40)::INTEGER AS n_points FROM events)"""


def cell_velocities(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cell"),
        F.col("l_shipdate").alias("pair_end"),
        F.col("l_discount").alias("v"),
        (0.01 + F.col("l_tax") / 10).alias("se"),
        (F.col("l_linenumber") % 3).alias("orbit"),
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("pair_key"),
        F.col("l_quantity").alias("n"),
    )


CELLS = """cellv AS (SELECT l_suppkey AS cell, l_shipdate AS pair_end, l_discount AS v, 0.01::DOUBLE + l_tax / 10 AS se, l_linenumber % 3 AS orbit,
 l_orderkey || '_' || l_linenumber AS pair_key, l_quantity AS n FROM lineitem)"""


def acquisitions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, "S1").otherwise("S2").alias("sensor"),
        F.col("o_orderkey").alias("key"),
        F.col("o_orderdate").alias("acquired_at"),
        (F.col("o_custkey") % 7).alias("orbit"),
        F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("status"),
        F.col("o_totalprice").alias("area_m2"),
    )


ACQ = """acq AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'S1' ELSE 'S2' END AS sensor, o_orderkey AS key, o_orderdate AS acquired_at, o_custkey % 7 AS orbit,
 CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status, o_totalprice AS area_m2 FROM orders)"""

SITE_KINDS = ("glacier", "glacial_lake", "slope", "landslide", "barrier_lake")
ASSET_KINDS = ("town", "bridge", "hydropower", "settlement")


def _placed(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return (85 + (k * 37 % 1000) / 1000.0).alias("lon"), (27.5 + (k * 91 % 1000) / 1000.0).alias("lat")


def sites(spark, sf_dir) -> DataFrame:
    level = F.when(F.col("s_acctbal") >= 6000, "high").when(F.col("s_acctbal") >= 3000, "medium").when(F.col("s_acctbal") >= 0, "low").otherwise("unknown")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("code"), chosen(SITE_KINDS, F.col("s_suppkey") % 5).alias("kind"), *_placed("s_suppkey"), F.col("s_nationkey").alias("aoi"), level.alias("level"), F.col("s_acctbal").alias("z")
    )


#: Factors that give each kind of observation the size of its unit.
UNITS = {"lake_area": 1e4, "velocity": 0.02, "sar_change": 1e4, "surface_change": 10.0, "insar_los": 1e-5}


def monitored(spark, sf_dir) -> DataFrame:
    """Observations in the units of their kinds: square metres, metres, metres a day."""
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])[F.col("kind")]
    return observations(spark, sf_dir).withColumns({"v": F.col("v") * unit, "se": F.col("se") * unit, "reference": F.col("reference") * 1e4})


MONITORED = f"""{OBS}, mon AS (SELECT event_id, site_id, kind, sensor, observed_at, v * u AS v, se * u AS se, orbit, quality, reference * 1e4::DOUBLE AS reference, glacier_m, turbidity, coverage, n_points FROM obs
 JOIN (VALUES ('lake_area', 1e4::DOUBLE), ('velocity', 0.02::DOUBLE), ('sar_change', 1e4::DOUBLE), ('surface_change', 10::DOUBLE), ('insar_los', 1e-5::DOUBLE)) u(kind, u) USING (kind))"""


def site_facts(spark, sf_dir) -> DataFrame:
    """What is known of sites themselves."""
    k = F.col("site_id")
    return sites(spark, sf_dir).select("site_id", F.col("kind").alias("site_kind"), "aoi", (15.0 + k % 25).alias("slope"), (20.0 + k % 30).alias("walls"), (k * 37 % 1500).cast("double").alias("glacier_m"), (k % 7 * 100_000).cast("double").alias("area"))


FACTS = """fact AS (SELECT site_id, kind AS site_kind, aoi, 15::DOUBLE + site_id % 25 AS slope, 20::DOUBLE + site_id % 30 AS walls, (site_id * 37 % 1500)::DOUBLE AS glacier_m, (site_id % 7 * 100000)::DOUBLE AS area FROM site)"""

SITES = """site AS (SELECT s_suppkey AS site_id, s_name AS code, CASE s_suppkey % 5 WHEN 0 THEN 'glacier' WHEN 1 THEN 'glacial_lake' WHEN 2 THEN 'slope' WHEN 3 THEN 'landslide' ELSE 'barrier_lake' END AS kind,
 85::DOUBLE + (s_suppkey * 37 % 1000)::DOUBLE / 1000::DOUBLE AS lon, 27.5::DOUBLE + (s_suppkey * 91 % 1000)::DOUBLE / 1000::DOUBLE AS lat, s_nationkey AS aoi,
 CASE WHEN s_acctbal >= 6000 THEN 'high' WHEN s_acctbal >= 3000 THEN 'medium' WHEN s_acctbal >= 0 THEN 'low' ELSE 'unknown' END AS level, s_acctbal AS z FROM supplier)"""


def assets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("name"), chosen(ASSET_KINDS, F.col("c_custkey") % 4).alias("kind"), *_placed("c_custkey"), (F.col("c_custkey") % 5 == 0).alias("at_channel"), F.col("c_nationkey").alias("aoi"), F.col("c_acctbal").alias("height_m")
    )


ASSETS = """asset AS (SELECT c_custkey AS asset_id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'town' WHEN 1 THEN 'bridge' WHEN 2 THEN 'hydropower' ELSE 'settlement' END AS kind,
 85::DOUBLE + (c_custkey * 37 % 1000)::DOUBLE / 1000::DOUBLE AS lon, 27.5::DOUBLE + (c_custkey * 91 % 1000)::DOUBLE / 1000::DOUBLE AS lat, c_custkey % 5 = 0 AS at_channel,
 c_nationkey AS aoi, c_acctbal AS height_m FROM customer)"""


def subscribers(spark, sf_dir) -> DataFrame:
    """Some want one area only (an empty list means all)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sub_id"),
        chosen(("low", "medium", "high"), F.col("p_partkey") % 3).alias("min_level"),
        F.when(F.col("p_size") % 2 == 0, F.array((F.col("p_partkey") % 25).cast("int"))).otherwise(F.array().cast("array<int>")).alias("aois"),
        (F.col("p_partkey") % 10 != 0).alias("active"),
        chosen(("en", "ne"), F.col("p_partkey") % 2).alias("language"),
    )


SUBS = """sub AS (SELECT p_partkey AS sub_id, CASE p_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS min_level,
 CASE WHEN p_size % 2 = 0 THEN [(p_partkey % 25)::INTEGER] ELSE []::INTEGER[] END AS aois, p_partkey % 10 <> 0 AS active, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'ne' END AS language FROM part)"""


def pixels(spark, sf_dir) -> DataFrame:
    """Each vector is a scene of 8 x 8 pixels."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene"), "label", F.posexplode("embedding").alias("pos", "v")).select(
        "scene", "label", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"), F.col("v").cast("double").alias("v")
    )


PIXELS = """px AS (SELECT scene, label, ((pos - 1) // 8)::INTEGER AS row, ((pos - 1) % 8)::INTEGER AS col, v::DOUBLE AS v FROM
 (SELECT vec_id AS scene, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""
