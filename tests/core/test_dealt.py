"""Codes are numbered, and vertices are sought, in many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F
from scarp.operators import joins, tables


def test_codes_of_one_prefix_are_numbered_in_many_tasks(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("key"), F.when(F.col("id") % 10 > 0, "LS").when(F.col("id") % 20 > 0, "GL").alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = tables.numbered(df, F.col("p"), F.col("key"), existing=F.lit(3)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for prefix, n in (("LS", 36_000), ("GL", 2_000), (None, 2_000)):
        rows = sorted((r.key, r.code) for r in out if r.p == prefix)
        assert [c for _, c in rows] == [f"{prefix or 'null'}{k + 4:04d}" for k in range(n)]
    assert len({r.task for r in out if r.p == "LS"}) > 1


def test_vertices_are_not_broadcast(spark):
    path = spark.createDataFrame([(1, 85.0, 27.5, 0.0, 0.0), (2, 85.001, 27.5, 1.0, 0.0)], "path_id long, lon double, lat double, along_km double, z double")
    asset = spark.createDataFrame([(7, "town", "T", True, 3.0, 85.0, 27.5)], "asset_id long, kind string, name string, at_channel boolean, height_m double, lon double, lat double")
    found = joins.exposed_assets(path, asset, 1.5, 8.0)
    assert "SortMergeJoin [bx" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path_id, r.asset_id, r.offset_m) for r in found.collect())[0] == (1, 7, 0.0)
