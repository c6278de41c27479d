"""Reads with arguments, and core queries where executors can't import this repository."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark.sql import functions as F
from scarp.operators import reads


def test_events_and_observations(spark):
    changes = spark.sql("SELECT id, IF(id % 2 = 0, 'slide', 'snow') kind, TIMESTAMP_NTZ'2024-01-01 05:00:00' + make_dt_interval(CAST(id AS INT)) at, id * 20000.0D area, id % 3 aoi FROM range(10)")
    day = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp_ntz")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(reads.events(changes, day(1), day(31))) == [9, 8, 7, 6, 5, 4, 3]
    assert ids(reads.events(changes, day(1), day(8), ["slide"], most=1)) == [6]
    assert ids(reads.events(changes, day(1), day(31), min_area=0, areas=[2])) == [8, 5, 2] and ids(reads.events(changes, day(1), day(31), kinds=[])) == []
    obs = changes.select(F.col("id").alias("event_id"), F.col("aoi").alias("site_id"), "kind", F.col("at").alias("observed_at"))
    got = reads.observations(obs, day(3), ["slide"], [0, 2]).collect()
    assert sorted((r["site_id"], r["place"], r["event_id"]) for r in got) == [(0, 1, 6), (2, 1, 2), (2, 2, 8)]


def test_texts(spark):
    good = '{"features":[{"geometry":{"coordinates":[85.1,28.2]},"properties":{"name":"A","kind":"town"}},{"geometry":{"coordinates":[1,2]},"properties":{"kind":"x"}}]}'
    df = spark.createDataFrame([(1, good), (2, "{}"), (3, None), (4, "{broken")], "aoi long, text string")
    assert [tuple(r) for r in reads.collected_features(df).collect()] == [(1, "town", "A", 85.1, 28.2)]
    assert [r["n"] for r in reads.readable_reports(spark.createDataFrame([('{"n": 3}',), ('{"n": ',)], "text string"), "n long").collect()] == [3]
    sites = spark.createDataFrame([(1, 85.0, 28.0, '{"lowest_point": [84.5, 27.5]}'), (2, 85.0, 28.0, "{}"), (3, 85.0, 28.0, None)], "site_id long, lon double, lat double, attrs string")
    assert [tuple(r) for r in reads.outlets(sites).orderBy("site_id").collect()] == [(1, 84.5, 27.5), (2, 85.0, 28.0), (3, 85.0, 28.0)]


def test_fields_and_baselines(spark):
    fields = spark.createDataFrame([(1, 10, 0, 5, 1, 90, 0.1), (1, 10, 0, 5, 2, 90, 0.1), (1, 10, -12, 5, 3, 90, 0.1), (1, 40, 20, 5, 4, 90, 0.1), (1, 41, 20, 5, 5, 90, 0.5), (2, 41, 20, 5, 6, 10, 0.1)], "tile long, day int, from_day int, orbit int, scene long, valid int, nmad double")
    kept = reads.kept_fields(fields, 50, 0.2)
    assert sorted((r["scene"], r["history"]) for r in reads.field_history(kept, 100, 18).collect()) == [(2, 0), (3, 0), (4, 2)]
    row = "id long, at int, v string"
    old, new = spark.createDataFrame([(1, 5, "old")], row), spark.createDataFrame([(1, 1, "new"), (2, 1, "new")], row)
    assert sorted(tuple(r) for r in reads.merged_baselines(old, new, keys=["id"], at="at").collect()) == [(1, 5, "old"), (2, 1, "new")]


SCRIPT = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
known = entry.queries()
for name in sys.argv[2].split(","):
    known[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""
#: Those with work in Python.
PYTHON = "median_filtered,lee_filtered,cast_shadows,highpassed,static_layers,offset_lattice,chip_offsets,tracked_nodes,bright_regions,region_outlines,flow_paths,thinned_paths,alert_decisions,stream_alerts,stream_expiries,reassessed_alerts,scene_mosaic"


def test_queries_run_away_from_home(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", SCRIPT, home, PYTHON], cwd=tmp_path, env=env | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and done.stdout.count("ran ") == PYTHON.count(",") + 1, done.stdout[-500:] + done.stderr[-3000:]
