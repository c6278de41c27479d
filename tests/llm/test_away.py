"""All queries of the subpackage where executors can't import this repository."""

from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op"):
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_queries_run_away_from_home(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", SCRIPT, home], cwd=tmp_path, env=env | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and done.stdout.count("ran ") >= 14, done.stdout[-500:] + done.stderr[-3000:]
