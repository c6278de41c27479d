"""Alerts that end by a timer, and the state that goes with them."""

from __future__ import annotations

import datetime as dt

import pytest
from scarp.streaming import jobs, lifecycle

HOUR = 3600_000_000
SCHEMA = "assessment_id long, site_id long, at long, level string, score double, dynamic double, needs_confirmation boolean, ts timestamp"


def row(k, site, hour, level, score=0.5):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    return (k, site, int(start.timestamp() * 1e6) + hour * HOUR, level, score, 0.5, False, (start + dt.timedelta(hours=hour)).replace(tzinfo=None))


def test_expiry_needs_no_further_row(spark, tmp_path):
    # Medium alerts expire after 168 h; sites 1 and 2 fall silent, site 3 goes on, site 4 holds a high alert.
    batches = [
        [row(1, 1, 0, "medium"), row(2, 2, 1, "medium"), row(3, 3, 1, "medium"), row(4, 4, 2, "high", 0.8)],
        [row(5, 3, 100, "medium", 0.9), row(6, 2, 100, "low", 0.1)],
        [row(7, 3, 300, "low", 0.1)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*")).withWatermark("ts", "1 hour")
    for k, v in lifecycle.ROCKS.items():
        spark.conf.set(k, v)
    query = jobs.started(lifecycle.alert_life(stream), "append", str(tmp_path / "run"))
    query.awaitTermination()
    for k in lifecycle.ROCKS:
        spark.conf.unset(k)
    got = spark.read.parquet(str(tmp_path / "run/out")).collect()
    start = batches[0][0][2]
    told = sorted((r["site_id"], (r["at"] - start) // HOUR, r["kind"], (r["available"] - start) // HOUR) for r in got)
    # Site 3's update at 100 h takes the place of its first alert, and expires at 268 h; the last row comes at 300 h.
    assert told == [(1, 0, "alert", 0), (1, 0, "expired", 168), (2, 1, "alert", 1), (2, 1, "expired", 169), (3, 1, "alert", 1), (3, 100, "expired", 268), (3, 100, "update", 100), (4, 2, "alert", 2)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > held[-1]  # only the high alert's state is left of four
    assert not any(r["status"] == "expired" and r["level"] == "high" for r in got)


def test_settings_hold_only_while_a_stream_starts(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.format("rate").load()
    with pytest.raises(Exception):  # nothing is aggregated, so it can't start
        jobs.run_to_table(stream, "complete", lifecycle.ROCKS)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
