"""Expired alerts are those of the SQL: ended by the watermark, or by a later row of their site that the watermark hasn't reached."""

from __future__ import annotations

import datetime as dt

import duckdb
from scarp.plans import streams

START, WEEK = dt.datetime(2024, 1, 1), dt.timedelta(hours=168)


def rows(last: dt.timedelta, *more):
    """A medium alert of user 1 at the start, and what is the newest row of all."""
    return [(5, START, 1, "view", 50.0, "{}"), (2, START + last, 2, "view", 0.0, "{}"), *more]


def compared(spark, path, events):
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    got = sorted(tuple(r) for r in streams.stream_expiries(spark, str(path)).collect())
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
        assert got == sorted(db.sql(streams.ORACLES["stream_expiries"]).fetchall())
    return [r[0] for r in got]


def test_a_later_row_of_the_site_ends_an_alert(spark, tmp_path):
    later = (3, START + WEEK + dt.timedelta(minutes=20), 1, "view", 0.0, "{}")
    assert compared(spark, tmp_path / "a", rows(WEEK + dt.timedelta(minutes=30), later)) == [5]
    assert compared(spark, tmp_path / "b", rows(WEEK + dt.timedelta(minutes=30))) == []


def test_the_watermark_ends_an_alert_to_the_millisecond(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    for k, (more, ended) in enumerate([(0, []), (999, []), (1000, [5]), (1999, [5]), (2000, [5])]):
        assert compared(spark, tmp_path / str(k), rows(WEEK + hour + dt.timedelta(microseconds=more))) == ended
