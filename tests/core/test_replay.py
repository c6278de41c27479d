"""Sweeps against single-time aggregates, replays in two times against a plain walk, and written reports."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from scarp.operators import alerts, replay, risk, sweep

HOUR = 3600_000_000
KINDS = ["lake_area", "velocity", "sar_change", "surface_change", "insar_los"]
OBS = "event_id long, site_id long, kind string, sensor string, observed_at timestamp_ntz, v double, se double, quality double, reference double, glacier_m double, turbidity double, coverage double, n_points int"


@pytest.fixture(scope="module")
def history(spark):
    """Two years of three sites, one of them with most rows, several rows at one time and nulls in between."""
    rng, rows, start = random.Random(3), [], dt.datetime(2023, 1, 1)
    for k in range(900):
        site = 1 if k % 3 else rng.choice([2, 3])
        at = start + dt.timedelta(hours=12 * rng.randrange(1500))
        none = lambda x: None if rng.random() < 0.1 else x
        rows.append((k, site, rng.choice(KINDS), rng.choice(["S1", "S2"]), at, none(rng.choice([0.0, 1.0, 2.0, rng.gauss(5, 3)])), none(rng.choice([0.0, 0.5, 1.0])), none(rng.random()), none(rng.choice([0.0, 4.0])), none(rng.random() * 900), none(rng.random()), none(rng.random()), none(rng.randrange(12))))
    return spark.createDataFrame(rows, OBS)


def test_sweep_agrees_with_aggregates(spark, history):
    w = risk.Windows(fracture_z=0.5, fracture_floor=0.5, min_z=0.5)
    at = [dt.datetime(2023, 1, 1) + dt.timedelta(days=d) for d in (0, 30, 200, 380, 401, 420, 500, 790, 1500)]
    times = spark.createDataFrame([(s, t) for s in (1, 2, 3, 4) for t in at], "site_id long, as_of timestamp_ntz")
    sites = spark.createDataFrame([(1, "glacial_lake", 30.0), (2, "glacier", 30.0), (3, "landslide", 10.0), (4, "slope", None)], "site_id long, site_kind string, slope double")
    sites = sites.withColumns({c: F.lit(None).cast("double") for c in ("walls", "glacier_m", "area")})
    for kind in ("glacial_lake", "glacier", "landslide"):
        found = {(r["site_id"], r["as_of"], r["feature"]): (r["x"], r["confidence"]) for r in sweep.site_features(history, times, sites.withColumn("site_kind", F.lit(kind)), w).collect()}
        assert len({k[:2] for k in found}) == 4 * len(at)
        some = 0
        for t in at:
            rows = risk.aged(history, F.lit(str(t)).cast("timestamp_ntz")).where(F.col("age") <= w.reach).join(sites.select("site_id", "slope"), "site_id")
            if kind == "glacial_lake":
                parts = [(risk.lake_features(rows, ["site_id"], w), {"growth_pct": "lake_growth_recent_pct", "annual_growth_pct": "lake_growth_annual_pct", "turbidity_rise": "turbidity_rise", "glacier_m": "glacier_contact_m"}, "confidence")]
            elif kind == "glacier":
                parts = [(risk.ice_features(rows, ["site_id"], w), {"speed": "velocity_m_day", "steep_speed": "velocity_steep_m_day", "z": "velocity_z", "ratio": "velocity_ratio", "trend": "velocity_trend"}, "confidence")]
                parts.append((risk.line_of_sight_features(rows, ["site_id"], w), {"mm_per_month": "insar_mm_month", "los_ratio": "insar_ratio"}, None))
                parts.append((risk.fracture_features(rows, ["site_id"], w), {"new_length": "new_fractures_m"}, None))
            else:
                parts = [(risk.landslide_features(rows, ["site_id"], w).withColumn("area", F.col("area") / 1e6), {"area": "landslide_area_km2"}, "confidence")]
            for frame, names, sure in parts:
                for r in frame.collect():
                    for own, name in names.items():
                        x, confidence = found[r["site_id"], t, name]
                        assert x == pytest.approx(r[own]) if r[own] is not None else x is None, (t, r, name, x)
                        assert sure is None or confidence == pytest.approx(r[sure])
                        some += x is not None
        assert some > 8


def test_decisions_at_what_is_known_then(spark):
    """A medium alert expires 168 h after its evidence: an assessment 164 h later is decided at 170 h, so it is a new one."""
    rows = [(k, 1, h * HOUR, level, score, 0.5, False) for k, (h, level, score) in enumerate([(0, "medium", 0.4), (164, "medium", 0.4), (200, "low", 0.1), (230, "medium", 0.45), (232, "medium", 0.55), (240, "high", 0.7), (258, "high", 0.85), (400, "low", 0.0)])]
    df = spark.createDataFrame(rows, "assessment_id long, site_id long, at long, level string, score double, dynamic double, needs_confirmation boolean")
    got = [(r["at"] // HOUR, r["available"] // HOUR, r["kind"], r["status"]) for r in replay.undispatched(df).orderBy("at").collect()]
    # 232 h is 68 h after the alert at 164 h, and decided at 74 h: over the 72 h of a cooldown. 258 h is decided 24 h after 240 h.
    assert got == [(0, 6, "alert", "pending_review"), (164, 170, "alert", "pending_review"), (232, 238, "update", "pending_review"), (240, 246, "alert", "pending_review"), (258, 264, "update", "pending_review")]
    at_once = [(r["at"] // HOUR, r["kind"]) for r in alerts.fold(df).orderBy("at").collect()]
    assert (164, "alert") not in at_once and (400, "all_clear") in at_once


def test_only_processed_scenes_and_no_rebuild_after_dispatch(spark, history):
    sites = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "site_id long, aoi long")
    seen = history.join(sites, "site_id").select("aoi", F.col("observed_at").alias("acquired_at"), F.when(F.col("event_id") % 2 == 0, "processed").otherwise("skipped").alias("status"))
    times = replay.assessment_times(history, seen, sites).collect()
    done = {(r["aoi"], r["acquired_at"]) for r in seen.where("status = 'processed'").collect()}
    own = {1: 7, 2: 7, 3: 8}
    assert {(r["site_id"], r["as_of"]) for r in times} == {(r["site_id"], r["observed_at"]) for r in history.collect() if (own[r["site_id"]], r["observed_at"]) in done}
    assert len(times) == len(set(times))
    stored = spark.createDataFrame([(1, "pending_review"), (2, "dispatched")], "alert_id long, status string")
    replay.refuse_dispatched(stored.where("alert_id = 1"))
    with pytest.raises(RuntimeError):
        replay.reassessed(history, seen, sites, sites, risk.Windows(), stored)


def test_summary_and_written_report(spark, tmp_path):
    events = spark.sql("SELECT 1L aoi, TIMESTAMP_NTZ'2024-03-01 12:00:00' event_at, 85.0D event_lon, 28.0D event_lat UNION ALL SELECT 2L, CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
    sites = spark.createDataFrame([(1, 1, "a", 85.001, 28.0), (2, 1, "b", 85.5, 28.0), (3, 2, "c", 85.0, 28.0)], "site_id long, aoi long, code string, lon double, lat double")
    at = lambda day, hour=0: int(dt.datetime(2024, 2, day, hour, tzinfo=dt.UTC).timestamp() * 1e6)
    told = spark.createDataFrame([(1, at(1), "medium", "alert", at(1, 6), "x"), (1, at(28), "high", "alert", at(28, 6), "x"), (2, at(20), "high", "alert", at(20, 6), "x"), (3, at(20), "high", "alert", at(20, 6), "x")], "site_id long, at long, level string, kind string, available long, status string")
    alert = replay.alert_rows(told, sites, events)
    assessed = told.select("site_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("as_of"), "at", "level", F.lit(0.5).alias("score"), F.lit("r").alias("reasons"))
    site = replay.site_rows(assessed, spark.createDataFrame([(1,), (1,)], "site_id long"), sites, spark.createDataFrame([(1, "Far", 9.0), (1, "Near", 2.0), (1, "", 1.0)], "site_id long, name string, minutes double"), events)
    change = replay.change_rows(spark.sql("SELECT 1L aoi, 'mass_movement' kind, TIMESTAMP_NTZ'2024-03-02 13:00:00' at, 85.01D lon, 28.0D lat, 60000.0D area_m2, 0.8D confidence UNION ALL SELECT 1L, 'mass_movement', TIMESTAMP_NTZ'2024-03-01 13:00:00', 85.0D, 28.0D, 60000.0D, 0.8D"), events)
    summed = replay.summary(site, alert, change, events)
    one, two = sorted(summed.collect())
    assert one.asDict() == {"aoi": 1, "alerts": 3, "warned": True, "lead_h": 702.0, "first_level": "medium", "highest_before": "medium", "elsewhere": 1, "elsewhere_medium": 0, "elsewhere_high": 1, "detected_after_h": 25.0}
    assert (two["alerts"], two["warned"], two["elsewhere"]) == (1, None, None)
    first = {r["code"]: r for r in site.collect()}
    assert first["a"]["places"] == "Near,Far" and first["a"]["observations"] == 2 and first["c"]["before_at"] is not None
    scenes = spark.createDataFrame([(1, "S1", "processed"), (1, "S2", "failed")], "aoi long, sensor string, status string")
    lines = replay.report_lines(summed, scenes, alert, change)
    for _ in range(2):  # a rerun replaces
        replay.write_report({"sites": site, "alerts": alert, "changes": change}, lines, str(tmp_path))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report" / "aoi=1").glob("*.txt")))
    assert text.startswith("# Replay of area 1\nScenes processed: 1 radar, 0 optical (0 skipped, 1 failed)\n- Warned before the event: yes, MEDIUM 702.0 h ahead\n") and "| 2024-02-28 06:00 | 54.0 | a | high | alert |" in text
    written = [json.loads(x) for p in (tmp_path / "alerts" / "aoi=1").glob("*.json") for x in p.read_text().splitlines()]
    assert len(written) == 3
