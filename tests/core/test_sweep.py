"""The sweep moves no arrays between tasks, and rows scored in place agree with long rows scored by key."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from scarp.operators import risk, sweep

OBS = "event_id long, site_id long, kind string, sensor string, observed_at timestamp_ntz, v double, se double, quality double, reference double, glacier_m double, turbidity double, coverage double, n_points int"
KINDS = {1: "glacial_lake", 2: "barrier_lake", 3: "glacier", 4: "landslide", 5: "unheard of"}
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    seen = ["lake_area", "velocity", "sar_change", "surface_change", "insar_los"]
    rows = [(k, rng.randrange(1, 7), rng.choice(seen), rng.choice(["S1", "S2"]), START + dt.timedelta(hours=rng.randrange(900)), rng.choice([None, rng.random() * 6e5]), rng.random(), rng.random(), None, 500.0, rng.random(), rng.random(), 9) for k in range(600)]
    obs = spark.createDataFrame(rows, OBS)
    sites = spark.createDataFrame([(s, kind, 30.0, 30.0, 400.0, 3e5) for s, kind in KINDS.items()], "site_id long, site_kind string, slope double, walls double, glacier_m double, area double")
    times = obs.select("site_id", F.col("observed_at").alias("as_of")).distinct()
    return obs, times, sites


def test_arrays_stay_in_their_task(spark, tables):
    """Sites that are too many to be sent to all tasks are joined before the arrays are made, not after."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sweep.site_features(*tables, risk.Windows())._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in plan and "Join" not in plan[: plan.rindex("collect_list")]


def test_rows_scored_in_place(spark, tables):
    obs, times, sites = tables
    keys = ["site_id", "as_of"]
    exposure = spark.createDataFrame([(1, 0.9), (3, 0.7), (4, 0.5)], "site_id long, exposure double")
    got = {(r.site_id, r.as_of): r for r in risk.assessed(obs, times, sites, exposure, risk.Windows()).collect()}
    long = sweep.site_features(obs, times, sites, risk.Windows())
    context = long.groupBy(*keys).agg(F.max("confidence").alias("confidence")).join(exposure, "site_id", "left").fillna(0.0, ["exposure"])
    want = risk.assess(risk.scores(long.drop("confidence"), risk.model_table(spark), keys), context, keys).collect()
    assert len(got) == len(want) == times.where("site_id < 5").count()
    for r in want:
        own = got[r.site_id, r.as_of]
        assert (own.level, own.needs_confirmation, own.alertable, own.reasons) == (r.level, r.needs_confirmation, r.alertable, r.reasons)
        assert [own[c] for c in ("hazard", "dynamic", "score", "exposure", "confidence")] == pytest.approx([r[c] for c in ("hazard", "dynamic", "score", "exposure", "confidence")])
    assert len({r.level for r in want}) == 3 and len({r.reasons for r in want}) > 5


def test_generated_methods_are_compiled(spark, tables):
    """The JVM interprets methods of more than 8,000 bytes."""
    exposure = spark.createDataFrame([(1, 0.9)], "site_id long, exposure double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = risk.assessed(*tables, exposure, risk.Windows())._jdf.queryExecution().executedPlan()
        code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert len(sizes) > 2 and max(sizes) < 8000, sizes


def test_ages_at_their_bounds(spark):
    """Both ends of an age are included, to the microsecond, and rows that are all too young are none."""
    now = START + dt.timedelta(days=100)
    micro = dt.timedelta(microseconds=1)
    at = [now, now - dt.timedelta(days=16), now - dt.timedelta(days=16) - micro, now - dt.timedelta(days=30), now - dt.timedelta(days=30) + micro]
    rows = [(k, 3, "velocity", "S1", t, float(k), 0.1, 0.9, None, 500.0, 0.1, 0.9, 9) for k, t in enumerate(at)]
    w = risk.Windows()
    seen = sweep.histories(spark.createDataFrame(rows, OBS), spark.createDataFrame([(3, now)], "site_id long, as_of timestamp_ntz"), ["site_id"], w)
    ages = {"recent": (0, w.recent), "old": w.fallback, "season": w.season, "all": (0, w.reach)}
    got = seen.select(*[F.array_sort(F.transform(sweep.aged("speeds", *x), lambda r: r["v"])).alias(k) for k, x in ages.items()]).first()
    assert (got.recent, got.old, got.season, got.all) == ([0.0, 1.0], [3.0], [], [0.0, 1.0, 2.0, 3.0, 4.0])
