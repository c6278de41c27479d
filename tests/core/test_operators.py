"""Hand-written truth tables and brute-force versions of the hazard operators."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from scarp.functions import scalars
from scarp.functions import scalars as S
from scarp.operators import alerts, joins, raster, risk, routing, stats, tables, terrain
from scarp.sources import catalogue

HOUR = 3600_000_000


def test_weighted_mean_drops_an_outlier(spark):
    df = spark.createDataFrame([(1, 0.05, 0.02), (1, 0.06, 0.02), (1, 0.04, 0.02), (1, 2.0, 0.02), (2, 1.0, 0.0), (2, None, 1.0)], "k int, v double, se double")
    got = {r.k: r for r in stats.weighted_mean(df, ["k"]).collect()}
    assert abs(got[1]["mean"] - 0.05) < 0.01 and got[1]["error"] < 0.02 and got[1]["n"] == 4
    assert got[2]["mean"] == 1.0 and got[2]["n"] == 1


def series(rows):
    t = dt.datetime(2026, 8, 24)
    return [(1, t - dt.timedelta(days=age), v, 0.02, orbit, f"p{i}") for i, (age, v, orbit) in enumerate(rows)]


@pytest.mark.parametrize(("recent", "orbits", "base", "fine"), [(0.12, (19, 85, 121), 0.005, True), (0.02, (19, 85, 121), 0.005, False), (0.12, (19, 19, 19), 0.005, False), (0.4, (19, 85, 121), 0.3, False)])
def test_speed_up_of_a_cell(spark, recent, orbits, base, fine):
    rows = series([(40 + 10 * k, base, (19, 85, 121)[k % 3]) for k in range(10)] + [(2 + 4 * k, recent, orbits[k]) for k in range(3)])
    df = spark.createDataFrame(rows, "cell int, pair_end timestamp_ntz, v double, se double, orbit int, pair_key string")
    got = stats.anomaly(df, ["cell"], F.lit("2026-08-24 00:00:00").cast("timestamp_ntz")).withColumn("fine", stats.significant()).collect()
    assert [r.fine for r in got] == [fine]


def test_last_summer_explains_this_one(spark):
    rows = [(100 + 10 * k, 0.01, 19) for k in range(5)] + [(2 + 4 * k, 0.12, (19, 85, 121)[k]) for k in range(3)]
    for past, fine in (((), True), ([(365 + d, 0.11, 19) for d in (-10, 0, 10)], False), ([(365 + d, 0.01, 19) for d in (-10, 0, 10)], True)):
        df = spark.createDataFrame(series([*rows, *past]), "cell int, pair_end timestamp_ntz, v double, se double, orbit int, pair_key string")
        got = stats.anomaly(df, ["cell"], F.lit("2026-08-24 00:00:00").cast("timestamp_ntz")).withColumn("fine", stats.significant()).collect()
        assert [r.fine for r in got] == [fine]


def test_ramp_and_levels(spark):
    rows = [(0.0, 1.0, 2.0, 0.0), (3.0, 1.0, 2.0, 1.0), (1.5, 1.0, 2.0, 0.5), (50.0, 1000.0, 50.0, 1.0), (1000.0, 1000.0, 50.0, 0.0), (1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, a double, b double, want double")
    assert all(r.got == r.want for r in df.withColumn("got", risk.ramp(F.col("x"), F.col("a"), F.col("b"))).collect())


def test_noisy_or(spark):
    indicators = spark.createDataFrame([("a", "fa", 0.0, 1.0, 0.8, True, None, 0.0, 0), ("b", "fb", 0.0, 1.0, 0.5, False, None, 0.0, 1), ("c", "fc", 0.0, 1.0, 0.9, True, "b", 0.1, 2)], risk.INDICATORS)
    long = spark.createDataFrame([(1, "fa", 1.0), (1, "fb", 0.5), (1, "fc", 1.0), (2, "fb", 1.0), (3, "fc", 1.0), (4, "fa", 1.0), (4, "fb", 1.0)], "k int, feature string, x double")
    context = spark.createDataFrame([(1, 1.0, 0.9), (2, 1.0, 0.9), (3, 0.0, 0.9), (4, 1.0, 0.1)], "k int, exposure double, confidence double")
    got = {r.k: r for r in risk.assess(risk.scores(long, indicators, ["k"]), context, ["k"]).collect()}
    assert got[1].hazard == pytest.approx(1 - 0.2 * 0.75 * 0.55) and got[1].level == "high" and got[1].reasons == "a,c,b"
    assert got[2].level == "medium" and not got[2].alertable
    assert got[3].hazard == pytest.approx(0.09) and got[3].level == "low"
    assert got[4].level == "medium" and got[4].needs_confirmation


def test_newest_run(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([9, 1, 9, 9])] + [(2, 0, 1)], "s int, t int, v int")
    assert {r.s: r.run for r in stats.newest_run(df, ["s"], "t", F.col("v") > 5).collect()} == {1: 2, 2: 0}


def test_spatial_and_temporal_joins(spark):
    rng = random.Random(1)
    boxes = [(i, x, y, x + rng.random() / 4, y + rng.random() / 4) for i in range(80) for x, y in [(rng.uniform(-2, 2), rng.uniform(-2, 2))]]
    df = spark.createDataFrame(boxes, "id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.l_id, r.r_id) for r in joins.box_join(df, df, 0.3).collect())
    assert got == sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    points = [(i, rng.uniform(85, 86), rng.uniform(27, 28)) for i in range(150)]
    p = spark.createDataFrame(points, "id int, lon double, lat double")
    near = {r.id: r.nearest for r in joins.nearest(p, p.withColumn("id", F.col("id") + 1000).where("id % 7 = 0"), 9.0, "id", "id").collect()}

    def km(a, b):
        return math.hypot((a[1] - b[1]) * 111.32 * math.cos(math.radians(a[2])), (a[2] - b[2]) * 110.57)

    for a in points:
        best = min((round(km(a, b), 9), b[0] + 1000) for b in points if (b[0] + 1000) % 7 == 0)
        assert near.get(a[0]) == (best[1] if best[0] < 9 else None)
    t0 = dt.datetime(2024, 1, 1)
    left = [(i, i % 3, t0 + dt.timedelta(hours=rng.randint(0, 400))) for i in range(60)]
    right = [(i, i % 3, t0 + dt.timedelta(hours=rng.randint(0, 400)), f"v{i}") for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, k int, t timestamp"), spark.createDataFrame(right, "rid int, k int, t timestamp, v string")
    pairs = sorted((r.l_id, r.r_rid) for r in joins.interval_join(a, b, ["k"], "t", 0, 2).collect())
    assert pairs == sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and dt.timedelta(0) <= x[2] - y[2] <= dt.timedelta(days=2))
    for r in joins.as_of(a, b, ["k"], "t", "v", "none").collect():
        before = [y for y in right if y[1] == r.k and y[2] <= r.t]
        assert r.v in ({y[3] for y in before if y[2] == max(z[2] for z in before)} if before else {"none"})


def test_alert_decisions_follow_the_table(spark):
    prev = {"level": "medium", "kind": "alert", "status": "dispatched", "at": 0, "expires": 168 * HOUR, "score": 0.5}
    d = alerts.decide
    assert d(None, "high", 0.7, 0.5, 0) == "alert" and d(None, "high", 0.7, 0.1, 0) is None
    assert d(prev, "high", 0.7, 0.5, HOUR) == "alert" and d(prev | {"level": "high"}, "medium", 0.5, 0.5, HOUR) == "update"
    assert d(prev, "medium", 0.7, 0.5, HOUR) is None and d(prev, "medium", 0.7, 0.5, 72 * HOUR) == "update" and d(prev, "medium", 0.55, 0.5, 72 * HOUR) is None
    assert d(prev, "low", 0.1, 0.5, HOUR) == "all_clear" and d(prev | {"status": "pending_review"}, "low", 0.1, 0.5, HOUR) is None
    assert alerts.live(prev, 169 * HOUR) is None and alerts.live(prev, 168 * HOUR) == prev and d(None, "medium", 0.5, 0.5, 169 * HOUR) == "alert"
    high = prev | {"level": "high"}
    assert alerts.live(high, 500 * HOUR) == high and d(high, "high", 0.7, 0.5, 500 * HOUR) == "update"
    assert d(prev, "unknown", 0.0, 0.0, HOUR) == "all_clear" and d(None, "unknown", 0.0, 0.0, 0) is None
    # What has expired is not linked to what comes after it.
    site = alerts.Site()
    row = {"assessment_id": 1, "site_id": 1, "at": 0, "level": "medium", "score": 0.5, "dynamic": 0.5, "needs_confirmation": False}
    first, second = site.see(row, ("high",)), site.see(row | {"assessment_id": 2, "at": 1000 * HOUR}, ("high",))
    assert first["kind"] == second["kind"] == "alert" and second["previous_level"] is None and second["superseded"] is None
    assert d(prev | {"kind": "all_clear"}, "medium", 0.4, 0.5, HOUR) == "alert"


def test_fold_in_batch_and_stream_agree(spark, tmp_path):
    from scarp.streaming import jobs

    rng = random.Random(2)
    rows = [(i, i % 5, i * 10 * HOUR, rng.choice(["low", "medium", "high"]), rng.random(), rng.random(), rng.random() < 0.2) for i in range(300)]
    schema = "assessment_id long, site_id long, at long, level string, score double, dynamic double, needs_confirmation boolean"
    df = spark.createDataFrame(rows, schema)
    batch = sorted(map(tuple, alerts.fold(df).collect()), key=lambda r: r[0])
    want = []
    sites = {}
    for r in rows:
        if new := sites.setdefault(r[1], alerts.Site()).see(dict(zip([c.split()[0] for c in schema.split(", ")], r)), ("high",)):
            want.append(tuple(new.values()))
    assert batch == want
    path = str(tmp_path / "in")
    for k in range(3):
        df.where(f"assessment_id div 100 = {k}").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.run_to_table(jobs.alert_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)))
    assert sorted(map(tuple, stream.select(df.sparkSession.createDataFrame([], alerts.DECIDED).columns).collect()), key=lambda r: r[0]) == want


def test_regions_and_routing(spark):
    rng = random.Random(3)
    on = [(0, r, c) for r in range(20) for c in range(20) if rng.random() < 0.45] + [(1, 0, c) for c in range(40)]
    got = {(s, r, c): label for s, r, c, label in map(tuple, raster.regions(spark.createDataFrame(on, "s int, row int, col int"), ["s"]).collect())}
    left, expect = set(on), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            s, r, c = todo.pop()
            group.append((s, r, c))
            for q in [(s, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        for q in group:
            expect[q] = min(r * (1 << 20) + c for _, r, c in group)
    assert got == expect
    z = np.add.outer(3000.0 - 5 * np.arange(60), 6 * np.abs(np.arange(60) - 30) ** 1.3)
    z[20:24] -= 40  # a pit across the valley
    walk = routing.descend(z, (2, 30), 30.0, 10.0)
    assert walk[-1][0] == 59 and all(abs(c - 30) <= 3 for _, c, _ in walk) and all(a[2] < b[2] for a, b in zip(walk, walk[1:]))


def test_offsets_find_a_shift():
    rng = np.random.default_rng(4)
    image = rng.normal(size=(64, 64))
    for _ in range(3):
        image = (image + np.roll(image, 1, 0) + np.roll(image, 1, 1)) / 3
    dr, dc, corr, snr = raster.peak_offset(image, np.roll(image, (3, -2), (0, 1)))
    assert abs(dr - 3) < 0.3 and abs(dc + 2) < 0.3 and corr > 0.5 and snr > 5


def test_tiles_cover_each_pixel_once(spark):
    areas = [(0, 530, 470), (1, 100, 40), (2, 200, 201), (3, 368, 369)]
    seen = {a: np.zeros((h, w), int) for a, h, w in areas}
    for t in terrain.tiles_of(spark.createDataFrame(areas, "area int, height int, width int"), 200, 32).collect():
        seen[t.area][t.core_r0 : t.core_r1, t.core_c0 : t.core_c1] += 1
        assert t.row <= t.core_r0 and t.core_r1 <= t.row + t.rows and t.col <= t.core_c0 and t.core_c1 <= t.col + t.cols
    assert all((x == 1).all() for x in seen.values())


def test_regions_across_blocks(spark, monkeypatch):
    """A long winding line, and noise, over many small blocks."""
    rng = random.Random(5)
    line = [(0, r, c) for r in range(0, 40, 2) for c in range(40)] + [(0, r, 39 if r % 4 == 1 else 0) for r in range(1, 39, 2)]
    noise = [(1, r, c) for r in range(40) for c in range(40) if rng.random() < 0.42]
    on = sorted({*line, *noise})
    plain = {tuple(r) for r in raster.regions(spark.createDataFrame(on, "s int, row int, col int"), ["s"]).collect()}
    assert {x[3] for x in plain if x[0] == 0} == {0}
    monkeypatch.setattr(raster, "BLOCK", 8)
    assert {tuple(r) for r in raster.regions(spark.createDataFrame(on, "s int, row int, col int"), ["s"]).collect()} == plain


def test_ways_out_of_pits():
    """The walk against one written step by step: floods from pits stop at the first way out that they touch."""
    import heapq

    def plain(z, start, most_km):
        h, w = z.shape
        r, c = start
        path, seen, km = [(r, c)], {(r, c)}, 0.0
        around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
        while km < most_km and 0 < r < h - 1 and 0 < c < w - 1:
            options = [((z[r, c] - z[r + a, c + b]) / (1.4142135 if a and b else 1), (r + a, c + b)) for a, b in around if (r + a, c + b) not in seen]
            top = max((d for d, _ in options), default=0)
            step = [next(p for d, p in options if d == top)] if top > 0 else []
            if not step:
                queue, back, out = [(z[r, c], (r, c))], {(r, c): None}, None
                while queue and out is None:
                    _, at = heapq.heappop(queue)
                    for a, b in around:
                        to = (at[0] + a, at[1] + b)
                        if to in back or not (0 <= to[0] < h and 0 <= to[1] < w):
                            continue
                        back[to] = at
                        if to[0] in (0, h - 1) or to[1] in (0, w - 1) or z[to] < z[r, c] and to not in seen:
                            out = to
                            break
                        heapq.heappush(queue, (z[to], to))
                while out is not None and out != (r, c):
                    step.insert(0, out)
                    out = back[out]
            if not step:
                break
            for p in step:
                km += 0.03 * (1.4142135 if p[0] != r and p[1] != c else 1)
                r, c = p
                path.append(p)
                seen.add(p)
        return path

    rng = np.random.default_rng(6)
    for k in range(30):
        z = rng.normal(size=(14, 12)).round(1 if k % 2 else 3)
        start = (int(rng.integers(1, 13)), int(rng.integers(1, 11)))
        assert [(r, c) for r, c, _ in routing.descend(z, start, 30.0, 2.0)] == plain(z, start, 2.0)


def test_nearest_at_any_latitude(spark):
    rng = random.Random(7)
    left = [(i, rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(60, 89)) for i in range(120)]
    right = [(i, rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(60, 89)) for i in range(400)]
    got = {r.a: r.nearest for r in joins.nearest(spark.createDataFrame(left, "a long, lon double, lat double"), spark.createDataFrame(right, "b long, lon double, lat double"), 20.0, "a", "b").collect()}
    for i, x, y in left:
        near = [(np.hypot((x - u) * 111.32 * np.cos(np.radians(y)), (y - v) * 110.57), j) for j, u, v in right]
        assert got.get(i) == (min(near)[1] if min(near)[0] < 20 else None)


def test_an_asset_on_two_paths(spark):
    path = spark.createDataFrame([(p, 85.0 + 0.001 * p, 27.0, 3.0 * p, 100.0) for p in (1, 2)], "path_id long, lon double, lat double, along_km double, z double")
    asset = spark.createDataFrame([(7, 85.0, 27.0, "town", "T", False, 110.0), (8, 85.0, 27.0, "town", "U", False, 900.0)], "asset_id long, lon double, lat double, kind string, name string, at_channel boolean, height_m double")
    got = sorted((r.path_id, r.asset_id, r.above_m) for r in joins.exposed_assets(path, asset, 1.5, 8.0).collect())
    assert got == [(1, 7, 10.0), (2, 7, 10.0)]


def test_keyed_table_goes_on_after_a_restart(spark, tmp_path):
    from scarp.streaming.jobs import KeyedTable

    schema = "k long, v long"
    of = lambda rows: spark.createDataFrame(rows, schema)
    make = lambda: KeyedTable(spark, str(tmp_path / "t"), ["k"], schema, 4)
    assert make().read().count() == 0
    make().merge(of([(i, 0) for i in range(20)]), 0)
    make().merge(of([(3, 1), (50, 1)]), 1)
    make().merge(of([(3, 1), (50, 1)]), 1)  # the batch runs again
    rows = {r.k: r.v for r in make().read().collect()}
    assert rows == {**{i: 0 for i in range(20)}, 3: 1, 50: 1}
    assert len(make().paths()) == 4 and len(list((tmp_path / "t/rows/1").glob("bucket=*"))) <= 2


def test_answers_and_times(spark):
    texts = ['<think>{"no": 1}</think>Here: ```json\n{"a": {"b": 1}}\n``` end', "{} x", "none", "} {", '{"a": 1'  ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.j for r in df.select(S.json_object(F.col("t")).alias("j")).collect()] == ['{"a": {"b": 1}}', "{}", None, None, None]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02 08:49:05+05:45",), ("2024-01-02 03:04:05",), ("soon",)], "t string")
    got = [r.m for r in times.select(F.unix_seconds(S.instant(F.col("t"))).alias("m")).collect()]
    assert got == [1704164645] * 3 + [None]


def test_scalars(spark):
    df = spark.createDataFrame([("2026-08-24 100", 6.2), ("no", 0.123), ("1,200 and 3.50 and 3.5", 37.9)], "s string, v double")
    got = df.select(scalars.nepali_digits(F.col("s")).alias("n"), scalars.short_number(F.col("v")).alias("t"), scalars.numbers_in(F.col("s")).alias("x"), scalars.ascii_digits(scalars.nepali_digits(F.col("s"))).alias("back"), "s").collect()
    assert [r.t for r in got] == ["6.2", "0.12", "38"] and got[2].x == ["1200", "3.5"] and all(r.back == r.s for r in got) and got[0].n.startswith("२०२६")
    one = spark.range(1).select(scalars.json_object(F.lit('<think>{"no":1}</think> text {"a": {"b": 1}} end')).alias("j"), scalars.split_list(F.lit('["x","y"]')).alias("l"), scalars.readable(F.lit("नेपाल")).alias("r"), scalars.readable(F.lit("山")).alias("q"), scalars.utm_zone(F.lit(85.3), F.lit(27.7)).alias("z"), scalars.platform_code(F.lit("sentinel-2c")).alias("p")).first()
    assert (one.j, one.l, one.r, one.q, one.z, one.p) == ('{"a": {"b": 1}}', ["x", "y"], True, False, 32645, "S2C")
    import hashlib

    key = spark.range(20).select(F.concat(F.lit("k"), "id").alias("k")).withColumn("share", scalars.split_share(F.col("k")))
    assert all(r.share == int(hashlib.sha1(r.k.encode()).hexdigest(), 16) % 1000 for r in key.collect())


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, first int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9)], "k int, v string, first int")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"], ["first"]).collect())) == [(1, "a", 1), (2, None, 2), (3, "c", 9)]
    assert {r.k: r.status for r in tables.changed(old, new, ["k"], ["v"]).collect()} == {1: "missing", 2: "updated", 3: "created"}


def test_catalogue(spark):
    names = spark.createDataFrame([("S1_20240102T000000_20240101T000000_X",), ("none",)], "n string")
    first, second = catalogue.product_times(F.col("n"))
    got = names.select(first.alias("a"), second.alias("b")).collect()
    assert got[0].a < got[0].b and got[1].a is None
    tags = spark.createDataFrame([({"place": "town", "amenity": "school"},), ({"bridge": "yes"},), ({"x": "y"},)], "t map<string,string>")
    assert [r.k for r in tags.select(catalogue.asset_kind(F.col("t")).alias("k")).collect()] == ["town", "bridge", None]


def test_robust_sd(spark):
    v = [1.0, 2.0, 4.0, 9.0, 30.0]
    m = statistics.median(v)
    got = stats.robust_sd(spark.createDataFrame([(1, x) for x in v], "k int, v double"), ["k"]).first()
    assert got.sd == pytest.approx(1.4826 * statistics.median(abs(x - m) for x in v))


def test_every_query_runs_and_has_stable_columns(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    from scarp.plans import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES)
    for name in ("weighted_mean_by_site", "spatial_match", "band_indices", "catalogue_search", "alert_messages", "stream_first"):
        assert registry.QUERIES[name](spark, entry.SMOKE_DIR).count() > 0
