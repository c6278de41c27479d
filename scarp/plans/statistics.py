"""Statistics, features and risk over the observation views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import risk, stats
from ..sources import views

AS_OF = "2024-01-30 00:00:00"
#: Line items end in 2001; the seasonal test looks back from here.
CELL_AS_OF = "2000-06-01 00:00:00"
#: Windows for a table of one month.
MONTH = risk.Windows(recent=8, compare=(9, 20), annual=(20, 29), glacier=29, season=(22, 26), fallback=(9, 21), event=10, history=29, min_z=1.0, fracture_z=1.0, fracture_floor=5.0)


def as_of(text=AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


def r6(sql: str) -> str:
    return ", ".join(f"round({n.strip()}, 6) AS {n.strip()}" for n in sql.split(","))


def settled_sql(sql: str) -> str:
    return ", ".join(f"floor({n.strip()} * 1000000 + 0.5001::DOUBLE) / 1000000 AS {n.strip()}" for n in sql.split(","))


def wm_sql(source: str, keys: str, value="v", error="se", clip="3.5", least="0.001", extra="") -> str:
    """CTE body of the clipped inverse-variance mean."""
    return f"""SELECT {keys}, sum(CASE WHEN used THEN {value} / (s * s) END) / sum(CASE WHEN used THEN 1 / (s * s) END) AS mean, 1 / sqrt(sum(CASE WHEN used THEN 1 / (s * s) END)) AS error, count(*) AS n{extra}
 FROM (SELECT *, keep OR sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}) < greatest(1, count(*) OVER (PARTITION BY {keys}) // 2) AS used FROM
 (SELECT *, abs({value} - median({value}) OVER (PARTITION BY {keys})) <= {clip} * s + 1e-9 AS keep FROM (SELECT *, greatest({error}, {least}) AS s FROM {source} WHERE {value} IS NOT NULL AND {error} IS NOT NULL)))
 GROUP BY {keys}"""


def weighted_mean_by_site(spark, sf):
    return stats.weighted_mean(views.observations(spark, sf), ["site_id", "kind"]).select("site_id", "kind", *six("mean", "error"), "n")


def robust_sd_by_site(spark, sf):
    return stats.robust_sd(views.observations(spark, sf), ["site_id", "kind"]).select("site_id", "kind", *six("sd"), "n")


def stacked_by_cell(spark, sf):
    return stats.stacked(views.cell_velocities(spark, sf), ["cell"], "orbit").select("cell", *six("mean", "error"), "n", "acquisitions")


def _periods(spark, sf):
    obs = views.observations(spark, sf)
    age = stats.age_days(F.col("observed_at"), as_of())
    return obs.withColumn("period", F.when((age >= 0) & (age <= 8), "recent").when((age > 8) & (age <= 30), "base"))


SPEEDUP_SQL = f"""part AS (SELECT *, CASE WHEN age >= 0 AND age <= 8 THEN 'recent' WHEN age > 8 AND age <= 30 THEN 'base' END AS period FROM
 (SELECT *, date_diff('microsecond', observed_at, TIMESTAMP '{AS_OF}') / 86400e6::DOUBLE AS age FROM obs)),
 mid AS (SELECT site_id, kind, median(v) AS m, count(*) AS c FROM part WHERE period = 'base' GROUP BY 1, 2),
 flo AS (SELECT p.site_id, p.kind, CASE WHEN max(c) >= 4 THEN 1.4826::DOUBLE * median(abs(v - m)) ELSE 0::DOUBLE END AS flo FROM part p JOIN mid USING (site_id, kind) WHERE period = 'base' GROUP BY 1, 2),
 rows_ AS (SELECT p.*, coalesce(flo, 0) AS flo, greatest(0.001::DOUBLE, coalesce(flo, 0)) AS least_ FROM part p LEFT JOIN flo USING (site_id, kind) WHERE period IS NOT NULL),
 each_ AS ({wm_sql("rows_", "site_id, kind, period", least="least_", extra=", count(DISTINCT orbit) AS acq, max(flo) AS flo")}),
 wide AS (SELECT site_id, kind, max(CASE WHEN period = 'recent' THEN mean END) AS v_recent, max(CASE WHEN period = 'recent' THEN error * sqrt(n / acq) END) AS se_recent,
 max(CASE WHEN period = 'base' THEN mean END) AS v_base, max(CASE WHEN period = 'base' THEN error * sqrt(n / acq) END) AS se_base, max(flo) AS floor,
 coalesce(max(CASE WHEN period = 'recent' THEN n END), 0) AS n_recent, coalesce(max(CASE WHEN period = 'base' THEN n END), 0) AS n_base FROM each_ GROUP BY 1, 2)"""


def speedup_test(spark, sf):
    out = stats.speedup(_periods(spark, sf), ["site_id", "kind"], "period", "orbit")
    return out.select("site_id", "kind", *six("v_recent", "se_recent", "v_base", "se_base", "floor", "z"), "n_recent", "n_base")


def seasonal_anomaly(spark, sf):
    cells = views.cell_velocities(spark, sf)
    out = stats.anomaly(cells, ["cell"], as_of(CELL_AS_OF), recent_days=40, half_season=30, fallback=(60, 300))
    return out.select("cell", *[stats.settled(F.col(c)).alias(c) for c in ("v_recent", "v_base", "z", "ratio")], "n_recent", "n_base", "orbits", stats.significant(z=0.5, ratio=1.0).alias("significant"))


SEASONAL_SQL = f"""WITH {views.CELLS}, aged AS (SELECT *, date_diff('microsecond', pair_end, TIMESTAMP '{CELL_AS_OF}') / 86400e6::DOUBLE AS age FROM cellv),
 seas AS (SELECT *, count(CASE WHEN age BETWEEN 335 AND 395 THEN 1 END) OVER (PARTITION BY cell) >= 2 AS seasonal FROM aged WHERE age >= 0 AND age <= 395),
 part AS (SELECT *, CASE WHEN age < 40 THEN 'recent' WHEN CASE WHEN seasonal THEN age BETWEEN 335 AND 395 ELSE age BETWEEN 60 AND 300 END THEN 'base' END AS period FROM seas),
 mid AS (SELECT cell, median(v) AS m, count(*) AS c FROM part WHERE period = 'base' GROUP BY 1),
 flo AS (SELECT p.cell, CASE WHEN max(c) >= 4 THEN 1.4826::DOUBLE * median(abs(v - m)) ELSE 0::DOUBLE END AS flo FROM part p JOIN mid USING (cell) WHERE period = 'base' GROUP BY 1),
 rows_ AS (SELECT p.*, coalesce(flo, 0) AS flo, greatest(0.001::DOUBLE, coalesce(flo, 0)) AS least_ FROM part p LEFT JOIN flo USING (cell) WHERE period IS NOT NULL),
 each_ AS ({wm_sql("rows_", "cell, period", least="least_", extra=", count(DISTINCT pair_key) AS acq, max(flo) AS flo")}),
 wide AS (SELECT cell, max(CASE WHEN period = 'recent' THEN mean END) AS v_recent, max(CASE WHEN period = 'recent' THEN error * sqrt(n / acq) END) AS se_recent,
 max(CASE WHEN period = 'base' THEN mean END) AS v_base, max(CASE WHEN period = 'base' THEN error * sqrt(n / acq) END) AS se_base, max(flo) AS floor,
 coalesce(max(CASE WHEN period = 'recent' THEN n END), 0) AS n_recent, coalesce(max(CASE WHEN period = 'base' THEN n END), 0) AS n_base FROM each_ GROUP BY 1),
 own AS ({wm_sql("(SELECT * FROM part WHERE period = 'recent')", "cell, orbit")}),
 sure AS (SELECT o.cell, count(*) AS orbits FROM own o JOIN wide w ON o.cell = w.cell WHERE round(mean - v_base, 9) > round(greatest(error, floor), 9) GROUP BY 1),
 done AS (SELECT w.*, (v_recent - v_base) / sqrt(se_recent * se_recent + se_base * se_base) AS z, v_recent / greatest(v_base, 0.03) AS ratio, coalesce(orbits, 0) AS orbits FROM wide w LEFT JOIN sure USING (cell) WHERE n_recent >= 2 AND n_base >= 2)
 SELECT cell, {settled_sql("v_recent, v_base, z, ratio")}, n_recent, n_base, orbits, round(z, 9) >= 0.5 AND round(v_recent, 9) >= 0.05 AND round(ratio, 9) >= 1.0 AND orbits >= 2 AS significant FROM done"""


def acceleration_run(spark, sf):
    obs = views.observations(spark, sf)
    return stats.newest_run(obs, ["site_id"], "event_id", F.col("v") > 40)


def obs_in_window(spark, sf):
    obs = views.observations(spark, sf)
    return obs.where(risk.in_window(F.col("observed_at"), as_of(), 2, 5)).select("event_id", "site_id", "kind", *six("v"))


def trusted_lake_area(spark, sf):
    obs = views.observations(spark, sf)
    fine = (F.col("kind") == "lake_area") & (F.col("quality") >= 0.8) & F.col("v").isNotNull() & risk.trustworthy(F.col("sensor"), F.col("v"), F.col("k").cast("double"))
    return obs.where(fine).select("event_id", "site_id", "sensor", *six("v"))


def lake_growth(spark, sf):
    out = risk.lake_features(_aged(spark, sf), ["site_id"], MONTH)
    return out.select("site_id", *six("growth_pct", "annual_growth_pct", "area", "glacier_m", "turbidity_rise", "confidence"))


def lake_sql(rows: str, keys: str) -> str:
    """CTEs ending in ``lake``."""
    med = lambda value, sensor, lo, hi: f"median(CASE WHEN sensor = '{sensor}' AND age BETWEEN {lo} AND {hi} THEN {value} END)"
    w = MONTH
    return f"""good AS (SELECT * FROM {rows} WHERE kind = 'lake_area' AND quality >= 0.8 AND v IS NOT NULL AND (sensor <> 'S1' OR coalesce(reference, 0) = 0 OR v >= 0.5::DOUBLE * reference)),
 lw AS (SELECT {keys}, nullif({med("v", "S2", 0, w.recent)}, 0) AS n2, nullif({med("v", "S2", *w.compare)}, 0) AS c2, nullif({med("v", "S2", *w.annual)}, 0) AS a2, nullif({med("v", "S1", 0, w.recent)}, 0) AS n1, nullif({med("v", "S1", *w.compare)}, 0) AS c1, nullif({med("v", "S1", *w.annual)}, 0) AS a1,
 arg_max(CASE WHEN sensor = 'S2' THEN v END, CASE WHEN sensor = 'S2' THEN (observed_at, event_id) END) AS l2, arg_max(CASE WHEN sensor = 'S1' THEN v END, CASE WHEN sensor = 'S1' THEN (observed_at, event_id) END) AS l1, count(CASE WHEN sensor = 'S2' THEN 1 END) AS k2,
 {med("glacier_m", "S2", 0, w.glacier)} AS glacier_m, {med("turbidity", "S2", 0, w.recent)} AS t1, {med("turbidity", "S2", *w.compare)} AS t0, avg(CASE WHEN age <= {w.recent} THEN quality END) AS seen FROM good GROUP BY {keys}),
 lg AS (SELECT *, coalesce(100 * (n2 - c2) / c2, 100 * (n1 - c1) / c1) AS growth_pct, coalesce(100 * (n2 - a2) / a2, 100 * (n1 - a1) / a1) AS annual_growth_pct, CASE WHEN k2 > 0 THEN coalesce(n2, nullif(l2, 0)) ELSE coalesce(n1, nullif(l1, 0)) END AS area, (t1 - t0) / abs(nullif(t0, 0)) AS turbidity_rise FROM lw),
 lake AS (SELECT {keys}, growth_pct, annual_growth_pct, area, glacier_m, turbidity_rise, least(1::DOUBLE, 0.2::DOUBLE + CASE WHEN seen IS NOT NULL THEN 0.35::DOUBLE + 0.2::DOUBLE * seen ELSE 0 END + CASE WHEN growth_pct IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END) AS confidence FROM lg)"""


AGED_SQL = f"aged AS (SELECT *, date_diff('microsecond', observed_at, TIMESTAMP '{AS_OF}') / 86400e6::DOUBLE AS age FROM obs WHERE observed_at <= TIMESTAMP '{AS_OF}')"
LAKE_SQL = f"{AGED_SQL}, {lake_sql('aged', 'site_id')}"


def _aged(spark, sf):
    return risk.aged(views.observations(spark, sf), as_of())


def event_area_sum(spark, sf):
    rows = _aged(spark, sf)
    out = risk.event_features(rows, ["site_id"], MONTH, "surface_change").join(risk.fracture_features(rows, ["site_id"], MONTH), "site_id", "left")
    return out.select("site_id", *six("area_sum", "area_max", "new_length"), "n_recent")


def event_sql(rows: str, keys: str, kind: str, name: str) -> str:
    return f"{name} AS (SELECT {keys}, sum(CASE WHEN kind = '{kind}' AND age <= {MONTH.event} THEN v END) AS area_sum, max(CASE WHEN kind = '{kind}' AND age <= {MONTH.event} THEN v END) AS area_max, count(CASE WHEN kind = '{kind}' AND age <= {MONTH.event} THEN v END) AS n_recent FROM {rows} GROUP BY {keys})"


def fracture_sql(rows: str, keys: str) -> str:
    """CTEs ending in ``crack``."""
    w = MONTH
    past = f"age BETWEEN {w.event} AND {w.history}"
    return f"""cm AS (SELECT {keys}, median(CASE WHEN {past} THEN v END) AS mid, count(CASE WHEN {past} THEN v END) AS nh, count(CASE WHEN age <= {w.event} THEN v END) AS nr FROM {rows} WHERE kind = 'surface_change' GROUP BY {keys}),
 cs AS (SELECT {keys}, max(mid) AS mid, max(nh) AS nh, max(nr) AS nr, 1.4826::DOUBLE * median(CASE WHEN {past} THEN abs(v - mid) END) + {w.fracture_floor}::DOUBLE AS scale FROM {rows} JOIN cm USING ({keys}) WHERE kind = 'surface_change' GROUP BY {keys}),
 ch AS (SELECT {keys}, count(*) AS high, max(v) AS top FROM {rows} JOIN cs USING ({keys}) WHERE kind = 'surface_change' AND age <= {w.event} AND (v - mid) / scale > {w.fracture_z} GROUP BY {keys}),
 crack AS (SELECT {keys}, CASE WHEN nh >= 4 AND nr >= 2 AND high >= 2 THEN top - mid END AS new_length FROM cs LEFT JOIN ch USING ({keys}))"""


EVENT_SQL = f"{event_sql('aged', 'site_id', 'surface_change', 'evs')}, {fracture_sql('aged', 'site_id')}, event_ AS (SELECT site_id, area_sum, area_max, n_recent, new_length FROM evs LEFT JOIN crack USING (site_id))"


def _facts(spark, sf):
    return views.site_facts(spark, sf)


def ice_speed(spark, sf):
    rows = risk.aged(views.monitored(spark, sf), as_of()).join(_facts(spark, sf).select("site_id", "slope"), "site_id")
    return risk.ice_features(rows, ["site_id"], MONTH).select("site_id", *[stats.settled(F.col(c)).alias(c) for c in ("seasonal", "speed", "steep_speed", "z", "ratio", "trend", "confidence")])


def ice_sql(rows: str, keys: str) -> str:
    """CTEs ending in ``ice``; ``rows`` hold the slope of the site."""
    w = MONTH
    return f"""vel0 AS (SELECT *, count(CASE WHEN age BETWEEN {w.season[0]} AND {w.season[1]} THEN 1 END) OVER (PARTITION BY {keys}) >= 2 AS seasonal FROM {rows} WHERE kind = 'velocity' AND v IS NOT NULL AND coverage >= 0.2 AND n_points >= 4),
 vel1 AS (SELECT *, CASE WHEN seasonal THEN age BETWEEN {w.season[0]} AND {w.season[1]} ELSE age BETWEEN {w.fallback[0]} AND {w.fallback[1]} END AS is_base FROM vel0),
 vel2 AS (SELECT *, CASE WHEN age <= {w.recent} THEN 'recent' WHEN is_base AND count(CASE WHEN is_base THEN 1 END) OVER (PARTITION BY {keys}) >= CASE WHEN seasonal THEN 2 ELSE {w.min_base} END THEN 'base' END AS period FROM vel1),
 vmid AS (SELECT {keys}, median(v) AS m, count(*) AS c FROM vel2 WHERE period = 'base' GROUP BY {keys}),
 vflo AS (SELECT {keys}, CASE WHEN max(c) >= 4 THEN 1.4826::DOUBLE * median(abs(v - m)) ELSE 0::DOUBLE END AS flo FROM vel2 JOIN vmid USING ({keys}) WHERE period = 'base' GROUP BY {keys}),
 vrow AS (SELECT vel2.*, coalesce(flo, 0) AS flo, greatest(0.001::DOUBLE, coalesce(flo, 0)) AS least_ FROM vel2 LEFT JOIN vflo USING ({keys}) WHERE period IS NOT NULL),
 veach AS ({wm_sql("vrow", f"{keys}, period", least="least_", extra=", count(DISTINCT observed_at) AS acq, max(flo) AS flo")}),
 vwide AS (SELECT {keys}, max(CASE WHEN period = 'recent' THEN mean END) AS vr, max(CASE WHEN period = 'recent' THEN error * sqrt(n / acq) END) AS sr, max(CASE WHEN period = 'base' THEN mean END) AS vb, max(CASE WHEN period = 'base' THEN error * sqrt(n / acq) END) AS sb, max(flo) AS flo FROM veach GROUP BY {keys}),
 vtest AS (SELECT *, (vr - vb) / sqrt(sr * sr + sb * sb) AS z FROM vwide WHERE vr IS NOT NULL AND vb IS NOT NULL),
 vplain AS ({wm_sql("(SELECT * FROM vel2 WHERE period = 'recent')", keys)}),
 vheld AS (SELECT {keys}, max(CASE WHEN seasonal THEN 1.0::DOUBLE ELSE 0 END) AS seasonal, max(slope) AS slope, avg(CASE WHEN age <= {w.recent} THEN coverage END) AS seen FROM vel2 GROUP BY {keys}),
 vrun AS (SELECT {keys}, count(CASE WHEN miss = 0 THEN 1 END) AS run FROM (SELECT {keys}, sum(CASE WHEN v - vb > 2 * greatest(se, flo) + {stats.NOISE} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY observed_at DESC) AS miss FROM vel2 JOIN vtest USING ({keys})) GROUP BY {keys}),
 vall AS (SELECT {keys}, seasonal, slope, seen, coalesce(vr, mean) AS speed, coalesce(sr, error) AS err, z, vb, run FROM vheld LEFT JOIN vplain USING ({keys}) LEFT JOIN vtest USING ({keys}) LEFT JOIN vrun USING ({keys})),
 ice AS (SELECT {keys}, seasonal, speed, CASE WHEN slope >= 25 AND speed > 3 * err + {stats.NOISE} THEN speed END AS steep_speed, z, CASE WHEN z >= {w.min_z} - {stats.NOISE} AND speed >= {w.min_speed} - {stats.NOISE} THEN speed / greatest(vb, 0.03) WHEN z IS NOT NULL THEN 1 END AS ratio,
 CASE WHEN z >= {w.min_z} - {stats.NOISE} AND speed >= {w.min_speed} - {stats.NOISE} THEN coalesce(run, 0)::DOUBLE WHEN z IS NOT NULL THEN 0 END AS trend, least(1::DOUBLE, 0.2::DOUBLE + CASE WHEN seen IS NOT NULL THEN 0.3::DOUBLE + 0.2::DOUBLE * seen ELSE 0 END + CASE WHEN vb IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END) AS confidence FROM vall)"""


MON_AGED = f"{views.MONITORED}, {views.SITES}, {views.FACTS}, maged AS (SELECT mon.*, slope, date_diff('microsecond', observed_at, TIMESTAMP '{AS_OF}') / 86400e6::DOUBLE AS age FROM mon JOIN fact USING (site_id) WHERE observed_at <= TIMESTAMP '{AS_OF}')"


def insar_speedup(spark, sf):
    rows = risk.aged(views.monitored(spark, sf), as_of()).join(_facts(spark, sf).select("site_id"), "site_id")
    return risk.line_of_sight_features(rows, ["site_id"], MONTH).select("site_id", *six("z", "mm_per_month", "los_ratio"))


def insar_sql(rows: str, keys: str) -> str:
    """CTEs ending in ``los``."""
    w = MONTH
    return f"""los0 AS (SELECT *, count(CASE WHEN age BETWEEN {w.season[0]} AND {w.season[1]} THEN 1 END) OVER (PARTITION BY {keys}) >= 2 AS seasonal FROM {rows} WHERE kind = 'insar_los' AND coverage >= 0.3),
 los1 AS (SELECT *, 'recent' AS period FROM los0 WHERE age <= {2 * w.recent} UNION ALL SELECT *, 'base' FROM los0 WHERE CASE WHEN seasonal THEN age BETWEEN {w.season[0]} AND {w.season[1]} ELSE age BETWEEN {w.fallback[0]} AND {w.fallback[1]} END),
 los2 AS ({wm_sql("los1", f"{keys}, period", least="1e-6")}),
 los3 AS (SELECT {keys}, max(CASE WHEN period = 'recent' THEN mean END) AS mr, max(CASE WHEN period = 'recent' THEN error END) AS er, max(CASE WHEN period = 'recent' THEN n END) AS nr, max(CASE WHEN period = 'base' THEN mean END) AS mb, max(CASE WHEN period = 'base' THEN error END) AS eb, max(CASE WHEN period = 'base' THEN n END) AS nb FROM los2 GROUP BY {keys}),
 los4 AS (SELECT *, abs(mr - mb) / sqrt(er * er + eb * eb) AS z FROM los3 WHERE nb >= 2 AND nr IS NOT NULL),
 los AS (SELECT {keys}, z, abs(mr) * 30000 AS mm_per_month, CASE WHEN z >= {w.min_z} AND abs(mr) >= 5e-4 THEN abs(mr) / greatest(abs(mb), 3e-4) END AS los_ratio FROM los4)"""


def landslide_latest(spark, sf):
    return risk.landslide_features(_aged(spark, sf), ["site_id"], MONTH).select("site_id", *six("area", "confidence"))


def risk_level(spark, sf):
    obs = views.observations(spark, sf)
    x = risk.ramp(F.col("v"), F.lit(10.0), F.lit(90.0))
    return obs.select("event_id", *[c.alias(n) for n, c in (("up", F.round(x, 6)), ("down", F.round(risk.ramp(F.col("v"), F.lit(90.0), F.lit(10.0)), 6)), ("step", risk.ramp(F.col("v"), F.lit(50.0), F.lit(50.0))))], risk.level_for(x).alias("level"))


def confusion_iou(spark, sf):
    return stats.confusion(views.table(spark, sf, "labels"), "quality", "toxic").withColumn("iou", F.round("iou", 6))


def chart_means(spark, sf):
    """Velocity of a day over all sites, weighted by errors; a missing or zero error counts as 0.05."""
    s = F.coalesce(F.nullif(F.col("se"), F.lit(0.0)), F.lit(0.05))
    rows = views.observations(spark, sf).where("kind = 'velocity'").withColumn("w", 1 / (s * s))
    return rows.groupBy(F.to_date("observed_at").cast("string").alias("day")).agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 6).alias("v"), F.round(1 / F.sqrt(F.sum("w")), 6).alias("se"))


def stats_grouping_sets(spark, sf):
    """Counts by level and by kind in one pass."""
    sites = views.sites(spark, sf)
    return sites.groupingSets([[F.col("level")], [F.col("kind")]], "level", "kind").agg(F.count("*").alias("n"))


def running_history(spark, sf):
    """Mean of the trailing 7 days of each site and kind, and the distance to the value before."""
    by = Window.partitionBy("site_id", "kind").orderBy(F.unix_micros(F.col("observed_at").cast("timestamp")))
    week = by.rangeBetween(-7 * 86400 * 1_000_000, 0)
    before = Window.partitionBy("site_id", "kind").orderBy("observed_at", "event_id")
    return views.observations(spark, sf).select("event_id", F.round(F.avg("v").over(week), 6).alias("week_mean"), F.count("*").over(week).alias("week_n"), F.round(F.col("v") - F.lag("v").over(before), 6).alias("step"))


QUERIES = {f.__name__: f for f in (weighted_mean_by_site, robust_sd_by_site, stacked_by_cell, speedup_test, seasonal_anomaly, acceleration_run, obs_in_window, trusted_lake_area, lake_growth, event_area_sum, ice_speed, insar_speedup, landslide_latest, risk_level, confusion_iou, chart_means, stats_grouping_sets, running_history)}
ORACLES = {
    "weighted_mean_by_site": f"WITH {views.OBS}, x AS ({wm_sql('obs', 'site_id, kind')}) SELECT site_id, kind, {r6('mean, error')}, n FROM x",
    "robust_sd_by_site": f"WITH {views.OBS}, m AS (SELECT *, abs(v - median(v) OVER (PARTITION BY site_id, kind)) AS d FROM obs) SELECT site_id, kind, round(1.4826::DOUBLE * median(d), 6) AS sd, count(v) AS n FROM m GROUP BY 1, 2",
    "stacked_by_cell": f"WITH {views.CELLS}, x AS ({wm_sql('cellv', 'cell', extra=', count(DISTINCT orbit) AS acquisitions')}) SELECT cell, round(mean, 6) AS mean, round(error * sqrt(n / acquisitions), 6) AS error, n, acquisitions::INTEGER AS acquisitions FROM x",
    "speedup_test": f"WITH {views.OBS}, {SPEEDUP_SQL}, z_ AS (SELECT *, (v_recent - v_base) / sqrt(se_recent * se_recent + se_base * se_base) AS z FROM wide) SELECT site_id, kind, {r6('v_recent, se_recent, v_base, se_base, floor, z')}, n_recent, n_base FROM z_",
    "seasonal_anomaly": SEASONAL_SQL,
    "acceleration_run": f"WITH {views.OBS} SELECT site_id, count(CASE WHEN miss = 0 THEN 1 END) AS run FROM (SELECT site_id, sum(CASE WHEN v > 40 THEN 0 ELSE 1 END) OVER (PARTITION BY site_id ORDER BY event_id DESC) AS miss FROM obs) GROUP BY 1",
    "obs_in_window": f"WITH {views.OBS} SELECT event_id, site_id, kind, round(v, 6) AS v FROM obs WHERE date_diff('microsecond', observed_at, TIMESTAMP '{AS_OF}') / 86400e6::DOUBLE BETWEEN 2 AND 5",
    "trusted_lake_area": f"WITH {views.OBS} SELECT event_id, site_id, sensor, round(v, 6) AS v FROM obs WHERE kind = 'lake_area' AND quality >= 0.8 AND v IS NOT NULL AND (sensor <> 'S1' OR coalesce(k, 0) = 0 OR v >= 0.5::DOUBLE * k)",
    "lake_growth": f"WITH {views.OBS}, {LAKE_SQL} SELECT site_id, {r6('growth_pct, annual_growth_pct, area, glacier_m, turbidity_rise, confidence')} FROM lake",
    "event_area_sum": f"WITH {views.OBS}, {AGED_SQL}, {EVENT_SQL} SELECT site_id, {r6('area_sum, area_max, new_length')}, n_recent FROM event_",
    "ice_speed": f"WITH {MON_AGED}, {ice_sql('maged', 'site_id')} SELECT site_id, {settled_sql('seasonal, speed, steep_speed, z, ratio, trend, confidence')} FROM ice",
    "insar_speedup": f"WITH {MON_AGED}, {insar_sql('maged', 'site_id')} SELECT site_id, {r6('z, mm_per_month, los_ratio')} FROM los",
    "landslide_latest": f"WITH {views.OBS} SELECT site_id, round(max(v), 6) AS area, round(least(0.8::DOUBLE, 0.3::DOUBLE + 0.2::DOUBLE * least(count(*), 2) + CASE WHEN max(quality) >= 0.8 THEN 0.1::DOUBLE ELSE 0 END), 6) AS confidence FROM obs WHERE kind = 'sar_change' AND date_diff('microsecond', observed_at, TIMESTAMP '{AS_OF}') / 86400e6::DOUBLE BETWEEN 0 AND 10 GROUP BY 1",
    "risk_level": f"WITH {views.OBS}, r AS (SELECT event_id, v, greatest(0, least(1, (v - 10) / 80::DOUBLE)) AS up, greatest(0, least(1, (v - 90) / -80::DOUBLE)) AS down FROM obs) SELECT event_id, round(up, 6) AS up, round(down, 6) AS down, CASE WHEN v >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS step, CASE WHEN up >= 0.6 THEN 'high' WHEN up >= 0.35 THEN 'medium' ELSE 'low' END AS level FROM r",
    "confusion_iou": "WITH c AS (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels WHERE quality <> 255 GROUP BY 1, 2) SELECT truth, predicted, n, round(CASE WHEN truth = predicted THEN n / (sum(n) OVER (PARTITION BY truth) + sum(n) OVER (PARTITION BY predicted) - n) END, 6) AS iou FROM c",
    "chart_means": f"WITH {views.OBS}, r AS (SELECT *, 1 / (coalesce(nullif(se, 0), 0.05) ** 2) AS w FROM obs WHERE kind = 'velocity') SELECT strftime(observed_at, '%Y-%m-%d') AS day, round(sum(w * v) / sum(w), 6) AS v, round(1 / sqrt(sum(w)), 6) AS se FROM r GROUP BY 1",
    "stats_grouping_sets": f"WITH {views.SITES} SELECT level, kind, count(*) AS n FROM site GROUP BY GROUPING SETS ((level), (kind))",
    "running_history": f"WITH {views.OBS} SELECT event_id, round(avg(v) OVER (PARTITION BY site_id, kind ORDER BY observed_at RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW), 6) AS week_mean, count(*) OVER (PARTITION BY site_id, kind ORDER BY observed_at RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS week_n, round(v - lag(v) OVER (PARTITION BY site_id, kind ORDER BY observed_at, event_id), 6) AS step FROM obs",
}
