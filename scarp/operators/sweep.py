"""Features of all sites at all times from one sweep over each site's slots of time.

Observations and the times that ask for them are one stream, grouped once by site and slot. Each time gets the rows of its
group that it can see, by kind, as arrays: no row is joined with the times that see it, so what is shuffled is the
observations (twice: a site's history is cut into slots as long as the reach, and a slot also holds the one before, so
a site with a third of all rows is many groups) and the times, with what is known of their site; arrays stay in their
tasks. Medians, robust means and tests of several windows of age are then expressions over these arrays. They agree with the
aggregates of ``risk``, which score sites at a single time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .risk import ICE, LAKES, SLIDES, Windows, trustworthy
from .stats import MAD_SCALE, NOISE

DAY = 86400e6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields(rows: Column, name: str) -> Column:
    return F.filter(F.transform(rows, lambda x: x[name]), lambda v: v.isNotNull())


def median(values: Column) -> Column:
    """Of an array without nulls; null if it is empty."""
    mid = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, mid(s)))


def mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))


def spread(values: Column, middle: Column) -> Column:
    """Median distance from ``middle``, a bound value."""
    return median(F.transform(values, lambda v: F.abs(v - middle)))


def robust_mean(rows: Column, least: Column, clip: float = 3.5) -> Column:
    """(mean, error, n) of rows (v, se) by inverse variances, as ``stats.weighted_mean`` has it; null without rows. ``least``
    is a bound value."""
    known = F.filter(rows, lambda x: x["v"].isNotNull() & x["se"].isNotNull())
    error = lambda x: F.greatest(x["se"], least)

    def summed(r: Column, used: Column) -> Column:
        weight = lambda x: 1 / (error(x) * error(x))
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wv"))
        sums = F.aggregate(used, start, lambda a, x: F.struct((a["w"] + weight(x)).alias("w"), (a["wv"] + weight(x) * x["v"]).alias("wv")))
        return let(sums, lambda s: F.struct((s["wv"] / s["w"]).alias("mean"), (1 / F.sqrt(s["w"])).alias("error"), F.size(r).alias("n")))

    def clipped(r: Column, middle: Column) -> Column:
        near = F.filter(r, lambda x: F.abs(x["v"] - middle) <= clip * error(x) + 1e-9)
        return let(near, lambda k: F.when(F.size(k) < F.greatest(F.lit(1), F.floor(F.size(r) / 2)), r).otherwise(k))

    return let(known, lambda r: F.when(F.size(r) > 0, let(median(fields(r, "v")), lambda m: let(clipped(r, m), lambda used: summed(r, used)))))


def stacked(rows: Column, least: Column) -> Column:
    """``robust_mean`` with the error widened for rows that share a time."""
    times = F.size(F.array_distinct(F.transform(F.filter(rows, lambda x: x["v"].isNotNull() & x["se"].isNotNull()), lambda x: x["at"])))
    return let(robust_mean(rows, least), lambda m: F.when(m.isNotNull(), F.struct(m["mean"].alias("mean"), (m["error"] * F.sqrt(m["n"] / times)).alias("error"), m["n"].alias("n"))))


def kinds_of_rows(w: Windows) -> dict[str, tuple[Column, list]]:
    """What counts of each kind of observation, and the columns that its features need."""
    kind = lambda k: F.col("kind") == k
    good = kind("lake_area") & (F.col("quality") >= w.min_quality) & F.col("v").isNotNull() & trustworthy(F.col("sensor"), F.col("v"), F.col("reference"))
    fine = kind("velocity") & F.col("v").isNotNull() & (F.col("coverage") >= 0.2) & (F.col("n_points") >= 4)
    return {
        "lake": (good, ["event_id", "sensor", "v", "quality", "glacier_m", "turbidity"]),
        "changes": (kind("sar_change"), ["v", "quality"]),
        "cracks": (kind("surface_change"), ["v"]),
        "speeds": (fine, ["v", F.coalesce(F.nullif(F.col("se"), F.lit(0.0)), F.lit(0.05)).alias("se"), "coverage"]),
        "sight": (kind("insar_los") & (F.col("coverage") >= 0.3), ["v", "se"]),
    }


def histories(obs: DataFrame, times: DataFrame, keys: list[str], w: Windows) -> DataFrame:
    """``times`` (keys, as_of, all different; other columns stay) with an array of what each can see, by kind, in order of
    time, and ``now``. ``obs`` has the keys, observed_at and the columns of ``kinds_of_rows``."""
    width = int(w.reach * DAY)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = F.floor(F.col("at") / width).cast("long")
    kinds = kinds_of_rows(w)
    cases = [F.when(on, F.struct("at", *columns)).alias(k) for k, (on, columns) in kinds.items()]
    asked = F.struct(micros("as_of").alias("now"), *[c for c in times.columns if c not in keys])
    asks = times.where(F.col("as_of").isNotNull()).withColumn("at", micros("as_of")).select(*keys, slot.alias("slot"), asked.alias("ask"))
    seen = obs.withColumn("at", micros("observed_at")).select(*keys, F.explode(F.array(slot, slot + 1)).alias("slot"), *cases)
    seen = seen.where(F.coalesce(*[F.col(f"{k}.at") for k in kinds]).isNotNull())
    both = seen.unionByName(asks, allowMissingColumns=True).groupBy(*keys, "slot").agg(*[F.sort_array(F.collect_list(k)).alias(k) for k in kinds], F.collect_list("ask").alias("asks"))
    each = both.select(*keys, *kinds, F.explode("asks").alias("ask")).select(*keys, *kinds, "ask.*")
    return each.withColumns(bounds(w)).withColumns({k: aged(k, 0, w.reach) for k in kinds})


def bound(age: float, side: str) -> str:
    """The column with the first or last time of an age in days."""
    return f"_{side}_{age:g}".replace(".", "_")


def bounds(w: Windows) -> dict[str, Column]:
    """First and last times of all ages that features ask for, so that they are found once a time, not once for each row
    that is looked at."""
    ages = {float(a) for a in (0, w.recent, 2 * w.recent, *w.compare, *w.annual, *w.season, *w.fallback, w.glacier, w.event, w.history, w.reach)}
    return {bound(a, side): F.col("now") - F.lit(cut(a * DAY)) for a in sorted(ages) for side, cut in (("first", math.floor), ("last", math.ceil))}


def aged(name: str, low: float, high: float, also: Callable[[Column], Column] | None = None) -> Column:
    """Rows of a kind from one age in days to another, both included, and for which ``also`` holds. Rows are in order of time,
    so none is looked at if the oldest is too young."""
    first, last = F.col(bound(high, "first")), F.col(bound(low, "last"))
    within = lambda x: (x["at"] >= first) & (x["at"] <= last)
    return F.when(F.get(name, F.lit(0))["at"] <= last, F.filter(F.col(name), within if also is None else lambda x: within(x) & also(x))).otherwise(F.slice(name, 1, 0))


def known(name: str, low: float, high: float, field: str, sensor: str | None = None) -> Column:
    """Values of a field, without nulls, of the rows of an age (and sensor)."""
    has = lambda x: x[field].isNotNull()
    return F.transform(aged(name, low, high, has if sensor is None else lambda x: (x["sensor"] == sensor) & has(x)), lambda x: x[field])


def lake_columns(w: Windows) -> dict[str, Column]:
    spans = {"now": (0, w.recent), "cmp": w.compare, "ann": w.annual}
    zero = lambda c: F.nullif(c, F.lit(0.0))
    out = {f"{k}_{s}": zero(median(known("lake", *x, "v", s))) for s in ("S1", "S2") for k, x in spans.items()}
    out |= {f"last_{s}": F.array_max(F.transform(F.filter("lake", lambda x: x["sensor"] == s), lambda x: F.struct(x["at"].alias("at"), x["event_id"].alias("event_id"), x["v"].alias("v")))) for s in ("S1", "S2")}
    out |= {"ice": median(known("lake", 0, w.glacier, "glacier_m", "S2"))}
    out |= {k: median(known("lake", *spans[x], "turbidity", "S2")) for k, x in (("dirt", "now"), ("dirt0", "cmp"))}
    return out | {"seen": mean(known("lake", 0, w.recent, "quality"))}


def lake_features(w: Windows) -> tuple[dict[str, Column], dict[str, Column]]:
    """Two steps of columns; null without a good area."""

    def growth(to: str) -> Column:
        return F.coalesce(*[100 * (F.col(f"now_{s}") - F.col(f"{to}_{s}")) / F.col(f"{to}_{s}") for s in ("S2", "S1")])

    def area_of(s: str) -> Column:
        return F.coalesce(f"now_{s}", F.nullif(F.col(f"last_{s}.v"), F.lit(0.0)))

    sure = 0.2 + F.when(F.col("seen").isNotNull(), 0.35 + 0.2 * F.col("seen")).otherwise(0.0) + F.when(growth("cmp").isNotNull(), 0.25).otherwise(0.0)
    area = F.when(F.col("last_S2").isNotNull(), area_of("S2")).otherwise(area_of("S1"))
    some = F.exists("lake", lambda x: F.lit(True))  # see ``features``
    return lake_columns(w), {
        "growth_pct": growth("cmp"), "annual_growth_pct": growth("ann"), "lake_area": F.when(some, area), "glacier_seen_m": F.col("ice"),
        "turbidity_rise": (F.col("dirt") - F.col("dirt0")) / F.abs(F.nullif(F.col("dirt0"), F.lit(0.0))), "lake_confidence": F.when(some, F.least(F.lit(1.0), sure)),
    }


def crack_length(w: Windows) -> Column:
    """Length by which new cracks exceed a site's own history, where both have enough rows."""

    def told(past: Column, now: Column, mid: Column) -> Column:
        scale = MAD_SCALE * spread(past, mid) + w.fracture_floor
        high = let(scale, lambda s: F.filter(now, lambda x: F.try_divide(x - mid, s) > w.fracture_z))
        return let(high, lambda h: F.when(F.size(h) >= 2, F.array_max(h) - mid))

    past, now = known("cracks", w.event, w.history, "v"), known("cracks", 0, w.event, "v")
    return let(past, lambda p: F.when(F.size(p) >= 4, let(now, lambda n: F.when(F.size(n) >= 2, let(median(p), lambda m: told(p, n, m))))))


def based(name: str, w: Windows, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the rows of the baseline (the season a year before if it has two rows, else the recent past) and of whether
    it is seasonal."""
    season = aged(name, *w.season)
    return let(season, lambda s: let(F.size(s) >= 2, lambda is_season: let(F.when(is_season, s).otherwise(aged(name, *w.fallback)), lambda base: body(base, is_season))))


def speed_test(w: Windows) -> Column:
    """(seasonal, v_recent, se_recent, v_base, floor, z, plain_v, plain_se, run, seen) of speeds; null without any."""
    old = F.col(bound(w.recent, "first"))

    def tested(base: Column, seasonal: Column) -> Column:
        enough = F.size(base) >= F.when(seasonal, 2).otherwise(w.min_base)
        own = F.when(enough, F.filter(base, lambda x: x["at"] < old)).otherwise(F.slice(base, 1, 0))
        floor = lambda b: let(median(fields(b, "v")), lambda m: F.when(F.size(b) >= 4, MAD_SCALE * spread(fields(b, "v"), m)).otherwise(0.0))
        return let(own, lambda b: let(floor(b), lambda f: let(F.greatest(F.lit(1e-3), f), lambda least: let(aged("speeds", 0, w.recent), lambda recent: facts(recent, b, f, least, seasonal)))))

    def facts(recent: Column, base: Column, floor: Column, least: Column, seasonal: Column) -> Column:
        """The test where there is a baseline, the plain mean elsewhere; neither is found where the other is told."""
        return let(stacked(base, least), lambda b: let(F.when(b.isNotNull(), stacked(recent, least)), lambda r: let(F.when(r.isNull(), robust_mean(recent, F.lit(1e-3))), lambda p: F.struct(
            seasonal.alias("seasonal"), r["mean"].alias("v_recent"), r["error"].alias("se_recent"), b["mean"].alias("v_base"), floor.alias("floor"),
            F.try_divide(r["mean"] - b["mean"], F.hypot(r["error"], b["error"])).alias("z"), p["mean"].alias("plain_v"), p["error"].alias("plain_se"),
            F.when(r.isNotNull(), run(b["mean"], floor)).alias("run"), mean(fields(recent, "coverage")).alias("seen"),
        ))))

    def run(v_base: Column, floor: Column) -> Column:
        """Rows from the newest back to the first that isn't fast; rows of one time go together."""
        slow = F.filter(F.col("speeds"), lambda x: ~(x["v"] - v_base > 2 * F.greatest(x["se"], floor) + NOISE))
        return let(F.array_max(F.transform(slow, lambda x: x["at"])), lambda last: F.size(F.filter(F.col("speeds"), lambda x: last.isNull() | (x["at"] > last))))

    return F.when(F.size("speeds") > 0, based("speeds", w, tested))


def ice_features(w: Windows) -> tuple[dict[str, Column], dict[str, Column]]:
    f = lambda k: F.col(f"ice_test.{k}")
    tested = f("v_base").isNotNull() & f("v_recent").isNotNull()
    speed = F.when(tested, f("v_recent")).otherwise(f("plain_v"))
    error = F.when(tested, f("se_recent")).otherwise(f("plain_se"))
    z = F.when(tested, f("z"))
    sure = (z >= w.min_z - NOISE) & (speed >= w.min_speed - NOISE)
    seen = F.when(f("seen").isNotNull(), 0.3 + 0.2 * f("seen")).otherwise(0.0) + F.when(tested, 0.3).otherwise(0.0)
    return {"ice_test": speed_test(w), "sight_test": sight_test(w)}, {
        "speed": speed, "steep_speed": F.when((F.coalesce("own_slope", F.lit(0.0)) >= 25) & (speed > 3 * error + NOISE), speed), "z": z,
        "ratio": F.when(sure, speed / F.greatest(f("v_base"), F.lit(0.03))).when(z.isNotNull(), 1.0), "trend": F.when(sure, F.coalesce(f("run"), F.lit(0)).cast("double")).when(z.isNotNull(), 0.0),
        "ice_confidence": F.when(F.col("ice_test").isNotNull(), F.least(F.lit(1.0), 0.2 + seen)), "mm_per_month": F.abs(F.col("sight_test.recent.mean")) * 30000, "los_ratio": sight_ratio(w),
    }


def sight_test(w: Windows) -> Column:
    """Means (recent, base) of signed line-of-sight speeds, where the baseline has two rows."""

    def both(base: Column, seasonal: Column) -> Column:
        recent = robust_mean(aged("sight", 0, 2 * w.recent), F.lit(1e-6))
        return let(robust_mean(base, F.lit(1e-6)), lambda b: F.when(b["n"] >= 2, let(recent, lambda r: F.when(r.isNotNull(), F.struct(r.alias("recent"), b.alias("base"))))))

    return F.when(F.size("sight") > 0, based("sight", w, both))


def sight_ratio(w: Windows, least: float = 5e-4) -> Column:
    m = lambda part, k: F.col(f"sight_test.{part}.{k}")
    z = F.abs(m("recent", "mean") - m("base", "mean")) / F.hypot(m("recent", "error"), m("base", "error"))
    return F.when((z >= w.min_z) & (F.abs(m("recent", "mean")) >= least), F.abs(m("recent", "mean")) / F.greatest(F.abs(m("base", "mean")), F.lit(3e-4)))


def useful(w: Windows) -> Column:
    """Whether the model looks at a row's kind for its kind of site."""
    is_lake, is_ice = (F.col("site_kind").isin(*kinds) for kinds in (LAKES, ICE))
    cracks = (F.col("kind") == "surface_change") & (is_lake | is_ice)
    return ((F.col("kind") == "lake_area") & is_lake) | (F.col("kind").isin("velocity", "insar_los") & is_ice) | (F.col("kind") == "sar_change") | cracks


def features(obs: DataFrame, times: DataFrame, sites: DataFrame, w: Windows) -> tuple[DataFrame, dict[tuple, tuple]]:
    """A row for each (site_id, as_of) of ``times`` whose kind of site is known: site_kind, confidence and a column for each
    feature, null where its kind of site has none; and the names of the features by kinds of sites. ``sites``: site_id,
    site_kind, and what is known of the site itself (slope, walls, glacier_m, area; null if unknown). Lakes without a good area
    have nothing but that. What is known joins the times and the observations, not their arrays."""
    keys = ["site_id", "as_of"]
    own = sites.select("site_id", "site_kind", F.col("slope").alias("own_slope"), "walls", F.col("glacier_m").alias("own_glacier_m"), F.col("area").alias("own_area")).where(F.col("site_kind").isin(*LAKES, *ICE, *SLIDES))
    rows = histories(obs.join(own.select("site_id", "site_kind"), "site_id").where(useful(w)), times.join(own, "site_id"), ["site_id"], w)
    lake, ice = lake_features(w), ice_features(w)
    is_lake, is_ice, is_slide = (F.col("site_kind").isin(*kinds) for kinds in (LAKES, ICE, SLIDES))
    recent = aged("changes", 0, w.event)
    total = lambda rows: F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda a, v: a + v))
    slid = F.struct(F.array_max(fields(recent, "v")).alias("area"), F.size(recent).alias("n"), F.array_max(fields(recent, "quality")).alias("best"))
    shared = {"changed": let(known("changes", 0, w.event, "v"), total) / 1e6, "new_length": crack_length(w)}
    rows = rows.withColumns({k: F.when(is_lake, c) for k, c in lake[0].items()} | {k: F.when(is_ice, c) for k, c in ice[0].items()} | {k: F.when(~is_slide, c) for k, c in shared.items()} | {"slid": F.when(is_slide, slid)})
    rows = rows.withColumns(lake[1] | ice[1])
    some = F.col("lake_confidence").isNotNull()
    of_lakes = {
        "steep_walls_deg": F.col("walls"), "glacier_contact_m": F.coalesce("glacier_seen_m", "own_glacier_m"), "barrier_lake": F.when(F.col("site_kind") == "barrier_lake", 1.0), "lake_growth_recent_pct": F.col("growth_pct"),
        "lake_growth_annual_pct": F.col("annual_growth_pct"), "lake_area_km2": F.when(some, F.col("lake_area")).otherwise(F.nullif(F.col("own_area"), F.lit(0.0))) / 1e6, "turbidity_rise": F.col("turbidity_rise"),
        "sar_change_km2": F.when(some, F.col("changed")), "new_fractures_m": F.when(some, F.col("new_length")),
    }
    of_ice = {
        "source_slope_deg": F.col("own_slope"), "velocity_m_day": F.col("speed"), "velocity_steep_m_day": F.col("steep_speed"), "velocity_z": F.col("z"), "velocity_ratio": F.col("ratio"), "velocity_trend": F.col("trend"),
        "insar_mm_month": F.col("mm_per_month"), "insar_ratio": F.col("los_ratio"), "sar_change_km2": F.col("changed"), "new_fractures_m": F.col("new_length"),
    }
    # Steps that hold a higher-order function are not generated as one method; without these two, all steps from here to the
    # scores are, and it is too long to be compiled (``F.exists`` of ``lake_features`` is the other).
    sure = let(F.least(F.col("slid.n"), F.lit(2)), lambda n: 0.3 + 0.2 * n + F.when(F.col("slid.best") >= 0.8, 0.1).otherwise(0.0))
    of_slides = {"landslide_area_km2": F.col("slid.area") / 1e6}
    confidence = F.when(is_lake, F.coalesce("lake_confidence", F.lit(0.1))).when(is_ice, F.coalesce("ice_confidence", F.lit(0.15))).otherwise(F.when(F.col("slid.n") > 0, F.least(F.lit(0.8), sure)).otherwise(0.3))
    parts = [(LAKES, is_lake, of_lakes), (ICE, is_ice, of_ice), (SLIDES, is_slide, of_slides)]
    names = list(dict.fromkeys(name for _, _, own in parts for name in own))
    columns = [F.coalesce(*[F.when(on, own[name].cast("double")) for _, on, own in parts if name in own]).alias(name) for name in names]
    return rows.select(*keys, "site_kind", confidence.alias("confidence"), *columns), {kinds: tuple(own) for kinds, _, own in parts}


def site_features(obs: DataFrame, times: DataFrame, sites: DataFrame, w: Windows) -> DataFrame:
    """``features`` as long rows (site_id, as_of, site_kind, confidence, feature, x), those of each kind of site."""
    rows, names = features(obs, times, sites, w)
    listed = lambda fs: F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("x")) for k in fs])
    each = F.coalesce(*[F.when(F.col("site_kind").isin(*kinds), listed(fs)) for kinds, fs in names.items()])
    return rows.select("site_id", "as_of", "site_kind", "confidence", F.explode(each).alias("f")).select("site_id", "as_of", "site_kind", "confidence", "f.*")
