"""Robust statistics by key. Each takes a frame, its key columns and column names, and gives one row a key.

An exact median holds a key's values in one task; keys here are cells and sites with a bounded history. The windows and the
aggregates that follow share one shuffle by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scales a median absolute deviation to a standard deviation (fixed value).
MAD_SCALE = 1.4826


def weighted_mean(df: DataFrame, keys: list[str], value="v", error="se", clip=3.5, min_error: float | Column = 1e-3, carry: dict[str, Column] | None = None) -> DataFrame:
    """Inverse-variance mean after rejecting values further than ``clip`` errors from the median, if at least half
    remain. Columns mean, error, n (before rejection); ``carry`` adds aggregates."""
    by = Window.partitionBy(*keys)
    least = F.lit(min_error) if not isinstance(min_error, Column) else min_error
    s = F.greatest(F.col(error), least)
    flagged = (
        df.where(F.col(value).isNotNull() & F.col(error).isNotNull())
        .withColumn("_s", s)
        .withColumn("_keep", F.abs(F.col(value) - F.median(value).over(by)) <= clip * F.col("_s") + 1e-9)
        .withColumn("_n", F.count("*").over(by))
        .withColumn("_kept", F.sum(F.col("_keep").cast("int")).over(by))
    )
    used = F.col("_keep") | (F.col("_kept") < F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
    w = F.when(used, 1 / (F.col("_s") * F.col("_s")))
    return flagged.groupBy(*keys).agg(
        (F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), (1 / F.sqrt(F.sum(w))).alias("error"), F.count("*").alias("n"), *[c.alias(k) for k, c in (carry or {}).items()]
    )


def robust_sd(df: DataFrame, keys: list[str], value="v") -> DataFrame:
    """sd, n: scaled median absolute deviation from the median."""
    by = Window.partitionBy(*keys)
    return df.withColumn("_d", F.abs(F.col(value) - F.median(value).over(by))).groupBy(*keys).agg((MAD_SCALE * F.median("_d")).alias("sd"), F.count(value).alias("n"))


def stacked(df: DataFrame, keys: list[str], acquisition: str, floor: str | None = None, clip=3.5) -> DataFrame:
    """``weighted_mean`` with errors at least ``floor`` (a column), and the error widened for rows that share an
    acquisition: rows are counted before rejection."""
    least = F.greatest(F.lit(1e-3), F.coalesce(F.col(floor), F.lit(0.0))) if floor else F.lit(1e-3)
    out = weighted_mean(df, keys, clip=clip, min_error=least, carry={"acquisitions": F.size(F.collect_set(acquisition))})
    return out.withColumn("error", F.col("error") * F.sqrt(F.col("n") / F.col("acquisitions")))


def speedup(df: DataFrame, keys: list[str], period: str, acquisition: str, min_base: int = 4) -> DataFrame:
    """Test of recent against base rows (``period`` holds 'recent' or 'base'): v_recent, se_recent, v_base, se_base,
    floor, z, n_recent, n_base. The noise floor is the spread of at least ``min_base`` base rows."""
    rows = df.where(F.col(period).isin("recent", "base"))
    by = Window.partitionBy(*keys)
    base = F.when(F.col(period) == "base", F.col("v"))
    rows = rows.withColumn("_d", F.abs(base - F.median(base).over(by)))
    rows = rows.withColumn("_floor", F.when(F.count(base).over(by) >= min_base, MAD_SCALE * F.median("_d").over(by)).otherwise(0.0))
    each = stacked(rows.withColumn("_part", F.col(period)), [*keys, "_part", "_floor"], acquisition, floor="_floor")

    def of(part: str, column: str) -> Column:
        return F.max(F.when(F.col("_part") == part, F.col(column)))

    out = each.groupBy(*keys).agg(
        of("recent", "mean").alias("v_recent"), of("recent", "error").alias("se_recent"), of("base", "mean").alias("v_base"), of("base", "error").alias("se_base"), F.max("_floor").alias("floor"),
        F.coalesce(of("recent", "n"), F.lit(0)).alias("n_recent"), F.coalesce(of("base", "n"), F.lit(0)).alias("n_base"),
    )
    return out.withColumn("z", F.try_divide(F.col("v_recent") - F.col("v_base"), F.hypot("se_recent", "se_base")))


def age_days(at: Column, as_of: Column) -> Column:
    """Fractional days from ``at`` to ``as_of``."""
    return F.timestamp_diff("MICROSECOND", at, as_of) / F.lit(86400e6)


def season(as_of: Column, half_days: float, year_days: float = 365.0) -> tuple[Column, Column]:
    """Ages, in days, of the same season one year of ``year_days`` before."""
    return F.lit(year_days - half_days), F.lit(year_days + half_days)


def anomaly(df: DataFrame, keys: list[str], as_of: Column, recent_days=16.0, half_season=30.0, fallback=(30.0, 150.0), min_rows=2, min_speed=0.03, acquisition="pair_key", orbit="orbit") -> DataFrame:
    """Same-season speed-up: recent rows are younger than ``recent_days`` (the far end open); base rows are those of the
    season one year before, or, with fewer than ``min_rows``, of ages ``fallback``. Adds ratio and the number of orbits
    whose own mean exceeds the base by more than its error and the floor."""
    by = Window.partitionBy(*keys)
    age = age_days(F.col("pair_end"), as_of)
    first, last = season(as_of, half_season)
    rows = df.withColumn("_age", age).where((F.col("_age") >= 0) & (F.col("_age") <= F.greatest(last, F.lit(fallback[1]))))
    rows = rows.withColumn("_seasonal", F.count(F.when(F.col("_age").between(first, last), 1)).over(by) >= min_rows)
    base = F.when(F.col("_seasonal"), F.col("_age").between(first, last)).otherwise(F.col("_age").between(*fallback))
    rows = rows.withColumn("period", F.when(F.col("_age") < recent_days, "recent").when(base, "base"))
    test = speedup(rows, keys, "period", acquisition).where((F.col("n_recent") >= min_rows) & (F.col("n_base") >= min_rows))
    own = weighted_mean(rows.where("period = 'recent'"), [*keys, orbit])
    facts = test.select(*keys, "v_base", "floor")
    sure = own.join(facts, keys).where(F.round(F.col("mean") - F.col("v_base"), 9) > F.round(F.greatest("error", "floor"), 9)).groupBy(*keys).agg(F.count("*").alias("orbits"))
    return test.join(sure, keys, "left").withColumn("orbits", F.coalesce("orbits", F.lit(0))).withColumn("ratio", F.col("v_recent") / F.greatest(F.col("v_base"), F.lit(min_speed)))


def settled(x: Column, places: int = 6) -> Column:
    """``x`` to some places, upwards from 0.4999 of the last: the order in which a sum was added decides no half."""
    return F.floor(x * 10**places + 0.5001) / 10**places


#: Two sums of the same rows may differ by so much: a value counts as above a bound only if it is further above it (fixed value).
NOISE = 1e-9


def significant(z=3.0, speed=0.05, ratio=2.0, orbits=2) -> Column:
    return (F.round("z", 9) >= z) & (F.round("v_recent", 9) >= speed) & (F.round("ratio", 9) >= ratio) & (F.col("orbits") >= orbits)


def newest_run(df: DataFrame, keys: list[str], at: str, hit: Column) -> DataFrame:
    """run: rows from the newest back to the first that isn't a hit."""
    newest = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return df.withColumn("_miss", F.sum(F.when(hit, 0).otherwise(1)).over(newest)).groupBy(*keys).agg(F.count(F.when(F.col("_miss") == 0, 1)).alias("run"))


def confusion(df: DataFrame, truth: str, predicted: str, ignore: int = 255) -> DataFrame:
    """n of each pair of classes, and the intersection over union of each true class."""
    counts = df.where(F.col(truth) != ignore).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    of_truth, of_predicted = Window.partitionBy("truth"), Window.partitionBy("predicted")
    same = F.col("truth") == F.col("predicted")
    return counts.withColumn("row", F.sum("n").over(of_truth)).withColumn("column", F.sum("n").over(of_predicted)).withColumn("iou", F.when(same, F.col("n") / (F.col("row") + F.col("column") - F.col("n")))).drop("row", "column")
