"""Keyed table operations: latest rows, upserts, set differences, codes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


#: Rows that a task holds where tasks are as many as the rows ask for (fixed value).
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """``df`` of some ``rows`` dealt by its keys to so many tasks that each holds few, however many there are."""
    return df.repartition(rows // ROWS_A_TASK + 1, *keys)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), rows: int | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; columns in ``keep`` stay as they were. ``rows``, if
    known, are those of both: the number of tasks follows them."""
    side = F.struct(*[F.col(c) for c in old.columns])
    both = old.select(*keys, side.alias("_old"), F.lit(None).alias("_new")).unionByName(new.select(*keys, F.lit(None).alias("_old"), F.struct(*[F.col(c) for c in old.columns]).alias("_new")))
    both = both if rows is None else dealt(both, rows, keys)
    one = both.groupBy(*keys).agg(F.first("_old", True).alias("_old"), F.first("_new", True).alias("_new"))
    pick = lambda c: F.coalesce(F.col("_old")[c], F.col("_new")[c]) if c in keep else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])
    return one.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def changed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Status of each key: created, updated, unchanged or missing."""
    a, b = old.select(*keys, F.struct(*columns).alias("_old")), new.select(*keys, F.struct(*columns).alias("_new"))
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "missing").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def numbered(df: DataFrame, prefix: Column, *order: Column, existing: Column | None = None) -> DataFrame:
    """Codes: the prefix and a running number of four digits, after the numbers that exist. Rows are dealt by ranges of their
    order and numbered within each, after the rows of the ranges before, so no task holds all rows of a prefix."""
    from ..sources.shared import saved

    whole = saved(df.withColumn("_prefix", prefix))  # ranges are found by a pass of its own, which would make the rows again
    rows = saved(whole.repartitionByRange("_prefix", *order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("n").over(Window.partitionBy("_prefix").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = rows.groupBy("_prefix", "_range").agg(F.count("*").alias("n")).select(F.col("_prefix").alias("_p"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_prefix", "_range").orderBy(*order)))
    placed = placed.join(F.broadcast(ranges), (F.col("_range") == F.col("_r")) & F.col("_prefix").eqNullSafe(F.col("_p")))
    number = F.col("_k") + F.col("_before") + (existing if existing is not None else F.lit(0))
    return placed.withColumn("code", F.format_string("%s%04d", "_prefix", number)).drop("_prefix", "_range", "_k", "_p", "_r", "_before")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """A global top-k: each task keeps n rows, one task merges them."""
    return df.orderBy(*order).limit(n)


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def retained(df: DataFrame, at: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows kept, and a summary of those that go."""
    return df.where(F.col(at) >= cutoff), df.where(F.col(at) < cutoff).agg(F.count("*").alias("removed"))


def cumulative(df: DataFrame, keys: list[str], step: str, x: str, y: str) -> DataFrame:
    """Length of a path up to each point."""
    by = Window.partitionBy(*keys).orderBy(step)
    part = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(by), F.col(y) - F.lag(y).over(by)), F.lit(0.0))
    return df.withColumn("_part", part).withColumn("along", F.sum("_part").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_part")
