"""The monitoring cycle as a stream: each micro-batch registers acquisitions, keeps their status, and names what to re-score."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import upsert
from ..sources.shared import shared_dir
from .jobs import KeyedTable, each_batch

SCENES = "key long, site_id long, acquired_at timestamp, status string, tries int"


class Cycle:
    """State of the scenes in a keyed table in the shared folder: a batch touches the buckets of its scenes only, and one that
    runs again writes its folders again.

    A scene goes from pending to processed, skipped or failed; a failed one is tried up to ``attempts`` times. Scenes older
    than the newest processed one by more than ``lateness_days`` are skipped, as a watermark would drop them.
    """

    def __init__(self, spark: SparkSession, lateness_days: float = 1.0, attempts: int = 3) -> None:
        self.spark, self.lateness, self.attempts = spark, lateness_days, attempts
        self.base = f"{shared_dir(spark)}/scarp-cycle-{uuid.uuid4().hex}"
        self.table = KeyedTable(spark, self.base, ["key"], SCENES)

    def scenes(self, before: int | None = None) -> DataFrame:
        return self.table.read(before)

    def batch(self, new: DataFrame, number: int) -> None:
        """``new``: key, site_id, acquired_at, outcome ('ok', 'empty' or 'error')."""
        newest = self.scenes(number).where("status = 'processed'").agg(F.max("acquired_at")).first()[0]
        late = F.lit(False) if newest is None else F.timestamp_diff("SECOND", F.col("acquired_at"), F.lit(newest)) > self.lateness * 86400
        status = F.when(late | (F.col("outcome") == "empty"), "skipped").when(F.col("outcome") == "ok", "processed").otherwise("failed")
        rows = new.dropDuplicates(["key"]).select("key", "site_id", "acquired_at", status.alias("status"))
        old = self.table.read(number, self.table.touched(rows))
        rows = rows.join(old.select("key", F.col("status").alias("_s"), F.col("tries").alias("_n")), "key", "left")
        rows = rows.where(F.col("_s").isNull() | ((F.col("_s") == "failed") & (F.col("_n") < self.attempts)))
        rows = rows.withColumn("tries", F.coalesce(F.col("_n"), F.lit(0)) + 1).drop("_s", "_n")
        self.table.write(upsert(old, rows, ["key"]), number)

    def run(self, stream: DataFrame) -> DataFrame:
        """All that is there now; the scenes afterwards."""
        each_batch(stream, self.batch, f"{self.base}/state").awaitTermination()
        return self.scenes()

    def to_rescore(self) -> DataFrame:
        """Sites and times that processed scenes touch, each once."""
        return self.scenes().where("status = 'processed'").select("site_id", F.col("acquired_at").alias("as_of")).distinct()
