"""Streams of observations: windows under a watermark, state by site, and merges by micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import DECIDED, Site
from ..operators.tables import upsert
from ..sources.shared import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def observations(spark: SparkSession, path: str, lateness: str = "1 day") -> DataFrame:
    """Rows of a folder (or file) of observations as a stream; later than ``lateness``, a row is dropped by what follows."""
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def tumbling(stream: DataFrame, width: str, keys: list[str]) -> DataFrame:
    return stream.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, width: str, step: str) -> DataFrame:
    return stream.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), "n", "top")


def sessions(stream: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_sightings(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's reach."""
    return stream.dropDuplicatesWithinWatermark(keys)


def alert_stream(assessments: DataFrame, automatic: tuple[str, ...] = ("high",)) -> DataFrame:
    """The alert fold as a stream: each site's last active alert is the state. Rows of a micro-batch are folded in order
    of time, so the result is that of the batch fold as long as micro-batches come in order of time."""
    state = "assessment_id long, level string, kind string, status string, at long, expires long, score double"
    fields = [x.split()[0] for x in state.split(", ")]

    def fold(key, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        own = Site(dict(zip(fields, held.get)) if held.exists else None)
        rows = sorted((row for frame in frames if len(frame) for row in frame.to_dict("records")), key=lambda r: (r["at"], r["assessment_id"]))
        out = [new for row in rows if (new := own.see(row, automatic))]
        if own.prev:
            held.update(tuple(own.prev[f] for f in fields))
        if out:
            kinds = {n: {"long": "Int64", "string": "object"}[t] for n, t in (x.split() for x in DECIDED.split(", "))}
            yield pd.DataFrame({n: pd.array([row[n] for row in out], dtype=t) if t == "Int64" else [row[n] for row in out] for n, t in kinds.items()})

    return assessments.groupBy("site_id").applyInPandasWithState(fold, DECIDED, state, "append", "NoTimeout")


def run_to_table(stream: DataFrame, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """All that is there now, written to the shared folder as a stream with a checkpoint, and read as a table. ``settings``
    hold while the stream starts, which keeps them."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/scarp-stream-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        query = started(stream, mode, base)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def started(stream: DataFrame, mode: str, base: str):
    if mode == "append":
        return stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    return each_batch(stream, lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/state", mode)


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    return stream.writeStream.outputMode(mode).foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class KeyedTable:
    """A table of one row a key in the shared folder, dealt into ``buckets`` by the keys' hash. A micro-batch reads and writes
    again only the buckets that its rows fall into, each in a folder of its own number, so a batch that runs twice writes the
    same folders. Which batch wrote a bucket last is read from a small table beside it: nothing is kept on the driver, and a
    restart goes on from there."""

    def __init__(self, spark: SparkSession, base: str, keys: list[str], schema, buckets: int = 32) -> None:
        self.spark, self.base, self.keys, self.schema, self.buckets = spark, base, keys, schema, buckets

    def paths(self, before: int | None = None) -> dict[int, str]:
        """The newest folder of each bucket: as many rows as buckets reach the driver."""
        try:
            written = self.spark.read.schema("bucket int, number long").parquet(f"{self.base}/written/*")
        except AnalysisException:  # nothing was written yet
            return {}
        known = written if before is None else written.where(F.col("number") < before)
        return {r.bucket: f"{self.base}/rows/{r.number}/bucket={r.bucket}" for r in known.groupBy("bucket").agg(F.max("number").alias("number")).collect()}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        found = [p for b, p in self.paths(before).items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        return [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]

    def bucket(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def write(self, rows: DataFrame, number: int) -> None:
        """``rows`` hold all rows of the buckets that they touch."""
        path = f"{self.base}/rows/{number}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.parquet(path).select(F.col("bucket").cast("int").alias("bucket"), F.lit(number).cast("long").alias("number")).distinct()
        written.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/written/{number}")

    def merge(self, new: DataFrame, number: int) -> None:
        """Rows of ``new`` in place of those with equal keys."""
        self.write(upsert(self.read(number, self.touched(new)), new, self.keys), number)


def merged(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A table of the latest row of each key, merged batch by batch."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/scarp-merge-{uuid.uuid4().hex}"
    table = KeyedTable(spark, base, keys, stream.schema)

    def merge(df: DataFrame, batch: int) -> None:
        new = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")
        if not new.isEmpty():
            table.merge(new, batch)

    each_batch(stream, merge, f"{base}/state").awaitTermination()
    return table.read()
