"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is sent to every executor only if it has at most this many rows (of a few numbers each).
BROADCAST_ROWS = 1_000_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's settings. Where none is set, a local session gets a
    temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and a lost executor costs nothing. Python
    workers get few rows at a time meanwhile, as texts may be long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scarp-{uuid.uuid4().hex}"
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(rows), 1000)))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than keep all cores busy a few times: for results that are small beside the corpus, of
    which every empty partition would still be a task and a file."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def slices(batches, rows: int = 512):
    """The batches of a task in shorter ones, so that few rows at a time become Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its counted size, is within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def null_safe(df: DataFrame, other: DataFrame, keys: list[tuple[str, str]]) -> Column:
    """Equality of key columns in which null equals null."""
    cond = F.lit(True)
    for a, b in keys:
        cond = cond & df[a].eqNullSafe(other[b])
    return cond


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
