"""Connected components of a graph kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (a, b), label the smallest node that is reachable.

    Alternates large-star and small-star steps: each links a node's neighbours to the smallest node that it knows, and
    the depth of the trees falls by a constant factor. A node with very many edges is one minimum, summed up before its
    shuffle, and a join on it, which Spark splits. Each round is written to the shared folder. Stops when no edge changes.
    """

    def smallest(both: DataFrame) -> DataFrame:
        return both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = saved(narrow(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    before = state(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(smallest(both), F.col("a") == F.col("_a")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        joined = large.join(smallest(large), F.col("a") == F.col("_a"))
        down = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = saved(narrow(down.where("a <> b").distinct()))
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    return saved(narrow(found))
