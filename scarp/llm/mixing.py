"""Mixing sources to target weights by balanced (cube-method) sampling.

A source whose target is r times its size takes every document floor(r) times; what is left, f = r - floor(r), is an
inclusion probability that the cube method rounds to 0 or 1. The flight moves the probabilities of three documents at a
time along the null space of the two balancing constraints (document total, token total) until one of them is decided,
so both totals stay exact. It runs in buckets of a source, and what a bucket leaves undecided (two documents at most)
flies again in the next level, until one bucket a source is left. That bucket lands: its last documents are rounded so
that the token total is nearest, and a few swaps of a taken for an untaken document close the remaining gap.

Nulls, ties, repeats: a null source is a source of its own (last in order); null text has size 0 and is never taken;
repeated rows are separate documents, numbered so that they fly in different buckets; a source without words has target 0; an empty table gives an empty result. Other
columns of the input are ignored. Reruns agree: the random numbers are seeded by source, bucket and level.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, null_safe, saved, small

#: Documents that fly together.
BUCKET_ROWS = 4096
#: Repeated rows that are numbered together.
DRAWS = 65_536
#: Closer to 0 or 1 than this, a probability is decided.
EPS = 1e-9


def source_targets(sources: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Targets by source from (source, source_size): shares of all words by repeating ``weights``, no source above
    ``cap`` times its size, the excess reshared by weight.

    Filling up to the caps in order of cap / weight, the first source whose share stays below its cap sets the level of
    all that follow. One row a source: the two windows have no partitions, but as few rows as there are sources.
    """
    places = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(places) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("_full", F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    return (
        sources.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_full", F.col("_cap") / F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), zero)) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), zero)))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(whole)["_level"])
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))))
        .drop("_w", "_cap", "_full", "_level")
    )


def flight(sizes: list[float], p: list[float], rng: random.Random) -> list[int]:
    """Moves ``p`` in place until two places at most are undecided, and returns these. Both sum(p) and sum(p * size)
    keep their values."""
    active: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            step = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if not any(step):
                step = (1.0, -1.0, 0.0)
            up, down = float("inf"), float("inf")
            for k, u in zip(active, step):
                if u > 0:
                    up, down = min(up, (1 - p[k]) / u), min(down, p[k] / u)
                elif u < 0:
                    up, down = min(up, p[k] / -u), min(down, (1 - p[k]) / -u)
            t = up if rng.random() * (up + down) < down else -down
            left = []
            for k, u in zip(active, step):
                v = p[k] + t * u
                if EPS < v < 1 - EPS:
                    p[k] = v
                    left.append(k)
                else:
                    p[k] = float(round(v))
            active = left if len(left) < 3 else left[:2]
    return active


def land(sizes: list[float], p: list[float], left: list[int], goal: float, swaps: int = 8) -> None:
    """Rounds the last places of ``p`` for the token total nearest ``goal``, then swaps single documents to come nearer."""
    have = sum(s * x for i, (s, x) in enumerate(zip(sizes, p)) if i not in left)
    best = min((abs(goal - have - sum(sizes[k] for n, k in enumerate(left) if m >> n & 1)), m) for m in range(1 << len(left)))[1]
    for n, k in enumerate(left):
        p[k] = float(best >> n & 1)
    have += sum(sizes[k] * p[k] for k in left)
    for _ in range(swaps):
        gap = goal - have
        out = sorted((sizes[i], i) for i in range(len(p)) if p[i] == 0)
        keys = [s for s, _ in out]
        found = None
        for i in range(len(p)):
            if p[i] != 1 or not out:
                continue
            at = bisect_left(keys, sizes[i] + gap)
            for j in (at - 1, at):
                if 0 <= j < len(out) and (found is None or abs(gap - out[j][0] + sizes[i]) < found[0]):
                    found = (abs(gap - out[j][0] + sizes[i]), i, out[j][1])
        if found is None or found[0] >= abs(gap) - 0.5:
            return
        _, i, j = found
        p[i], p[j] = 0.0, 1.0
        have += sizes[j] - sizes[i]


def _flown(level: int, seed: int):
    def fly(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("draw", "ascending")])
        sizes, p = [float(x) for x in rows["size"].to_pylist()], rows["p"].to_pylist()
        source, bucket, buckets = (k.as_py() for k in key)
        goal = sum(s * x for s, x in zip(sizes, p))
        left = flight(sizes, p, random.Random(zlib.crc32(f"{seed}:{level}:{bucket}:{source!r}".encode())))
        if buckets == 1:
            land(sizes, p, left, goal)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(np.asarray(p, dtype="float64")))

    return fly


def mix(docs: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken, the words that the mix takes of it.

    ``docs`` has doc_id, text and source. The text is read once; after that only ids and numbers move. A source of any
    size is dealt into buckets of about ``bucket_rows`` documents, so no task holds a whole source.
    """
    sizes = saved(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = saved(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), cap, weights))
    counted = sources.agg(F.count("*").alias("n"), F.max("_n").alias("most")).first()
    keyed = sources.withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_same"))
    last = F.col("_same") - 1
    drawn = same.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / DRAWS)))).select(
        "doc_id", "source", "size", F.explode(F.sequence(F.col("_hi") * DRAWS, F.least(last, F.col("_hi") * DRAWS + DRAWS - 1))).alias("draw")
    )
    units = (
        drawn.join(small(keyed, counted["n"]), null_safe(drawn, keyed, [("source", "_source")]))
        .drop("_source")
        .withColumn("_r", ratio)
        .withColumn("whole", F.floor(F.col("_r") + EPS))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("_r") - F.col("whole"))).otherwise(0.0))
        .withColumn("buckets", F.ceil(F.col("_n") / bucket_rows).cast("long"))
        .drop("_r", "_n")
    )
    done, level = [], 0
    most = -(-(counted["most"] or 0) // bucket_rows)
    while True:
        units = units.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "draw", F.lit(seed + level)), F.col("buckets")))
        flown = units.groupBy("source", "bucket", "buckets").applyInArrow(_flown(level, seed), units.schema)
        if most <= 1:
            done.append(flown)
            break
        flown = saved(flown)
        open_ = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("buckets") > 1)
        done.append(flown.where(~open_))
        units = flown.where(open_).withColumn("buckets", F.ceil(F.col("buckets") * 2 / bucket_rows).cast("long"))
        most, level = -(-most * 2 // bucket_rows), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    taken = (F.col("size") * (F.col("whole") + F.round("p"))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, rows not taken gone.

    ``mixed`` comes from ``mix(docs)``. Rows with one doc_id and size share their takings, in no particular order. The
    taken ids are sent to the executors if there are few, else both sides are hashed by id. The columns of ``docs`` may
    have any names: they stand in one struct meanwhile.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    often = mixed.where("taken > 0").groupBy(F.col("doc_id").alias("id"), F.col("size").alias("words"), (F.col("taken") / F.col("size")).cast("int").alias("k")).agg(F.count("*").alias("n"))
    # How many of the rows are taken three times, twice, once: a few numbers, however many rows there are.
    times = saved(often.groupBy("id", "words").agg(F.sort_array(F.collect_list(F.struct("k", "n")), asc=False).alias("times")))
    side = small(times, times.count())
    rows = docs.select(F.struct(*docs.columns).alias("row"), size.alias("own"))
    joined = rows.join(side, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("words")))
    if times.where((F.size("times") > 1) | (F.get("times", F.lit(0))["n"] > 1)).limit(1).count():
        place = F.row_number().over(Window.partitionBy("id", "words").orderBy("id"))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("k"))
        step = lambda s, t: F.struct((s["seen"] + t["n"]).alias("seen"), F.when((s["seen"] < F.col("place")) & (F.col("place") <= s["seen"] + t["n"]), t["k"]).otherwise(s["k"]).alias("k"))
        joined = joined.withColumn("place", place).withColumn("k", F.aggregate("times", start, step)["k"]).where("k > 0")
    else:
        joined = joined.withColumn("k", F.get("times", F.lit(0))["k"])
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("k")))).select("row.*")
