"""Periodic runs of words by Baier's grouping.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of at least ``times * q`` and
``least`` words, that no neighbouring word extends. Each text is one sequence of numbers, equal for equal words.

1. Phase one of Baier's suffix sorter, once with the words' numbers and once with their reverse order. Suffixes start in
   groups by first word. Groups are taken from the greatest down; each suffix of the group hands its context (the group's
   common prefix) to the nearest suffix before it that is in a lower group, which moves to a new group just above its own,
   with its context prolonged by as many copies as it was handed. When a group's turn comes its context is the longest
   Lyndon word that begins there, so the lengths of contexts are the Lyndon array, and equal groups are equal Lyndon words.
2. Two equal Lyndon words side by side are two roots of a run; every run of three or more periods shows two of its roots so
   under one of the orders (with ``times`` below 3, one root is enough to look). The first root of each row of roots is prolonged to the left and right by longest common extensions
   of the text with itself one period further. Both orders may find a run; it counts once.

What cannot hold a run is left out beforehand, exactly: in a run of at least three periods and 24 words every window of 8
words is found again one period further or before, so only the stretches that windows occurring twice in their text cover
are grouped. With bounds that don't allow this (``times`` below 3, or ``least`` below 24), the whole text is grouped.

A text is worked on alone, in memory in proportion to its length; time is linear up to the sort of windows.

Nulls, ties, repeats: null and empty texts have no words and no run; a null id is kept; of runs with equal exponents the
strongest is the one that starts first, then the one of shorter period; repeated rows get equal results; an empty table
gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices

#: Words of a window, and the bounds that make windows of a run occur twice.
WINDOW, WINDOW_TIMES, WINDOW_LEAST = 8, 3, 24
#: Periods of a run that always hold two whole roots.
ROOTS = 3
ODD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "runs array<struct<start: bigint, length: bigint, period: bigint>>, strongest struct<start: bigint, length: bigint, period: bigint>, collapsed string"


def lyndon_groups(words: list[int], kinds: int) -> tuple[list[int], list[int]]:
    """The group of each suffix, and the Lyndon array: lengths of the longest Lyndon words that begin at each place.
    ``words`` are numbers below ``kinds``."""
    n = len(words)
    # Places count from 1 here: place 0 ends every search to the left.
    group = [-1, *words]
    members: list[list[int]] = [[] for _ in range(kinds)]
    for place, word in enumerate(words, 1):
        members[word].append(place)
    size, lower, upper = [1] * kinds, list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    left, taken = [0] * (n + 1), bytearray(n + 1)
    g = kinds - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            taken[i] = 1
        handed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while taken[j]:
                j = left[j]
            left[i] = j
            if j:
                handed[j] = handed.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, copies in handed.items():
            moved.setdefault((copies, group[j]), []).append(j)
        # Just above the old group each time: the most copies first, so that they end highest.
        for copies, old in sorted(moved, reverse=True):
            new, places = len(size), moved[copies, old]
            size.append(size[old] + copies * size[g])
            members.append(places)
            for j in places:
                group[j] = new
            lower.append(old)
            upper.append(upper[old])
            lower[upper[old]] = new
            upper[old] = new
        g = lower[g]
    return group[1:], [size[x] for x in group[1:]]


def common_right(w: np.ndarray, i: int, j: int) -> int:
    """Length of the longest common prefix of the suffixes at i and at the later j."""
    k, step = 0, 16
    while j + k < len(w):
        own = w[j + k : j + k + step]
        differ = np.flatnonzero(w[i + k : i + k + len(own)] != own)
        if len(differ):
            return k + int(differ[0])
        k, step = k + len(own), 4 * step
    return k


def runs_of(w: np.ndarray, times: int = 3, least: int = 24) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers."""
    found = set()
    if len(w) < least:
        return found
    kinds, w = np.unique(w, return_inverse=True)
    mirrored, n = w[::-1], len(w)
    for order in (w, len(kinds) - 1 - w):
        group, period = (np.array(x) for x in lyndon_groups(order.tolist(), len(kinds)))
        at = np.flatnonzero(np.arange(n) + period < n)
        if times >= ROOTS:
            at = at[group[at + period[at]] == group[at]]
        before = at - period[at]
        for i in at[(before < 0) | (group[np.maximum(before, 0)] != group[at])].tolist():
            p = int(period[i])
            end = i + p + common_right(w, i, i + p)
            # Backwards from the words before both places: mirrored, the earlier place comes later.
            start = i - (common_right(mirrored, n - i - p, n - i) if i else 0)
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return found


def stretches(w: np.ndarray) -> list[tuple[int, int]]:
    """Where windows that occur twice lie: (start, end)."""
    if len(w) < WINDOW_LEAST:
        return []
    h = np.zeros(len(w) - WINDOW + 1, np.uint64)
    x = (w.astype(np.uint64) + np.uint64(1)) * ODD
    x ^= x >> np.uint64(31)
    for k in range(WINDOW):
        h = h * ODD + x[k : k + len(h)]
    order = np.argsort(h)
    same = np.append(h[order[1:]] == h[order[:-1]], False)
    same[1:] |= same[:-1].copy()
    if not same.any():
        return []
    edge = np.zeros(len(w) + 1, np.int64)
    edge[order[same]] += 1
    edge[order[same] + WINDOW] -= 1
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    ends = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in zip(ends[::2], ends[1::2]) if b - a >= WINDOW_LEAST]


def of_words(words: list[bytes], times: int, least: int) -> list[tuple[int, int, int]]:
    """The runs of a text, by start, then period."""
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words))
    parts = stretches(w) if times >= WINDOW_TIMES and least >= WINDOW_LEAST else [(0, len(w))]
    return sorted(((a + s, n, p) for a, b in parts for s, n, p in runs_of(w[a:b], times, least)), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by spaces, without those that a run repeats."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic(docs: DataFrame, times: int = 3, least: int = 24) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, runs (start, length, period of each, by start, then period), the
    strongest of them by length / period (null without any), and the text without the words that runs repeat."""

    def run(batches):
        for batch in slices(batches, 256):
            runs, best, short = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at the six ASCII white-space characters
                own = of_words(words, times, least)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                best.append(min(runs[-1], key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) if own else None)
                short.append(collapsed(words, own))
            one = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(one)), pa.array(best, one), pa.array(short, pa.string())], ["doc_id", "runs", "strongest", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def repeating(doc_id: Column, text: Column) -> Column:
    """``text``, of which every tenth document, by crc32 of its id, is made periodic from a place on: with h that crc32,
    g = floor(h / 10) and n words, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, i.cast("int"))), " "))

    words = F.array(F.regexp_extract_all(text, F.lit(f"({WORD})")))  # as a lambda's variable they are split off once
    return F.when(h % 10 == 0, F.get(F.transform(words, looped), 0)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The runs and collapsed texts of ``periodic`` as numbers and sha256 digests."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = [F.col(f"strongest.{k}").alias(k) for k in ("start", "length", "period")]
    milli = F.floor(F.lit(1000) * F.col("strongest.length") / F.col("strongest.period"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli.alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
