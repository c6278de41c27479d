"""Lyndon arrays, runs and collapsed texts against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from scarp.llm import runs


def lyndon(w):
    """By definition: up to the next suffix that is smaller."""
    return [next((j - i for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w) - i) for i in range(len(w))]


def plain(w, times, least):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            own = w[i : i + n]
            if j > i and n >= max(least, times * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(rng, n):
    for _ in range(n):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 70))]
        p = rng.randint(1, 9)
        yield rng.choice([w, (w[:p] * 40)[: rng.randint(1, 60)] + w, w[:5] + (w[:p] * 9) + w[:7] + (w[:p] * 9)])


def test_groups_are_lyndon_words():
    for w in sequences(random.Random(1), 400):
        group, length = runs.lyndon_groups(w, max(w) + 1)
        assert length == lyndon(w)
        roots = [tuple(w[i : i + n]) for i, n in enumerate(length)]
        assert len(set(zip(group, roots))) == len(set(group)) == len(set(roots))


@pytest.mark.parametrize("times, least", [(2, 2), (3, 5), (3, 24)])
def test_runs_against_all_periods(times, least):
    for w in sequences(random.Random(times + least), 400):
        assert runs.of_words([b"%d" % x for x in w], times, least) == plain(w, times, least)


def test_rows(spark):
    texts = ["a b c " * 9, " x y " * 30, "", None, " \n", "one two", ("p q " * 15 + "r ") * 4 + "end", "é " * 5000, "a b c " * 9]
    docs = spark.createDataFrame([(k if k else None, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = {(r["doc_id"], len(r["collapsed"])): r for r in runs.periodic(docs).collect()}
    assert len(got) == len(texts)
    for (k, _), r in got.items():
        w = (texts[k or 0] or "").encode().split()
        expected = plain(w, 3, 24)
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == expected
        gone = {i for s, n, p in expected for i in range(s + p, s + n)}
        assert r["collapsed"] == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        assert (r["strongest"] is None) == (not expected)
    nested = next(r for (k, _), r in got.items() if k == 6)
    assert tuple(nested["strongest"]) == (0, 30, 2) and len(nested["runs"]) == 5
    assert runs.periodic(docs.limit(0)).count() == 0


def test_made_periodic(spark):
    text = " ".join(f"w{k}" for k in range(61))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    looped = 0
    for r in docs.select("doc_id", runs.repeating(F.col("doc_id"), F.col("text")).alias("text")).collect():
        h = zlib.crc32(b"%d" % r["doc_id"])
        w, g = text.split(), h // 10
        if h % 10 == 0:
            a = g % 61
            p = 1 + (61 - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(61)]
            looped += 1
        assert r["text"] == " ".join(w)
    assert looped > 20
    empty = spark.createDataFrame([(k, t) for k in range(40) for t in ("", None, " ")], "doc_id long, text string")
    assert empty.select(runs.repeating(F.col("doc_id"), F.col("text")).alias("t")).where("trim(t) <> ''").count() == 0
    assert runs.digests(runs.periodic(empty)).where("n_runs <> 0 or runs_sha256 <> collapsed_sha256").count() == 0


def test_long_stretch_in_linear_time():
    w = np.tile(np.arange(1000), 100)
    assert runs.runs_of(w) == {(0, 100_000, 1000)}
