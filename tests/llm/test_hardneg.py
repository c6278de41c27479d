"""Hard negatives against all pairs, and the multi-index's early stop."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from scarp.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plain(rows, every, positives=5, negatives=10, low=30, high=90):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y, *_ in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in sorted(fine, key=lambda r: (r[2], r[1])):
        if i % every == 0:
            anchors.setdefault(i, (v, y))
    out = []
    for a, (v, y) in anchors.items():
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in fine if i != a), key=lambda r: r[:2])
        for s, p, _ in [r for r in scored if r[2] == y][:positives]:
            hits = [r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(hits, 1)]
    return sorted(out)


def rows_of(kind, rng, n):
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(7)]
    for i in range(n):
        if kind == "clusters":
            c = rng.choice(centres)
            v = [x + rng.gauss(0, 0.05) for x in c]
        elif kind == "ties":
            v = [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]
        else:
            v = [rng.gauss(0, 1) for _ in range(6)]
        yield (i, v, rng.choice([0, 0, 0, 1, 2, 9]), "x")


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_against_all_pairs(spark, kind):
    rows = list(rows_of(kind, random.Random(7), 700))
    rows += [(10, None, 1, "x"), (None, [1.0] * 6, 1, "x"), (20, [1.0, None, 0.0, 0.0], 0, "x"), (30, [float("nan")] * 4, 0, "x"), (40, [1.0, 2.0], None, "x"), (7, [0.5], 1, "x"), (8, [], 1, "x")]
    rows += rows[5:9] * 2  # repeated rows are candidates each
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in hardneg.mined(df, every=10, part_rows=150).collect())
    expected = plain(rows, 10)
    assert got == expected and len(got) > 300


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, "x")], SCHEMA)
    assert hardneg.mined(df).count() == 0
    assert hardneg.mined(df.limit(0)).count() == 0
    assert hardneg.mined(spark.createDataFrame([(0, [], 1, "x"), (100, [], 1, "x")], SCHEMA)).count() == 0
    few = [(0, [1.0, 1.0], 1, "x"), (1, [1.0, 0.9], 1, "x"), (2, [0.5, 0.5], 2, "x"), (3, [-1.0, 0.0], 2, "x")]
    assert [tuple(r) for r in hardneg.mined(spark.createDataFrame(few, SCHEMA)).collect()] == plain(few, 100)


def test_windows_are_certified_early(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(0, 0.02, 16)).tolist(), k % 3, "x") for k in range(3000)]
    assert hardneg.scored_share(spark.createDataFrame(rows, SCHEMA), every=50) < 0.3


def test_multi_index_visits_in_order_of_bounds():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 100, (900, 8)))
    index = hardneg.MultiIndex(hardneg.Halves(x[:200], 5), x, np.arange(900), np.arange(900) % 4)
    q = np.floor(rng.normal(0, 100, (9, 8)))
    windows = [[(0, -np.inf, np.inf), (1, 1000.0, 9000.0)]] * 9
    out, scored = index.search(-1 - np.arange(9), q, np.arange(9) % 4, windows, False, 6)
    for i in range(9):
        s = q[i] @ x.T
        for place, low, high in windows[i]:
            fine = np.flatnonzero((np.arange(900) % 4 != i % 4) & (s >= low) & (s <= high))
            best = fine[np.lexsort((fine, -s[fine]))][:6]
            assert [(r, v) for a, p, r, v in out if (a, p) == (-1 - i, place)] == [(int(r), int(s[r])) for r in best]
    assert 0 < scored <= 9 * 900
