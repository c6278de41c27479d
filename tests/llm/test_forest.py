"""Near duplicates by the forest against all pairs, and what the forest finds by itself."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from scarp.llm import forest, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, component_id string, band string"


def plain(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    links = 0
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}, links


def varied(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 40, 150]))) for _ in range(60)]
    out = [*base, *[varied(rng, t, c) for t in base[:30] for c in (1, 2, 5)]]
    hot = " ".join(rng.choices(vocabulary, k=80))
    out += [varied(rng, hot, rng.choice([1, 3, 4, 7])) for _ in range(120)] + [hot] * 5
    return out + [base[0].upper(), "", None, " \n", "one", "ONE", "one two", "one\x0btwo", "x " * 3000, "x x"]


def test_against_all_pairs(spark, texts):
    rows = list(enumerate(texts))
    expected, links = plain(rows, 2, 80)
    df = spark.createDataFrame([(i, t, "a", None) for i, t in rows] + [(None, "one two", "a", None), (3, texts[3], "b", None)], SCHEMA)
    got = forest.linked(df).collect()
    assert len(got) == len(rows) + 2 and links > 500
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == expected[r["doc_id"]]


def test_short_lists_and_long_lists_agree(spark, texts):
    df = spark.createDataFrame([(i, t, "a", None) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(map(tuple, forest.linked(df, most_ids=0).collect())) == sorted(map(tuple, forest.linked(df, words=2).collect()))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("scarp_")]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert forest.linked(df).count() == 0
    assert forest.linked(spark.createDataFrame([(1, None, "a", None), (2, "", "a", None)], SCHEMA)).where("kept").count() == 2


def test_the_forest_finds_most_by_itself(spark, texts):
    """Candidates alone, with nothing confirmed: nearly all pairs of similar sets are joined by neighbours and regions."""
    rows = [(i, t) for i, t in enumerate(texts) if t and len(t.split()) > 20]
    df = spark.createDataFrame([(i, t, "a", None) for i, t in rows], SCHEMA)
    classes = jaccard.Corpus(df, 2, forest.signature).classes
    root = {r["node"]: r["node"] for r in classes.select("node").collect()}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    bands = {}
    for r in forest.candidates(classes).collect():
        for other in (r["neighbour"], bands.setdefault(r["band"], r["node"]) if r["band"] is not None else None):
            if other is not None:
                root[top(r["node"])] = top(other)
    expected, _ = plain([(i, t) for i, t in rows if i in root], 2, 80)
    linked = [(i, c) for i, (_, c, _) in expected.items() if c != i]
    assert sum(top(i) == top(c) for i, c in linked) >= 0.95 * len(linked)


def test_depths_follow_the_crowd():
    # One crowd of 40 that shares three minima and parts into fours at the fourth; a pair; a row alone.
    common = np.array([-1] + [3 if k % 4 == 0 else 5 for k in range(1, 40)] + [0, 2] + [1])
    found = forest.depths(common)
    assert set(found[:40]) == {4} and list(found[40:]) == [2, 2, 0]
    same = np.array([-1] + [forest.DEPTH] * 99)
    assert set(forest.depths(same)) == {forest.DEPTH}


def test_minima_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 1 << 63, 220, np.uint64) * np.uint64(2))
        a, b = np.sort(pool[:200]), np.sort(pool[20:])
        x, y = (forest.signature(h).view(np.uint64) for h in (a, b))
        agree += [(x >> np.uint64(32) == y >> np.uint64(32)).mean(), ((x ^ y) & np.uint64(0xFFFFFFFF) == 0).mean()]
    assert abs(np.mean(agree) - 180 / 220) < 0.03
    assert len(forest.signature(np.array([5], np.uint64))) == forest.TREES * forest.DEPTH // 2
