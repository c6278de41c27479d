"""The corpus pipeline as a whole on a small corpus, each stage against what it may do to its input."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(30)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n))

    rows = [(i, text(rng.randint(20, 80)), "en", rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(100, rows[4][1], "en", "a"), rows[7], (101, rows[9][1] + " one more", "en", "b")]
    rows += [(102, None, None, None), (103, "", "en", "a"), (104, "too short", "en", "a"), (105, "same five words here now " * 30, "en", "b")]
    rows += [(106, text(30) + " password = hunter2hunter2 " + text(5), "en", "a"), (107, "é " * 40 + text(20000), "de", "b")]
    return [(*r, len(r[1]) if r[1] is not None else None, str(r[0]), r[0]) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _k long"


def test_stages(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus, SCHEMA)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            path = str(tmp_path / f"stage{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
        else:
            last = out.collect()
    clean = {i for i, *_ in corpus[:60]}
    first = {i for i, _ in kept["quality rules"]}
    assert clean | {100, 101, 106, 107} == first
    second = {i for i, _ in kept["n-gram Jaccard join"]}
    assert second == (clean | {106, 107})
    third = dict(kept["secret scans"])
    assert set(third) == second and "hunter2" not in third[106] and "[SECRET]" in third[106]
    assert all(third[i] == t for i, t, *_ in corpus[:60])
    mixed = [i for i, _ in kept["mixing sources to target weights"]]
    before = [i for i, _ in kept["secret scans"]]
    assert set(mixed) <= second and all(mixed.count(i) <= 3 * before.count(i) for i in second)
    assert sorted(r.doc_id for r in last) == sorted(mixed) and all(r.decoded_ok and r.n_tokens == len(r.ids) for r in last)


def test_run_is_its_stages(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((r.doc_id, r.n_tokens) for r in again) and rows


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
