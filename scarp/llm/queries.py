"""The registered queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import forest, hardneg, jaccard, language, mixing, oracles, pieces, pii, quality, runs, secrets, toxicity, vectors, webtext
from .common import table


def op1_toxic_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op2_source_mixing(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_language_mixture(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_piece_encoding(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), corpus_pipeline.MODEL)


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(docs).select("doc_id", *counts, "base_failed", "kept", "n_removed")


def op7_jaccard_join(spark, sf_dir):
    return jaccard.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_voronoi_topk(spark, sf_dir):
    return vectors.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_main_text(spark, sf_dir):
    return webtext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_personal_data(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def op12_lsh_forest(spark, sf_dir):
    return forest.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.repeating(F.col("doc_id"), F.col("text")).alias("text"))
    return runs.digests(runs.periodic(docs))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxic_spans": op1_toxic_spans,
    "op2_source_mixing": op2_source_mixing,
    "op3_language_mixture": op3_language_mixture,
    "op4_secret_scan": op4_secret_scan,
    "op5_piece_encoding": op5_piece_encoding,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_voronoi_topk": op8_voronoi_topk,
    "op9_main_text": op9_main_text,
    "op10_personal_data": op10_personal_data,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lsh_forest": op12_lsh_forest,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op6_quality_rules": oracles.QUALITY,
    "op7_jaccard_join": oracles.JACCARD,
    "op8_voronoi_topk": oracles.TOP_K,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_lsh_forest": oracles.FOREST,
    "op13_periodic_runs": oracles.RUNS,
}
