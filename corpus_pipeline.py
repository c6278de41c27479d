"""A corpus pipeline: raw documents to the token ids of a balanced, near-duplicate-free mix without secrets.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``; ``doc_id`` stays through all of them, though
the mix may hold a document more than once.

Nulls, repeats, empty tables: null and empty texts have too few words, so the quality rules reject them; a null id is never a
near duplicate, so its row stays; rows that share an id stay or go together in the Jaccard stage and are drawn one by one in
the mix; a null source is one source, last in order; an empty table gives an empty result of the same columns. Other columns
of ``documents``, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scarp.llm import jaccard, mixing, pieces, quality, secrets
from scarp.llm.common import saved, table

#: The public tokenizer's model file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.accepted(docs, host="source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id."""
    return jaccard.representatives(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    masked = secrets.scan(docs, mask="[SECRET]")
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three rows, or none."""
    return mixing.copies(docs, mixing.mix(docs.select("doc_id", "text", "source")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return pieces.encode(docs.select("doc_id", "text"), MODEL)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The Jaccard components, the cube method and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
