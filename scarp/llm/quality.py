"""Quality rules: per-document counts, and line frequency across the documents of a host. DataFrame functions only.

A line's frequency is the number of different texts of its host that hold it (exact copies of a text count once). A line
above the limit, a share of the host's texts but at least ``least`` and at most ``most`` of them, is removed from every document but the first that has it
(and that one's exact copies), so that a group of copies keeps one whole member. A document is rejected if the base
rules reject it, or if what is left of it is too little: under ``min_words`` words, or under ``min_left`` of its words.

Nulls, ties, repeats: null text counts as empty, has no words and fails the base rule; a null host is a host of its own;
null ids come before others when the first document of a line is sought, and ties in ids go to the smaller text hash;
repeated rows each get the same result; an empty table gives an empty result. Other columns of the input are ignored.
Lines and windows are compared by 64-bit hashes of their words, texts by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

#: Characters between words, and symbols (fixed values).
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS = 10
#: Words in repeated 5-word windows, of 100 words, above which the base rule fails.
MAX_REPEATED = 20


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.when(k + 1 < F.size(places), F.least(F.lit(5), F.get(places, k + 1) - p)).otherwise(5))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = F.transform(
            pairs,
            lambda x, k: F.struct(
                x["i"].alias("i"),
                (F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))).alias("f"),
            ),
        )
        return let(F.sort_array(F.transform(F.filter(same, lambda y: y["f"]), lambda y: y["i"])), covered)

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, twice))

    return F.when(F.size(words) < 5, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda wh: let(hashed(wh), counted)))


def words_of(x: Column) -> Column:
    return F.filter(F.split(F.translate(x, "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")


def facts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, host, text) without text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    text_hash, and ``lines``, the hash (of the words in lower case) and number of words of each line that has a word. The
    text is read and split once."""
    text = F.coalesce("text", F.lit(""))

    def counted(lines: Column) -> Column:
        raw = F.transform(lines, lambda x: x["raw"])
        words = F.flatten(F.transform(lines, lambda x: x["w"]))
        return F.struct(
            F.transform(lines, lambda x: F.struct(F.xxhash64(F.lower(F.array_join(x["w"], " "))).alias("h"), F.size(x["w"]).alias("w"))).alias("lines"),
            (F.size(raw) - F.size(F.array_distinct(raw))).cast("long").alias("n_dup_lines"),
            let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        )

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("raw"), words_of(x).alias("w"))), lambda x: F.size(x["w"]) > 0)
    found = docs.select(
        "doc_id",
        "host",
        F.xxhash64(text).alias("text_hash"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, counted).alias("x"),
    )
    n, repeated = F.col("x.w.n_words"), F.col("x.w.n_repeat_words")
    return found.select(
        "doc_id", "host", "text_hash", n.alias("n_words"), "word_chars", "n_symbols", "x.n_dup_lines", repeated.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)).alias("base_failed"), "x.lines",
    )


def frequent_lines(known: DataFrame, share: float, least: int, most: int) -> DataFrame:
    """(host, line, first_hash) of lines in more than ``share`` of their host's texts, or in more than ``most``, and in more
    than ``least``.

    What moves is a hash and an id for each distinct line of a document, summed up before each shuffle. A null line
    stands for the document itself, so its count is the number of texts of the host. A text has few lines, so at most
    lines-per-text / share lines of a host, or all its lines / ``most``, can be frequent: the result is small beside the
    corpus.
    """
    hashes = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    held = known.select("host", "doc_id", "text_hash", F.explode(F.concat(hashes, F.array(F.lit(None).cast("long")))).alias("line"))
    texts = held.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    counted = texts.groupBy("host", "line").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
    counted = saved(counted.where((F.col("n") > least) | F.col("line").isNull()))
    hosts = counted.where(F.col("line").isNull()).select(F.col("host").alias("_host"), F.col("n").alias("_texts"))
    return (
        counted.where(F.col("line").isNotNull())
        .join(small(hosts, hosts.count()), F.col("host").eqNullSafe(F.col("_host")))
        .where((F.col("n") > least) & (F.col("n") > F.least(F.col("_texts") * F.lit(float(share)), F.lit(float(most)))))
        .select("host", "line", F.col("first.text_hash").alias("first_hash"))
    )


def removed_words(known: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, n_removed) of documents that lose lines."""
    frequent = saved(frequent)
    marks = small(frequent.select(F.col("host").alias("_host"), F.col("line").alias("_line"), "first_hash"), frequent.count())
    held = known.select("doc_id", "host", "text_hash", F.posexplode("lines").alias("i", "x")).select("doc_id", "host", "text_hash", "i", "x.h", "x.w")
    gone = held.join(marks, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_line")) & (F.col("text_hash") != F.col("first_hash")))
    taken = gone.groupBy("doc_id", "host", "text_hash").agg(F.collect_set(F.struct("i", "w")).alias("x"))  # a set: repeated rows count once
    return taken.select("doc_id", "host", "text_hash", F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("n_removed"))


def judge(docs: DataFrame, share: float = 0.05, least: int = 10, most: int = 1000, min_words: int = MIN_WORDS, min_left: float = 0.4) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, host): the base counts, base_failed, n_removed, kept, and the
    host and text_hash that tell rows of one doc_id apart."""
    known = saved(facts(docs.select("doc_id", "text", "host")))
    removed = saved(removed_words(known, frequent_lines(known, share, least, most)))
    side = removed.select(F.col("doc_id").alias("_id"), F.col("host").alias("_h"), F.col("text_hash").alias("_t"), "n_removed")
    base = known.drop("lines")
    joined = base.join(
        small(side, removed.count()),
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("host").eqNullSafe(F.col("_h")) & (F.col("text_hash") == F.col("_t")),
        "left",
    )
    left = F.col("n_words") - F.coalesce("n_removed", F.lit(0))
    depleted = (left < min_words) | (left < F.col("n_words") * F.lit(min_left))
    return joined.select(*base.columns, F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), (~F.col("base_failed") & ~depleted).alias("kept"))


def accepted(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever the names."""
    verdict = judge(docs.select("doc_id", "text", F.col(host).alias("host")), **limits)
    bad = saved(verdict.where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("host").alias("h"), F.col("text_hash").alias("t")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col(f"row.{host}").eqNullSafe(F.col("h")) & (F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))) == F.col("t"))
    return rows.join(small(bad, bad.count()), same, "left_anti").select("row.*")
