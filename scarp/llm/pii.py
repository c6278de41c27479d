"""Personal data by fixed patterns and by bootstrapped contexts. DataFrame functions only.

The base patterns (email, ip, card, phone) give seed entities. The two words before a seed are a lexical pattern; other
identifier-like strings, and the words before them, make up the rest of the graph of patterns and instances. In each
round a pattern's score is the summed confidence of its instances over that sum and the evidence against it, if enough
different instances support it; an instance that is no seed is as sure as 1 - prod(1 - score) of its patterns. Evidence
against a pattern are instances that also stand after an ordinary pattern, one with enough instances of which none is a
seed. An instance seen nowhere else speaks neither for nor against, so sure patterns find unseen identifiers, and these
support further patterns. Rounds go on until no pattern changes. Instances that end above the threshold are reported as
spans of kind ``context``, unless they overlap a base span.

Spans come from two native calls on one pattern: the pieces between matches and the matches; their lengths summed up
give the places, in code points. The regular expressions have no loops over groups but possessive ones, so no text can exhaust the stack:
a joint inside a number or a host name is first replaced by a private-use character of the same length.

Nulls, ties, repeats: null text counts as empty; a null id is kept as it is; equal starts are ordered by kind as listed;
repeated rows get equal results; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

JOINT, DOT = "\ue000", "\ue001"
LOCAL = r"A-Za-z0-9._%+\-" + DOT
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]+{DOT}[A-Za-z0-9{DOT}-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{JOINT}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Strings that look like identifiers: letters or none, a digit, and what follows; of five characters at least. A possessive
#: loop over a group is no recursion.
CANDIDATE = r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]++)*+"
CANDIDATE_CHARS = 5
OCTET = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
KINDS = ("email", "ip", "card", "phone")
#: The two words before an instance, in reversed text.
BEFORE = r"^[\x20\x09-\x0D\"'(=:]*+([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)"
BLOCK = 64
#: More rounds than any graph has needed; a graph that needs more is an error.
ROUNDS = 50


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def summed(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def before(lengths: Column, sums: Column, i: Column) -> Column:
    """Sum of ``lengths`` before place i; ``sums`` are those before each block, so that a text with very many matches
    doesn't take the square of their number."""
    block = F.floor(i / BLOCK).cast("int")
    return F.get(sums, block) + summed(F.slice(lengths, block * BLOCK + 1, i % BLOCK))


def pattern_of(left: Column) -> Column:
    """Hash of the last two words of the piece before an instance, in lower case; null if there are none."""
    two = F.regexp_extract(F.reverse(left), BEFORE, 1)
    return F.when(two != "", F.xxhash64(F.lower(two)))


def found(text: Column, pattern: str, order: int) -> Column:
    """Array of (start, end, kind, value, pattern) of the matches of ``pattern``."""
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string,pattern:bigint>>)")

    def placed(x: Column) -> Column:
        matches, gaps = x["m"], x["g"]
        lengths = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))

        def spans(n: Column) -> Column:
            each = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: summed(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
            sums = F.aggregate(each, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

            def one(s: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    start = before(n, s, i) + F.length(F.get(gaps, i))
                    return F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + F.length(m)).alias("end"), m.alias("value"), pattern_of(F.get(gaps, i)).alias("pattern"))

                return F.transform(matches, span)

            return let(sums, one)

        return let(lengths, spans)

    def pieces(m: Column) -> Column:
        return F.when(F.size(m) == 0, none).otherwise(let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g")), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pieces)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""

    def term(i: Column) -> Column:
        d = F.substr(number, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((F.length(number) - 1 - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return summed(F.transform(F.sequence(F.lit(0), F.length(number) - 1), term)) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of the base spans, by start, then kind."""
    clean = F.regexp_replace(text, f"[{JOINT}{DOT}]", "\ufffd")
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    none = F.slice(found(F.lit(""), IP, 0), 1, 1)
    with_digits = text.rlike("[0-9]")
    email = F.when(text.contains("@"), let(dotted, lambda t: found(t, EMAIL, 0))).otherwise(none)
    ip = F.when(with_digits, F.filter(found(text, IP, 1), lambda x: F.forall(F.split(x["value"], r"\."), lambda p: p.rlike(OCTET)))).otherwise(none)

    def is_card(x: Column) -> Column:
        return let(digits(x["value"]), lambda n: F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False))

    card = F.when(with_digits, F.filter(let(joined, lambda t: found(t, CARD, 2)), is_card)).otherwise(none)
    phone = F.when(with_digits & text.contains("+"), F.filter(found(text, PHONE, 3), lambda x: F.length(digits(x["value"])).between(10, 15))).otherwise(none)
    return F.sort_array(F.concat(email, ip, card, phone))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, other): the base spans and the other identifier-like strings of each row."""
    text = F.coalesce("text", F.lit(""))
    none = F.slice(found(F.lit(""), IP, 0), 1, 1)
    other = F.when(text.rlike("[0-9]"), F.filter(found(text, CANDIDATE, 4), lambda x: (F.length(x["value"]) >= CANDIDATE_CHARS) & x["pattern"].isNotNull())).otherwise(none)
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), base_spans(text).alias("base"), other.alias("other"))


def contextual(marks: DataFrame, support: int, least: float, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, start, end) of strings outside the base patterns whose contexts are those of seeds.

    Rows are one for each pattern and instance, so a frequent pattern is a sum before it is shuffled. Only patterns
    above the threshold are joined back; they are few, and sent to all executors if they are counted to be.
    """
    mentions = marks.select("doc_id", "text_hash", F.explode(F.concat("base", "other")).alias("x")).select(
        "doc_id", "text_hash", "x.start", "x.end", (F.col("x.kind") < 4).alias("seed"), F.xxhash64("x.value").alias("instance"), F.col("x.pattern").alias("pattern")
    )
    mentions = mentions.where(F.col("pattern").isNotNull())
    edges = saved(mentions.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    known = edges.groupBy("instance").agg(F.max("seed").alias("known")).where("known").select(F.col("instance").alias("_instance"))
    edges = edges.join(known, F.col("instance") == F.col("_instance"), "left").select("pattern", "instance", F.col("_instance").isNotNull().alias("seed"))
    plain = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("seed").alias("k")).where((F.col("n") >= support) & (F.col("k") == 0)).select(F.col("pattern").alias("_pattern"))
    contrary = edges.where(~F.col("seed")).join(plain, F.col("pattern") == F.col("_pattern"), "left_semi").select(F.col("instance").alias("_instance")).distinct()
    edges = saved(edges.join(contrary, F.col("instance") == F.col("_instance"), "left").select("pattern", "instance", "seed", F.col("_instance").isNotNull().alias("against")))
    sure = edges.select("*", F.col("seed").cast("double").alias("p"))
    good, before = None, None
    for _ in range(rounds):
        good = (
            sure.groupBy("pattern")
            .agg(F.sum(F.when(~F.col("against"), F.col("p")).otherwise(0.0)).alias("s"), F.count_if("against").alias("c"), F.count_if(F.col("p") >= least).alias("k"))
            .where((F.col("k") >= support) & (F.col("s") >= least * (F.col("s") + F.col("c"))))
            .select("pattern", (F.col("s") / (F.col("s") + F.col("c") + 1)).alias("score"))
        )
        good = saved(good)
        now = tuple(good.agg(F.count("*"), F.sum(F.xxhash64("pattern").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        one = edges.join(small(good, now[0]), "pattern").groupBy("instance", "against").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("q"))
        one = saved(one.select(F.col("instance").alias("_instance"), F.when(F.col("seed"), 1.0).when(F.col("against"), 0.0).otherwise(F.col("q")).alias("q")))
        sure = edges.join(small(one, one.count()), F.col("instance") == F.col("_instance"), "left").select(*edges.columns, F.coalesce("q", F.col("seed").cast("double")).alias("p"))
    else:
        raise RuntimeError(f"patterns did not settle in {rounds} rounds")
    new = saved(sure.where(~F.col("seed") & (F.col("p") >= least)).select(F.col("instance").alias("_instance")).distinct())
    fine = small(good.select(F.col("pattern").alias("_pattern")), good.count())
    return (
        mentions.where(~F.col("seed"))
        .join(small(new, new.count()), F.col("instance") == F.col("_instance"), "left_semi")
        .join(fine, F.col("pattern") == F.col("_pattern"), "left_semi")
        .select("doc_id", "text_hash", "start", "end")
        .distinct()
    )


def detect(docs: DataFrame, support: int = 5, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts by kind, base_sha256, spans, n_context, and n_spans, the
    number of all."""
    marks = saved(marked(docs.select("doc_id", "text")))
    new = contextual(marks, support, least)
    new = saved(new.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t")).agg(F.collect_list(F.struct("start", "end")).alias("new")))
    joined = marks.join(small(new, new.count()), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_t")), "left")
    clear = F.filter(F.col("new"), lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    extra = F.transform(clear, lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("kind"), c["end"].alias("end"), F.lit("").alias("value"), F.lit(None).cast("long").alias("pattern")))
    joined = joined.withColumn("extra", F.coalesce(extra, F.slice("base", 1, 0)))

    def n(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return joined.select(
        "doc_id",
        *[n(k) for k in range(4)],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.sort_array(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_context"),
        (F.size("base") + F.size("extra")).cast("long").alias("n_spans"),
    )
