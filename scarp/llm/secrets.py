"""Secret scan: fixed patterns, and novelty by a dictionary-primed zstandard compressor.

A candidate is a long string with digits, or of letters that mix both cases as no name does, that stands in a sensitive
context (a word such as ``secret`` shortly before it, the name of ``name=value`` included; only the value is measured).
Letters of one case without a digit can't be told from a word and are no candidate.
Its novelty is the number of bytes that it adds to the compressed code around it, once the compressor knows a dictionary
of the corpus's common identifiers. Ordinary identifiers and repeated values cost little; a random string costs nearly
its entropy, and is reported as a span of kind ``novel`` unless a base span already covers it.

The dictionary counts identifiers over all documents, by the number of different contexts that they stand in, so copies of
one document don't make its secret an identifier. A string in a sensitive context is counted only if it reads as a name,
so a random key stays novel in however many places it leaked; a secret that reads as a name can't be told from one. The
least number of contexts grows with the documents (``min_share``), the dictionary's size is fixed (``dictionary_bytes``).

Nulls, ties, repeats: null text counts as empty; a null id is kept; equal starts are ordered by kind as listed; ties for a
place in the dictionary go to the smaller string; repeated rows get equal results; an empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Each match of ASSIGN holds one of these in lower case.
HEADS = ("passw", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile(r"pass|secret|token|api_?key|credential|private|auth|bearer|pwd|signature|access", re.I | re.A)
PART = r"[A-Za-z0-9+/_.-]"
#: Letters of one word of a name: a capital and small letters, or capitals.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGIT = re.compile(r"[0-9]")
RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
BESIDE = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
#: Random letters of both cases change case so often that the words they seem to make are this short on average.
SHORT_WORD = 3.5
CONTEXT, AROUND = 48, 160


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = []
    low = text.lower()
    if any(h in low for h in HEADS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def value_pattern(least: int) -> re.Pattern:
    """A run of the characters of a string. An ``=`` between two runs parts a name from its value; at the end it is padding."""
    return re.compile(rf"(?<!{PART})(?={PART[:-1]}=]{{{least}}}){PART}++(?:=++(?!{PART}))?")


def irregular(value: str) -> bool:
    """Whether a string holds a digit or, where it has none, mixes both cases as no name does."""
    if DIGIT.search(value):
        return True
    found = WORD.findall(value)
    return value.lower() != value != value.upper() and sum(map(len, found)) <= SHORT_WORD * len(found)


def strings(text: str, least: int, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Places of irregular strings of at least ``least`` characters, by their ``value_pattern``: each runs as far as it can
    either way, up to an ``=``."""
    return [m.span() for m in pattern.finditer(text) if m.end() - m.start() >= least and irregular(m[0])]


def named(value: str) -> bool:
    """Whether a string reads as a name: of words and numbers that are long on average, with few digits beside letters."""
    found = RUN.findall(value)
    return sum(map(len, found)) > SHORT_WORD * len(found) and 12 * len(BESIDE.findall(value)) <= len(value)


def sensitive(text: str, at: int) -> bool:
    return SENSITIVE.search(text, max(0, at - CONTEXT), at) is not None


def contexts(docs: DataFrame, least: int) -> DataFrame:
    """(string, whole, context) of all irregular strings in the corpus that may be identifiers there: not of those in
    sensitive contexts that don't read as names. ``whole`` is a hash of the string, of which 256 characters are kept, and
    ``context`` a hash of what stands before it."""

    pattern = value_pattern(least)

    def emit(batches):
        for batch in slices(batches):
            out = {}
            for text in batch.column(0).to_pylist():
                for a, b in strings(text, least, pattern) if text else ():
                    value = text[a:b]
                    if named(value) or not sensitive(text, a):
                        whole = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)
                        out[value[:256], whole, zlib.crc32(text[max(0, a - 24) : a].encode("utf-8", "replace"))] = None
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["string", "whole", "context"])

    return docs.select("text").mapInArrow(emit, "string string, whole long, context long")


def identifiers(docs: DataFrame, least: int, min_contexts: int, dictionary_bytes: int, min_share: float = 0.0001) -> bytes:
    """The dictionary: the identifiers with the most contexts, the most frequent last, where the compressor looks first.
    They have ``min_contexts`` contexts at least, and ``min_share`` of the number of documents."""
    counted = contexts(docs, least).distinct().groupBy("string", "whole").agg(F.count("*").alias("n"))
    bound = max(min_contexts, min_share * docs.count())
    top = counted.where(F.col("n") >= bound).orderBy(F.desc("n"), "string", "whole").limit(dictionary_bytes // least).collect()
    words = " = \"' : ; password secret token api_key apikey credential authorization Bearer private access signature\n".encode()
    body = b""
    for row in top:
        piece = row["string"].encode() + b"\n"
        if len(body) + len(piece) > dictionary_bytes:
            break
        body = piece + body
    return body + words


def novel_spans(text: str, base: list, compressor, least: int, min_bytes: float, pattern: re.Pattern | None = None) -> list[tuple[int, int, int]]:
    found = []
    starts, ends = [s for s, _, _ in base], [*accumulate((e for _, _, e in base), max)]
    for a, b in strings(text, least, pattern or value_pattern(least)):
        before = bisect_right(starts, a)
        if before and ends[before - 1] >= b or not sensitive(text, a):
            continue
        before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
        rest = len(compressor.compress((before + after).encode("utf-8", "replace")))
        whole = len(compressor.compress((before + text[a:b] + after).encode("utf-8", "replace")))
        if whole - rest >= min_bytes * (b - a):
            found.append((a, 3, b))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, least: int = 16, min_bytes: float = 0.5, min_contexts: int = 5, dictionary_bytes: int = 32768, mask: str | None = None, min_share: float = 0.0001) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    ``min_bytes`` is the least growth of the compressed text for each character of a novel string. With ``mask``, all
    columns of ``docs`` are returned instead, each span in ``text`` replaced by ``mask``.
    """
    dictionary = identifiers(docs, least, min_contexts, dictionary_bytes, min_share)
    pattern = value_pattern(least)  # closed over: what a cached function holds does not travel to executors

    def spans_of(text: str, compressor) -> tuple[list, list]:
        base = base_spans(text)
        return base, novel_spans(text, base, compressor, least, min_bytes, pattern)

    def primed():
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def report(batches):
        compressor = primed()
        for batch in slices(batches):
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
            for text in batch.column("text").to_pylist():
                base, new = spans_of(text or "", compressor)
                for k in range(3):
                    rows[f"n_{KINDS[k]}"].append(sum(x[1] == k for x in base))
                rows["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                rows["spans"].append(written(sorted(base + new)))
                rows["n_novel"].append(len(new))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in rows.items()]], ["doc_id", *rows]
            )

    def masked(batches):
        compressor = primed()
        for batch in slices(batches):
            texts = []
            for text in batch.column("text").to_pylist():
                base, new = spans_of(text or "", compressor)
                at, out = 0, []
                for a, _, b in sorted(base + new):
                    if b > at:
                        if a >= at:
                            out += [text[at:a], mask]
                        at = b
                texts.append("".join([*out, text[at:]]) if base or new else text)
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    if mask is not None:
        return docs.mapInArrow(masked, docs.schema)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(report, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
