"""Scalar functions as Column expressions; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the two scripts (fixed values).
ASCII_DIGITS, NEPALI_DIGITS = "0123456789", "०१२३४५६७८९"


def nepali_digits(s: Column) -> Column:
    return F.translate(s, ASCII_DIGITS, NEPALI_DIGITS)


def ascii_digits(s: Column) -> Column:
    return F.translate(s, NEPALI_DIGITS, ASCII_DIGITS)


def stripped_zeros(s: Column) -> Column:
    """A decimal text without trailing zeros and dot."""
    return F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def short_number(v: Column, language: Column | None = None) -> Column:
    """No decimals from 20 on, one from 2 on, else two; trailing zeros go. Ties round half up."""
    size = F.abs(v)
    text = F.when(size >= 20, F.format_string("%.0f", v)).when(size >= 2, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    out = stripped_zeros(text)
    return out if language is None else F.when(language == "ne", nepali_digits(out)).otherwise(out)


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text in their shortest form, thousands' commas dropped."""
    found = F.transform(F.regexp_extract_all(ascii_digits(text), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("decimal(30,4)"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: stripped_zeros(x.cast("string")))))


def script_share(text: Column, letters: str = r"\p{InDevanagari}") -> Column:
    """Letters of a script among all letters; 0 without letters."""
    every = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(text, rf"[^\p{{L}}&&{letters}]", ""))
    return F.coalesce(F.try_divide(own, every), F.lit(0.0))


def readable(name: Column) -> Column:
    """Not empty, and only Latin and Devanagari characters and a few quotation marks and dashes."""
    return F.coalesce(name.rlike(r"^[\x{0}-\x{24F}\p{InDevanagari}’‘–—]+$"), F.lit(False))


def place_name(own: Column, near: Column, generic: Column) -> Column:
    """The first of the names that isn't empty."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(near, F.lit("")), generic)


def platform_code(s: Column) -> Column:
    """Short code from the digit and letter that end a platform's name."""
    digit, letter = (F.regexp_extract(s, r"(\d)([a-dA-D])\s*$", k) for k in (1, 2))
    return F.when(digit != "", F.concat(F.lit("S"), digit, F.upper(letter))).otherwise(F.coalesce(s, F.lit("unknown")))


def json_object(text: Column) -> Column:
    """The object in a model's answer: what stands between its thoughts and their end goes, then all from the first brace to
    the last; null without both."""
    thought = F.instr(text, "</think>")
    said = F.when(thought > 0, F.substring(text, thought + F.lit(8), F.length(text))).otherwise(text)
    inner = F.concat(F.lit("{"), F.substring(said, F.instr(said, "{") + 1, F.length(said)))
    upto = F.concat(F.substring_index(inner, "}", -1), F.lit(""))
    whole = F.substring(inner, F.lit(1), F.length(inner) - F.length(upto))
    return F.when((F.instr(said, "{") > 0) & (F.instr(inner, "}") > 0), whole)


def split_list(text: Column) -> Column:
    """Items of a JSON list, or of a comma-separated text."""
    listed = F.from_json(text, "array<string>")
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(text).startswith("["), listed).otherwise(parts)


def instant(text: Column) -> Column:
    """A time as catalogues write it: with Z or an offset, or without either, then in UTC."""
    plain = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    zoned = F.when(plain.rlike(r"[+-]\d{2}:?\d{2}$"), plain).otherwise(F.concat(plain, F.lit("+00:00")))
    return F.try_to_timestamp(F.replace(zoned, F.lit(" "), F.lit("T")))


def local_time(at: Column) -> Column:
    """Nepal time as text; a dash for null."""
    return F.coalesce(F.concat(F.date_format(F.from_utc_timestamp(at, "Asia/Kathmandu"), "yyyy-MM-dd HH:mm"), F.lit(" NPT")), F.lit("–"))


def feed_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def epoch_days(at: Column) -> Column:
    """Whole days since 2015-01-01."""
    return F.date_diff(F.to_date(at), F.lit("2015-01-01").cast("date"))


def lead_hours(event: Column, at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", at, event) / F.lit(3.6e9)


def split_share(key: Column, modulus: int = 1000) -> Column:
    """A number below ``modulus`` from a key's SHA-1, read as one integer: in pieces, so no step overflows."""
    digest = F.sha1(key)
    value = F.lit(0).cast("long")
    for k in range(0, 40, 8):
        part = F.conv(F.substring(digest, k + 1, 8), 16, 10).cast("long")
        value = (value * ((1 << 32) % modulus) + part) % modulus
    return value


def xml_text(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone."""
    return F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6).cast("int") + 1


def window_starts(length: Column, size: int, stride: int) -> Column:
    """Starts of sliding windows that cover a length, the last one at the end."""
    last = F.greatest(length - size, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
