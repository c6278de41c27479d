"""Scalar functions over texts, numbers and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import views


def number_formats(spark, sf):
    v = F.floor(F.col("l_extendedprice")) / 8
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%.3f", v).alias("plain"), S.stripped_zeros(F.format_string("%.3f", v)).alias("short"), S.nepali_digits(F.format_string("%.3f", v)).alias("nepali"))


def numbers_of_texts(spark, sf):
    """Numbers in the documents, and those that a fixed list allows."""
    found = S.numbers_in(F.col("text"))
    docs = views.table(spark, sf, "documents").select("doc_id", found.alias("found"))
    return docs.select("doc_id", F.array_join("found", " ").alias("numbers"), F.size(F.array_except("found", F.array(F.lit("1"), F.lit("2")))).alias("foreign"))


def script_shares(spark, sf):
    docs, k = views.table(spark, sf, "documents"), F.col("doc_id")
    mixed = F.concat(F.repeat(F.lit("ठाउँ१ "), (k % 5).cast("int")), F.repeat(F.lit("ab-"), (k % 7).cast("int")))
    name = F.concat(F.col("lang"), F.when(k % 3 == 0, F.lit("漢")).when(k % 3 == 1, F.lit("ठाउँ’")).otherwise("é"))
    return docs.select("doc_id", F.round(S.script_share(F.col("text"), r"[a-zA-Z]"), 6).alias("latin"), F.round(S.script_share(mixed), 6).alias("local"), S.readable(name).alias("readable"))


def event_attributes(spark, sf):
    """JSON attributes, typed; lists from text; the object inside an answer."""
    e = views.table(spark, sf, "events")
    n = (F.col("event_id") % 4).cast("int")
    listed = F.when(F.col("event_id") % 2 == 0, F.concat(F.repeat(F.lit(" a , ,"), n), F.col("event_type"))).otherwise(F.concat(F.lit('["x, y"'), F.repeat(F.lit(', "b"'), n), F.lit("]")))
    answer = F.concat(F.lit("<think>{x}</think>\n```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", F.get_json_object(S.json_object(answer), "$.k").cast("int").alias("k"), F.array_join(S.split_list(listed), "|").alias("items"))


def event_times(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select("event_id", S.local_time(F.col("ts")).alias("local"), S.feed_time(F.col("ts")).alias("feed"), S.epoch_days(F.col("ts")).alias("days"), S.lead_hours(F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("lead"))


def place_names(spark, sf):
    s = views.sites(spark, sf)
    own = F.when(F.col("site_id") % 3 == 0, F.col("code")).when(F.col("site_id") % 3 == 1, "")
    near = F.when(F.col("site_id") % 2 == 0, F.concat(F.lit("near "), F.col("code")))
    return s.select("site_id", S.place_name(own, near, F.concat(F.initcap("kind"), F.lit(" "), F.col("site_id"))).alias("name"), S.platform_code(F.concat(F.lit("platform-"), F.col("site_id") % 4, F.lit("b"))).alias("platform"), S.utm_zone(F.col("lon"), F.col("lat")).alias("epsg"))


def tile_split(spark, sf):
    """Training and validation tiles by a hash of the key."""
    key = F.concat_ws(":", F.col("cell"), F.lit("t"), F.lit(3))
    share = S.split_share(key)
    return views.cell_velocities(spark, sf).select("cell").distinct().select("cell", share.alias("share"), F.when(share < 200, "val").otherwise("train").alias("split"))


def sliding_windows(spark, sf):
    """Starts of windows over the rows of each area's grid."""
    n = (200 + F.col("n_nationkey") * 37).cast("int")
    return views.table(spark, sf, "nation").select("n_nationkey", F.array_join(F.transform(S.window_starts(n, 224, 160), lambda x: x.cast("string")), ",").alias("starts"))


def escaped_titles(spark, sf):
    """Titles of pages, escaped for a feed."""
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    return views.table(spark, sf, "pages").select("page_id", S.xml_text(title).alias("title"), F.length(title).alias("n"))


QUERIES = {f.__name__: f for f in (number_formats, numbers_of_texts, script_shares, event_attributes, event_times, place_names, tile_split, sliding_windows, escaped_titles)}
_DIGITS = "translate(printf('%.3f', floor(l_extendedprice) / 8), '0123456789', '०१२३४५६७८९')"
#: The whole digest as one number, modulo a thousand, digit by digit.
SHA_MOD = "0"
for _k in range(1, 41):
    SHA_MOD = f"(({SHA_MOD}) * 16 + instr('0123456789abcdef', h[{_k}]) - 1) % 1000"
ORACLES = {
    "number_formats": f"SELECT l_orderkey, l_linenumber, printf('%.3f', floor(l_extendedprice) / 8) AS plain, regexp_replace(printf('%.3f', floor(l_extendedprice) / 8), '\\.?0+$', '') AS short, {_DIGITS} AS nepali FROM lineitem",
    "event_attributes": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 2 = 0 THEN repeat('a|', event_id % 4) || event_type ELSE 'x, y' || repeat('|b', event_id % 4) END AS items FROM events",
    "event_times": "SELECT event_id, strftime(ts + INTERVAL 345 MINUTES, '%Y-%m-%d %H:%M') || ' NPT' AS local, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS feed, (ts::DATE - DATE '2015-01-01')::INTEGER AS days, date_diff('microsecond', ts, TIMESTAMP '2024-01-30') / 3.6e9::DOUBLE AS lead FROM events",
    "place_names": f"WITH {views.SITES} SELECT site_id, CASE WHEN site_id % 3 = 0 THEN code WHEN site_id % 2 = 0 THEN 'near ' || code ELSE upper(kind[1]) || kind[2:] || ' ' || site_id END AS name, 'S' || site_id % 4 || 'B' AS platform, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6)::INTEGER + 1)::INTEGER AS epsg FROM site",
    "sliding_windows": "WITH n AS (SELECT n_nationkey, greatest(200 + n_nationkey * 37 - 224, 0) AS last FROM nation), s AS (SELECT n_nationkey, unnest(list_distinct(list_concat(range(0, last + 1, 160), [last]))) AS x FROM n) SELECT n_nationkey, string_agg(x, ',' ORDER BY x) AS starts FROM s GROUP BY 1",
    "tile_split": f"WITH {views.CELLS}, h AS (SELECT DISTINCT cell, sha1(cell || ':t:3') AS h FROM cellv), m AS (SELECT cell, {SHA_MOD} AS share FROM h) SELECT cell, share::BIGINT AS share, CASE WHEN share < 200 THEN 'val' ELSE 'train' END AS split FROM m",
    "escaped_titles": "WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t FROM pages) SELECT page_id, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS title, length(t)::INTEGER AS n FROM t",
    "script_shares": "SELECT doc_id, round(coalesce(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\\pL]', '', 'g')), 0), 0), 6) AS latin, round(coalesce(2 * (doc_id % 5) / nullif(2 * (doc_id % 5) + 2 * (doc_id % 7), 0), 0), 6) AS local, coalesce(lang IS NOT NULL AND doc_id % 3 <> 0, false) AS readable FROM documents",
    "numbers_of_texts": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS x FROM documents), d AS (SELECT DISTINCT doc_id, try_cast(replace(x, ',', '') AS DECIMAL(30, 4))::VARCHAR AS x FROM w WHERE try_cast(replace(x, ',', '') AS DECIMAL(30, 4)) IS NOT NULL),
 s AS (SELECT DISTINCT doc_id, regexp_replace(x, '\\.?0+$', '') AS x FROM d) SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY x), '') AS numbers, count(CASE WHEN x NOT IN ('1', '2') THEN 1 END)::INTEGER AS "foreign" FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1""",
}
