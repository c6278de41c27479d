"""Fact sheets of alerts, their texts in two languages, and what a validator finds in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import scalars as S
from ..operators import alerts, joins, tables
from ..sources import views

URL = "https://example.org/map"
#: A number that no fact of any sheet holds.
NO_FACT = "98765432109876"
_CODES = tuple(P.REASON)
_VALUES = {c: (0.37, 12.3, 21.7, 151.0, 37.2, 0.26, 1.0, 2.71, 0.83, 3.0, 433.0, 0.314, 31.6, 0.159, 3.49, 61.2)[k] for k, c in enumerate(_CODES)}


def _sheets(spark, sf):
    """An alert for each site: its level, a kind, two reasons, and the assets of its area within 20 km as places."""
    k = F.col("site_id")
    s = views.sites(spark, sf)
    a = s.select(
        "site_id", F.when(k % 9 == 0, "all_clear").when(k % 4 == 0, "update").otherwise("alert").alias("kind"), F.when(F.col("level") == "unknown", "low").otherwise(F.col("level")).alias("level"), "code", F.col("kind").alias("site_kind"),
        F.concat(F.lit("Place "), k).alias("site_en"), F.when(k % 5 == 0, F.concat(F.lit("Place "), k)).otherwise(F.lit("ठाउँ")).alias("site_ne"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.when(k % 6 != 0, 3000.0 + k).alias("elevation_m"),
        F.date_format(F.from_utc_timestamp(F.timestamp_seconds(1706000000 + k * 3600), "Asia/Kathmandu"), "yyyy-MM-dd HH:mm").alias("seen_at"), (k % 7 == 0).alias("needs_confirmation"), F.lit("1155").alias("hotline"), F.concat(F.lit(f"{URL}/#site="), "code").alias("url"),
    )
    value = F.create_map(*[F.lit(x) for p in _VALUES.items() for x in p])
    rows = s.select("site_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).withColumn("code", F.get(F.array(*[F.lit(c) for c in _CODES]), ((F.col("site_id") + F.col("j") * 5) % 16).cast("int")))
    rows = rows.select("site_id", "code", value[F.col("code")].alias("value"), ((F.col("site_id") * 7 + F.col("j") * 31) % 100 / 100.0 + 0.001).alias("contribution"))
    n = F.col("asset_id")
    named = views.assets(spark, sf).select("kind", "aoi", "lon", "lat", F.when(n % 7 != 0, F.col("name")).otherwise("").alias("name_en"), F.when(n % 3 == 0, F.lit("गाउँ")).otherwise("").alias("name_ne")).where("name_en <> '' or name_ne <> ''")
    # Of one kind at one place only the first names can be among a site's first places, and sites at one place share theirs.
    few = tables.top_by(named, ["kind", "aoi", "lon", "lat"], alerts.MOST_PLACES, F.col("name_en"), F.col("name_ne")).drop("place")
    near = joins.close_pairs(s.select("aoi", "lon", "lat").distinct(), few, 20.0, ("aoi",))
    near = near.select(F.col("l_aoi").alias("aoi"), F.col("l_lon").alias("lon"), F.col("l_lat").alias("lat"), F.col("r_kind").alias("kind"), F.col("r_name_en").alias("name_en"), F.col("r_name_ne").alias("name_ne"), (F.round("km", 4) * 1000 / 8 / 60).alias("minutes"), F.round("km", 4).alias("km"))
    first = tables.top_by(near, ["aoi", "lon", "lat"], alerts.MOST_PLACES, *alerts.order_of_places()).drop("place")
    exposed = s.select("site_id", "aoi", "lon", "lat").join(first, ["aoi", "lon", "lat"]).drop("aoi", "lon", "lat")
    told = alerts.reasons(rows, ["site_id"])
    empty = F.array().cast("array<struct<code:string,text_en:string,text_ne:string>>")
    out = alerts.fact_sheets(a.join(told, "site_id", "left"), exposed)
    out = out.withColumn("reasons", F.coalesce("reasons", empty)).withColumn("places", F.coalesce("places", F.array().cast(alerts.PLACES)))
    # Sheets are few and small, their texts are the work: they are spread over all cores, not by size.
    return out.repartition(4 * spark.sparkContext.defaultParallelism, "site_id")


def alert_messages(spark, sf):
    return alerts.composed(_sheets(spark, sf)).select("site_id", *alerts.TEXTS)


def alert_reasons(spark, sf):
    """What each indicator says at several values, in both languages."""
    v = F.col("l_linenumber") * 7.31 + F.col("l_suppkey") % 3
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (F.col("l_partkey") % 16).cast("int"))
    rows = views.table(spark, sf, "lineitem").select(code.alias("code"), F.round(v, 2).alias("value")).distinct()
    return rows.select("code", "value", P.reason_text(F.col("code"), F.col("value"), "en").alias("en"), P.reason_text(F.col("code"), F.col("value"), "ne").alias("ne"))


def message_issues(spark, sf):
    """The validator on the sheets' own texts, some of which are spoilt in one way each."""
    k = F.col("site_id")
    spoilt = {
        "title_en": F.when(k % 10 == 1, F.lit("")).when(k % 10 == 2, F.concat("title_en", F.lit(f" {NO_FACT}"))).otherwise(F.col("title_en")),
        "body_en": F.when(k % 10 == 3, F.replace("body_en", *[F.lit(P.FOOTER["en"].replace("{hotline}", h)) for h in ("1155", "1")])).when(k % 10 == 4, F.concat("body_en", F.lit(" It is safe to stay. https://elsewhere.example/x"))).otherwise(F.col("body_en")),
        "body_ne": F.when(k % 10 == 5, F.col("body_en")).otherwise(F.col("body_ne")),
        "sms_ne": F.when(k % 10 == 6, F.lit("केही छैन")).otherwise(F.col("sms_ne")),
        "title_ne": F.when(k % 10 == 6, F.lit("केही छैन")).otherwise(F.col("title_ne")),
    }
    return alerts.composed(_sheets(spark, sf)).select("site_id", F.array_join(alerts.issues(spoilt), ",").alias("issues"))


def fitted_messages(spark, sf):
    """Drafts that are too long give way to the template."""
    drafted = {"sms_en": F.repeat("sms_en", F.when(F.col("site_id") % 2 == 0, 3).otherwise(1)), "title_ne": F.repeat("title_ne", F.when(F.col("site_id") % 3 == 0, 9).otherwise(1)), "body_en": F.repeat("body_en", F.lit(2))}
    out = alerts.composed(_sheets(spark, sf))
    return out.select("site_id", *[F.length(c).alias(k) for k, c in alerts.fitted(drafted).items()])


def subscriber_messages(spark, sf):
    """What each subscriber gets of the high alerts, by language: English, Nepali or both."""
    sheets = alerts.composed(_sheets(spark, sf)).where("level = 'high'").withColumnRenamed("code", "alert_code").withColumn("code", F.col("alert_code"))
    who = sheets.withColumn("language", F.explode(F.array(F.lit("en"), F.lit("ne"), F.lit("both"))))
    out = alerts.message_for(F.col("language"))
    return who.select("site_id", "language", out["subject"].alias("subject"), F.length(out["text"]).alias("text"), F.length(out["sms"]).alias("sms"), F.get_json_object(out["payload"], "$.level").alias("level"), F.size(F.from_json(F.get_json_object(out["payload"], "$.exposed"), "array<string>")).alias("places"))


QUERIES = {f.__name__: f for f in (alert_messages, alert_reasons, message_issues, fitted_messages, subscriber_messages)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(key: str, table: dict, n: str, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v[n])}" for k, v in table.items()) + f" ELSE {default} END"


def _ne(x: str) -> str:
    return f"translate({x}, '{S.ASCII_DIGITS}', '{S.NEPALI_DIGITS}')"


def _digits(x: str, n: str) -> str:
    return _ne(x) if n == "ne" else f"({x})"


def _plain(x: str) -> str:
    """A number with its decimals by size, trailing zeros gone."""
    strip = lambda t: f"CASE WHEN contains({t}, '.') THEN regexp_replace({t}, '\\.?0+$', '') ELSE {t} END"
    return f"CASE WHEN abs({x}) >= 20 THEN printf('%.0f', {x}) WHEN abs({x}) >= 2 THEN {strip(f'printf({_q('%.1f')}, {x})')} ELSE {strip(f'printf({_q('%.2f')}, {x})')} END"


def _fill(text: str, **values: str) -> str:
    out = text
    for k, v in values.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


def _reason(code: str, v: str, n: str) -> str:
    whole, tens, pct = (", ".join(map(_q, x)) for x in (P.WHOLE, P.TENS, P.PERCENT))
    shown = f"CASE WHEN {code} IN ({whole}) THEN printf('%.0f', {v}) WHEN {code} IN ({tens}) THEN printf('%.0f', round({v} / 10) * 10) WHEN {code} IN ({pct}) THEN printf('%.0f', {v} * 100) ELSE {_plain(v)} END"
    return f"CASE WHEN {code} = 'glacier_contact_m' AND {v} < 30 THEN {_q(P.TOUCHES_ICE[n])} ELSE {_fill(_case(code, P.REASON, n), v=_digits(shown, n))} END"


_name = lambda p, n: f"coalesce(nullif({p}.name_{n}, ''), {p}.name_{'en' if n == 'ne' else 'ne'})"
_min = lambda p, n: _digits(f"printf('%.0f', {p}.minutes)", n)


def _texts(n: str) -> str:
    """Columns title, body and sms of the language."""
    lv, hz, kd, site = _case("level", P.LEVEL, n), _case("site_kind", P.HAZARD, n), _case("site_kind", P.SITE_KIND, n), f"site_{n}"
    first, hot = "places[1]", _digits("'1155'", n)
    reached = lambda t: f"CASE WHEN len(places) > 0 THEN {_fill(_q(t[n]), name=_name(first, n), min=_min(first, n))} END"
    footer, clear = _fill(_q(P.FOOTER[n]), hotline=hot), _fill(_q(P.ALL_CLEAR[n]), site=site, level=lv)
    where = "')'" if n == "ne" else "', ' || lat || 'N ' || lon || 'E)'"
    head = f"{lv} || ' — ' || {site} || ' (' || {kd} || CASE WHEN elevation_m IS NOT NULL THEN ', ' || {_digits("printf('%.0f', elevation_m)", n)} || ' {P.METRES[n]}' ELSE '' END || {where}"
    list_ = f"array_to_string(list_transform(places[1:4], lambda p: {_name('p', n)} || ' (~' || {_min('p', n)} || ' {P.MINUTES[n]})'), ', ')"
    told = f"CASE WHEN len(reasons) > 0 THEN array_to_string(list_transform(reasons, lambda r: '- ' || r.text_{n}), chr(10)) END"
    body = f"concat_ws(chr(10), {head}, {_fill(_q(P.SEEN[n]), at=_digits('seen_at', n))}, {told}, {reached(P.ARRIVAL)}, CASE WHEN len(places) > 0 THEN {_fill(_q(P.AT_RISK[n]), list=list_)} END, {_q(P.TODO[n])} || {_case('level', P.ACTION, n)}, CASE WHEN needs THEN {_q(P.UNCONFIRMED[n])} END, {footer}, {_q(P.DETAILS[n])} || url)"
    title = f"CASE WHEN akind = 'update' THEN {_q(P.UPDATED[n])} ELSE '' END || {_fill(_q(P.TITLE[n]), level=lv, hazard=hz, site=site)}"
    parts = [_fill(_q(P.SHORT[n]), level=lv, hazard=hz, site=site), f"CASE WHEN len(reasons) > 0 THEN reasons[1].text_{n} || {_q(P.STOP[n])} END", reached(P.SHORT_ARRIVAL), f"CASE WHEN level = 'high' THEN {_q(P.SHORT_ACTION['high'][n])} ELSE {_q(P.SHORT_ACTION['other'][n])} END", _fill(_q(P.SHORT_CALL[n]), hotline=hot)]
    long, without = f"concat_ws(' ', {', '.join(parts)})", f"concat_ws(' ', {', '.join([parts[0], *parts[2:]])})"
    most = P.SHORT_MOST[n]
    sms = f"left(CASE WHEN length({long}) > {most} THEN {without} ELSE {long} END, {most})"
    over = lambda a, b: f"CASE WHEN akind = 'all_clear' THEN {a} ELSE {b} END"
    return f"{over(_fill(_q(P.CLEAR_TITLE[n]), level=lv, site=site), title)} AS title_{n}, {over(f'concat_ws(chr(10), {clear}, {footer}, url)', body)} AS body_{n}, {over(f'left({clear}, {most})', sms)} AS sms_{n}"


_CODE_LIST = "[" + ", ".join(map(_q, _CODES)) + "]"
_VALUE_LIST = "[" + ", ".join(f"{v}::DOUBLE" for v in _VALUES.values()) + "]"
SHEETS = f"""{views.SITES}, {views.ASSETS}, al AS (SELECT site_id, CASE WHEN site_id % 9 = 0 THEN 'all_clear' WHEN site_id % 4 = 0 THEN 'update' ELSE 'alert' END AS akind, CASE WHEN level = 'unknown' THEN 'low' ELSE level END AS level, code, kind AS site_kind, 'Place ' || site_id AS site_en,
 CASE WHEN site_id % 5 = 0 THEN 'Place ' || site_id ELSE 'ठाउँ' END AS site_ne, round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN site_id % 6 <> 0 THEN 3000.0::DOUBLE + site_id END AS elevation_m, strftime(make_timestamp((1706000000 + site_id * 3600 + 20700) * 1000000), '%Y-%m-%d %H:%M') AS seen_at, site_id % 7 = 0 AS needs, '{URL}/#site=' || code AS url FROM site),
 rr AS (SELECT site_id, {_CODE_LIST}[(site_id + j * 5) % 16 + 1] AS code, {_VALUE_LIST}[(site_id + j * 5) % 16 + 1] AS value, ((site_id * 7 + j * 31) % 100)::DOUBLE / 100 + 0.001::DOUBLE AS c FROM site, (VALUES (0), (1)) t(j)),
 rt AS (SELECT site_id, list({{'code': code, 'text_en': {_reason("code", "value", "en")}, 'text_ne': {_reason("code", "value", "ne")}}} ORDER BY c DESC, code) AS reasons FROM rr WHERE c >= 0.05 GROUP BY 1),
 nr AS (SELECT site_id, a.kind, a.asset_id, CASE WHEN asset_id % 7 <> 0 THEN a.name ELSE '' END AS name_en, CASE WHEN asset_id % 3 = 0 THEN 'गाउँ' ELSE '' END AS name_ne, sqrt(pow((s.lon - a.lon) * 111.32::DOUBLE * cos(radians(s.lat)), 2) + pow((s.lat - a.lat) * 110.57::DOUBLE, 2)) AS km FROM site s JOIN asset a USING (aoi)),
 nm AS (SELECT *, round(km, 4) * 1000 / 8 / 60 AS minutes FROM nr WHERE km < 20 AND (name_en <> '' OR name_ne <> '')), nk AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN kind IN ('town', 'hydropower', 'border_crossing') THEN 0 ELSE 1 END, minutes, name_en) AS k FROM nm),
 pl AS (SELECT site_id, list({{'minutes': round(minutes), 'km': round(round(km, 4), 1), 'kind': kind, 'name_en': name_en, 'name_ne': name_ne}} ORDER BY minutes, name_en) AS places FROM nk WHERE k <= 6 GROUP BY 1),
 sh AS (SELECT al.*, coalesce(reasons, []) AS reasons, coalesce(places, []) AS places FROM al LEFT JOIN rt USING (site_id) LEFT JOIN pl USING (site_id)), tx AS (SELECT *, {_texts("en")}, {_texts("ne")} FROM sh)"""
ORACLES = {
    "alert_messages": f"WITH {SHEETS} SELECT site_id, {', '.join(alerts.TEXTS)} FROM tx",
    "alert_reasons": f"WITH r AS (SELECT DISTINCT {_CODE_LIST}[l_partkey % 16 + 1] AS code, round(l_linenumber * 7.31::DOUBLE + l_suppkey % 3, 2) AS value FROM lineitem) SELECT code, value, {_reason('code', 'value', 'en')} AS en, {_reason('code', 'value', 'ne')} AS ne FROM r",
    # The template's texts pass; each spoilt one is found by what was done to it.
    "message_issues": f"WITH {views.SITES} SELECT site_id, CASE site_id % 10 WHEN 1 THEN 'empty_title_en' WHEN 2 THEN 'numbers_title_en' WHEN 3 THEN 'hotline_en' WHEN 4 THEN CASE WHEN level = 'high' THEN 'links,reassurance' ELSE 'links' END WHEN 5 THEN 'script_body_ne' WHEN 6 THEN 'level_ne' ELSE '' END AS issues FROM site",
    "fitted_messages": f"WITH {SHEETS} SELECT site_id, (CASE WHEN length(sms_en) * CASE WHEN site_id % 2 = 0 THEN 3 ELSE 1 END > 306 THEN length(sms_en) ELSE length(sms_en) * CASE WHEN site_id % 2 = 0 THEN 3 ELSE 1 END END)::INTEGER AS sms_en, (CASE WHEN length(title_ne) * CASE WHEN site_id % 3 = 0 THEN 9 ELSE 1 END > 120 THEN length(title_ne) ELSE length(title_ne) * CASE WHEN site_id % 3 = 0 THEN 9 ELSE 1 END END)::INTEGER AS title_ne, (2 * length(body_en))::INTEGER AS body_en FROM tx",
    "subscriber_messages": f"WITH {SHEETS} SELECT site_id, language, CASE language WHEN 'en' THEN title_en WHEN 'ne' THEN title_ne ELSE title_ne || ' / ' || title_en END AS subject, (CASE language WHEN 'en' THEN length(body_en) WHEN 'ne' THEN length(body_ne) ELSE length(body_ne) + length(body_en) + 7 END)::INTEGER AS text, (CASE language WHEN 'en' THEN length(sms_en) ELSE length(sms_ne) END)::INTEGER AS sms, level, len(places)::INTEGER AS places FROM tx, (VALUES ('en'), ('ne'), ('both')) l(language) WHERE level = 'high'",
}
