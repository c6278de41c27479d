"""Reads over stored tables, with arguments: what an API, a report's list or a processor asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import latest, top

POINTS = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<name:string,kind:string>>>"


def events(changes: DataFrame, since: Column, until: Column, kinds: list[str] | None = None, min_area: float = 50_000, most: int = 5000, areas: list[int] | None = None) -> DataFrame:
    """Changes (id, kind, at, area, ...) of some kinds (all: None), areas of interest and a least area, detected from ``since`` to
    ``until``: the newest ``most``. The limit is the read's own."""
    fine = F.col("at").between(since, until) & (F.col("area") >= min_area)
    if kinds is not None:
        fine &= F.col("kind").isin(kinds)
    if areas is not None:
        fine &= F.col("aoi").isin(areas)
    return top(changes.where(fine), most, F.to_date("at").desc(), F.col("id"))


def observations(obs: DataFrame, since: Column | None = None, kinds: list[str] | None = None, sites: list[int] | None = None) -> DataFrame:
    """Observations by site and kind with their place in order of time."""
    for name, chosen in (("kind", kinds), ("site_id", sites)):
        obs = obs if chosen is None else obs.where(F.col(name).isin(chosen))
    obs = obs if since is None else obs.where(F.col("observed_at") >= since)
    return obs.withColumn("place", F.row_number().over(Window.partitionBy("site_id", "kind").orderBy("observed_at", "event_id")))


def collected_features(texts: DataFrame, text: str = "text") -> DataFrame:
    """Named points of feature collections, a text each (a file, or a part of one): the other columns, kind, name, lon, lat."""
    others = [c for c in texts.columns if c != text]
    each = texts.select(*others, F.explode(F.from_json(text, POINTS)["features"]).alias("f")).where("f.properties.name is not null")
    return each.select(*others, "f.properties.kind", "f.properties.name", *[F.get("f.geometry.coordinates", F.lit(k)).alias(c) for k, c in enumerate(("lon", "lat"))])


def outlets(sites: DataFrame, attributes: str = "attrs") -> DataFrame:
    """Sites with the place where a flood would start as lon and lat: the lowest point that their attributes name, else their
    own."""
    point = F.from_json(attributes, "lowest_point array<double>")["lowest_point"]
    return sites.withColumns({"lon": F.coalesce(F.get(point, F.lit(0)), "lon"), "lat": F.coalesce(F.get(point, F.lit(1)), "lat")}).drop(attributes)


def kept_fields(fields: DataFrame, min_valid: int, max_noise: float) -> DataFrame:
    """Velocity fields (tile, day, from_day, orbit, scene, valid, nmad) that are stored: with enough nodes and little noise, one
    for each pair of days and orbit, the last one made."""
    return latest(fields.where((F.col("valid") > min_valid) & (F.col("nmad") < max_noise)), ["tile", "day", "from_day", "orbit"], F.col("scene").desc())


def field_history(fields: DataFrame, most_days: int, least_days: int) -> DataFrame:
    """How many stored fields of its tile end from ``most_days`` to ``least_days`` before each one."""
    by = Window.partitionBy("tile").orderBy("day").rangeBetween(-most_days, -least_days)
    return fields.withColumn("history", F.count("*").over(by))


def region_velocities(sites: DataFrame, px: DataFrame, keys: list[str], min_pixels: int, min_nodes: int, least: float) -> DataFrame:
    """Median of each pair's valid nodes (above ``least``) in the region of each site, where it has pixels and nodes enough.
    ``sites`` and ``px`` share ``keys``."""
    on = F.col("v") > least
    g = px.groupBy(*keys, "scene").agg(F.count("*").alias("pixels"), F.count_if(on).alias("nodes"), F.median(F.when(on, F.col("v"))).alias("v"))
    return sites.join(g.where((F.col("pixels") >= min_pixels) & (F.col("nodes") >= min_nodes)), keys)


def merged_baselines(stored: DataFrame, *more: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Stored rows beside those of earlier seasons or late products; of a row that is there already the stored one stays."""
    both = stored.withColumn("_from", F.lit(0))
    for k, rows in enumerate(more, 1):
        both = both.unionByName(rows.withColumn("_from", F.lit(k)))
    return latest(both, keys, F.col("_from"), F.col(at)).drop("_from")


def readable_reports(texts: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """Reports parsed by ``schema``; what can't be read is left out."""
    parsed = texts.select(F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return parsed.where("j._bad is null").select("j.*").drop("_bad")
