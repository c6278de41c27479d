"""Scans of scene catalogues, map features and products: filters that the Parquet reader can use, and normalised columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    """A box without coordinates overlaps everything."""
    return F.coalesce((x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1]), F.lit(True))


def search(items: DataFrame, box, start: Column, end: Column, max_cloud: float | None = None) -> DataFrame:
    """Items (x0, y0, x1, y1, at, cloud) in a box and a closed interval, at most ``max_cloud`` clouded."""
    found = items.where(F.col("at").between(start, end) & overlaps(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), box))
    return found if max_cloud is None else found.where(F.col("cloud") <= max_cloud)


def radar_items(items: DataFrame) -> DataFrame:
    """Interferometric wide swath (the default mode) with a VV asset; asset names in capitals, only VV and VH."""
    named = F.transform_keys("assets", lambda k, v: F.upper(k))
    fine = items.withColumn("assets", F.map_filter(named, lambda k, v: k.isin("VV", "VH")))
    return fine.where((F.coalesce("mode", F.lit("IW")) == "IW") & F.map_contains_key("assets", "VV"))


def elevation_href(assets: Column) -> Column:
    """The data asset, else the first."""
    return F.coalesce(assets["data"], F.get(F.map_values(assets), F.lit(0)))


#: Names of bands in catalogues, and those that the engine uses (fixed values).
BAND_NAMES = {"B02": "blue", "B03": "green", "B04": "red", "B08": "nir", "B11": "swir16", "SCL": "scl", "blue": "blue", "green": "green", "red": "red", "nir": "nir", "swir16": "swir16", "scl": "scl"}


def search_slc(scenes: DataFrame, start: Column, end: Column) -> DataFrame:
    """Scenes in an interval with their ``place`` in time within orbit and frame, so neighbours are one apart."""
    by = Window.partitionBy("orbit", "frame").orderBy("at", "key")
    return scenes.where(F.col("at").between(start, end)).withColumn("place", F.row_number().over(by))


def newest_year(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.year("at").desc()))).where("_r = 1").drop("_r")


def normalised(items: DataFrame) -> DataFrame:
    """Reflectance offset by processing baseline, sun elevation from zenith where it is missing, orbit from the id."""
    baseline = F.col("baseline").try_cast("double")
    return items.select(
        "id", "at", F.when(baseline >= 4.0, -1000.0).otherwise(0.0).alias("offset"), F.coalesce("sun_elevation", 90 - F.col("sun_zenith")).alias("sun_elevation"), F.nullif(F.regexp_extract("id", r"_R(\d{3})_", 1), F.lit("")).try_cast("int").alias("orbit")
    )


def without_reprocessed(items: DataFrame, keys: list[str]) -> DataFrame:
    """Of products of one key that differ only in the time that ends their id, the last; all columns. Of equal ids the row
    whose other columns are largest, in their order (nulls are smallest)."""
    tile = F.regexp_replace("id", r"_\d{8}T\d{6}$", "").alias("_tile")
    return items.groupBy(*keys, tile).agg(F.max_by(F.struct(*items.columns), F.struct("id", *[c for c, t in items.dtypes if not t.startswith("map")])).alias("r")).select("r.*")


def acquisitions(items: DataFrame) -> DataFrame:
    """Items (sensor, platform, at, orbit, id, cloud) of one sensor, platform, day and orbit as one acquisition: without
    reprocessed products, its middle time, mean cloud cover of the items that tell it, and key; where items have sun_azimuth
    or sun_elevation, also their means over the items that tell them."""
    rows = items.withColumn("day", F.to_date("at"))
    by = ["sensor", "platform", "day", "orbit"]
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    out = without_reprocessed(rows, by).groupBy(*by).agg(F.count("*").alias("items"), F.avg("cloud").alias("cloud"), *[F.avg(c).alias(c) for c in ("sun_azimuth", "sun_elevation") if c in items.columns], F.floor((F.min(micros) + F.max(micros)) / 2).cast("long").alias("middle"))
    orbit = F.coalesce(F.format_string("R%03d", F.col("orbit")), F.lit("Rxxx"))
    stamp = F.date_format(F.timestamp_micros("middle"), "yyyyMMdd'T'HHmm")
    return out.withColumn("key", F.concat_ws("_", "sensor", "platform", stamp, F.when(F.col("orbit").isNull(), F.lit("Rxxx")).otherwise(orbit)))


def product_times(name: Column) -> tuple[Column, Column]:
    """Reference and secondary time of a product name, in order."""
    times = [F.try_to_timestamp(F.regexp_extract(name, r"_(\d{8}T\d{6})_(\d{8}T\d{6})_", k), F.lit("yyyyMMdd'T'HHmmss")) for k in (1, 2)]
    return F.least(*times), F.greatest(*times)


#: Kinds of assets in the order in which they are tried, by tag and its values (none: any value). A power plant counts by
#: its source (fixed values).
ASSET_RULES = (
    ("town", "place", ("city", "town")),
    ("settlement", "place", ("village", "hamlet", "isolated_dwelling", "locality")),
    ("hydropower", "power", ("plant", "generator")),
    ("dam", "waterway", ("dam", "weir")),
    ("border_crossing", "barrier", ("border_control",)),
    ("bridge", "bridge", ("yes",)),
    ("school", "amenity", ("school",)),
    ("health", "amenity", ("hospital", "clinic")),
    ("health", "healthcare", ()),
    ("police", "amenity", ("police",)),
    ("government", "amenity", ("townhall",)),
    ("tourism", "tourism", ("alpine_hut", "guest_house", "hotel", "hostel", "camp_site")),
)
SOURCE_TAGS, SOURCE = ("plant:source", "generator:source"), "hydro"


def asset_kind(tags: Column) -> Column:
    """The first kind whose rule fits a map of tags; null if none does."""
    source = F.concat(*[F.coalesce(tags[t], F.lit("")) for t in SOURCE_TAGS])
    tried = []
    for kind, tag, values in ASSET_RULES:
        fits = tags[tag].isin(*values) if values else F.coalesce(tags[tag], F.lit("")) != ""
        fits = fits & source.contains(SOURCE) if kind == "hydropower" else fits
        tried.append(F.when(fits, kind))
    return F.coalesce(*tried)


def map_features(elements: DataFrame) -> DataFrame:
    """Point features of map elements (place, type, id, lon, lat, centre, tags): of an id the one that comes first by
    ``place``, its kind, and its names; what is not a node stands at its centre, or nowhere."""
    tags, text = F.col("tags"), lambda t: F.nullif(F.col("tags")[t], F.lit(""))
    node = F.col("type") == "node"
    at = lambda c: F.when(node, F.col(c)).otherwise(F.col("centre")[c])
    local = F.coalesce(text("name:ne"), F.when(text("name").rlike(r"[\x{0900}-\x{097F}]"), text("name")), F.lit(""))
    rows = elements.select(
        "place", F.concat(F.lit("osm:"), "type", F.lit("/"), "id").alias("external_id"), at("lon").alias("lon"), at("lat").alias("lat"), asset_kind(tags).alias("kind"),
        F.coalesce(text("name:en"), text("name"), text("int_name"), F.lit("")).alias("name"), local.alias("name_ne"),
    )
    found = rows.where(F.col("kind").isNotNull() & F.col("lon").isNotNull())
    return found.groupBy("external_id").agg(F.min_by(F.struct("kind", "lon", "lat", "name", "name_ne"), "place").alias("r")).select("external_id", "r.*")


def ring_area_km2(ring: Column, lat: Column) -> Column:
    """Area of a ring of (lon, lat) points by the shoelace sum; null if it has fewer than four points or isn't closed."""
    n = F.size(ring)
    cross = F.transform(F.slice(ring, F.lit(1), n - 1), lambda p, i: p["lon"] * F.get(ring, i + 1)["lat"] - F.get(ring, i + 1)["lon"] * p["lat"])
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2 * 111.32**2 * F.cos(F.radians(lat))
    return F.when((n >= 4) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1)), area)


def first_valid(px: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mosaic: of overlapping items the first that has a value at a pixel."""
    return px.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*keys, "row", "col").agg(F.min_by("v", order).alias("v"))


def nearest_filled(px: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Voids take the value of the nearest pixel within ``reach`` along both axes; ties to the smaller value."""
    from ..operators import tiles

    filled = tiles.over_tiles(px, keys, ["v"], tiles.nearest_value("v", reach), {"_f": "double"}, reach)
    return filled.withColumn("v", F.coalesce("v", "_f")).drop("_f")
