"""Sites and what is attached to them: gates, matching, creation, exposures and observations, as joins over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import place_name
from .joins import BOX, best_match, close_pairs, first_before, nearest
from .stats import weighted_mean
from .tables import latest, numbered

#: Words for sites without a name by kind (fixed values), and the prefix of their codes.
GENERIC = {"glacial_lake": "Glacial lake", "glacier": "Glacier", "slope": "Slope", "barrier_lake": "Barrier lake", "landslide": "Landslide"}
PREFIX = {"glacial_lake": "GL", "glacier": "GC", "slope": "SL", "barrier_lake": "BL", "landslide": "LS"}


def of(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in table.items() for x in p])[key]


def attachable(events: DataFrame, min_area: float = 1e5, min_confidence: float = 0.7, min_relief: float = 0.0) -> DataFrame:
    """Changes that may be attached to sites; landslides of their own ask for 2.5e5, 0.75 and a relief of 300."""
    return events.where((F.col("area") >= min_area) & (F.col("confidence") >= min_confidence) & ~F.col("disturbed") & ~F.col("snow_like") & (F.col("relief") >= min_relief))


def attached_changes(events: DataFrame, sites: DataFrame, max_km: float) -> DataFrame:
    """Observations of the sites near each event (id, scene_key, at, area, confidence, lon, lat), once for site and event."""
    pairs = close_pairs(events, sites.select("site_id", "lon", "lat"), max_km)
    return pairs.select(F.col("r_site_id").alias("site_id"), F.lit("sar_change").alias("kind"), F.concat(F.col("l_scene_key"), F.lit("#ev"), F.col("l_id")).alias("scene_key"), F.col("l_at").alias("observed_at"), F.col("l_area").alias("v"), F.round("l_confidence", 3).alias("quality"))


#: What tells lakes that were found apart: ids repeat.
LAKE = ("id", "at", "lon", "lat")


def moved_near(lakes: DataFrame, events: DataFrame, days: float, degrees: float, min_confidence: float) -> DataFrame:
    """Lakes (id, at, lon, lat) near which a confirmed mass movement was seen in the ``days`` before."""
    box = lambda df, pad: df.select("*", (F.col("lon") - pad).alias("x0"), (F.col("lat") - pad).alias("y0"), (F.col("lon") + pad).alias("x1"), (F.col("lat") + pad).alias("y1"))
    sure = events.where((F.col("confidence") >= min_confidence) & F.col("confirmed"))
    near = first_before(box(lakes.select(F.struct(*LAKE).alias("id"), "at", "lon", "lat"), 0.0), box(sure.select("id", "at", "lon", "lat"), degrees), max(0.05, 2 * degrees), days, (), least=False)
    return lakes.join(near.select("id.*"), [*LAKE], "left_semi")


def undecided() -> Column:
    """Lakes whose decision depends on whether a mass movement was seen near them."""
    return F.coalesce(F.col("known").isNull() & (F.col("quality") >= 0.9) & (F.col("probability") >= 0.5) & F.col("was_dry"), F.lit(False))


def lake_decisions(lakes: DataFrame, near: DataFrame) -> DataFrame:
    """What becomes of a lake that was found (known: the site it matches, quality, probability, was_dry, glacial, z_range):
    observed at a known site (its outline renewed if very sure), a new barrier or glacial lake, or nothing."""
    asks = lakes.where(undecided()).join(near.select(*LAKE, F.lit(True).alias("_moved")).distinct(), [*LAKE], "left")
    out = asks.unionByName(lakes.where(~undecided()).withColumn("_moved", F.lit(False)))
    barrier = F.col("was_dry") & F.coalesce("_moved", F.lit(False))
    seen = (F.col("quality") >= 0.9) & (F.col("probability") >= 0.5)
    flat = F.col("z_range") <= 15
    action = (
        F.when(F.col("known").isNotNull() & (F.col("quality") >= 0.95) & (F.col("probability") >= 0.6), "renewed")
        .when(F.col("known").isNotNull(), "observed")
        .when(seen & barrier, "barrier_lake")
        .when(seen & F.col("glacial") & flat, "glacial_lake")
        .otherwise("none")
    )
    return out.withColumn("action", action).drop("_moved")


def glacial(z: Column, ice_km: Column, min_z: float, near_km: float = 1.0) -> Column:
    """A lake counts as glacial if it is high or close to a glacier of the inventory."""
    return (z >= min_z) | (ice_km < near_km)


def missing_sites(inventory: DataFrame, sites: DataFrame, box: tuple[float, float, float, float], min_km2: float) -> DataFrame:
    """Entries of an inventory (inventory_id, km2, lon, lat) large enough, inside a box, and without a site."""
    inside = F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])
    return inventory.where(inside & (F.col("km2") >= min_km2)).join(sites.select("inventory_id"), "inventory_id", "left_anti")


def created(new: DataFrame, places: DataFrame, existing: DataFrame, max_km: float = 6.0) -> DataFrame:
    """New sites (key, site_kind, lon, lat, own_name) with codes after the existing ones of their kind and names: their own,
    that of the nearest place, or their kind's. ``places``: place_id, name, lon, lat; ``existing``: site_kind, most."""
    near = nearest(new.select("key", "lon", "lat"), places.select("place_id", "lon", "lat"), max_km, "key", "place_id")
    named = near.join(places.select(F.col("place_id").alias("nearest"), F.col("name").alias("place")), "nearest").select("key", "place")
    rows = new.join(named, "key", "left").join(existing, "site_kind", "left")
    generic = of(GENERIC, F.col("site_kind"))
    beside = F.when(F.col("place").isNotNull(), F.concat(generic, F.lit(" near "), F.col("place")))
    rows = rows.withColumn("name", place_name(F.col("own_name"), beside, generic))
    return numbered(rows, of(PREFIX, F.col("site_kind")), F.col("key"), existing=F.coalesce("most", F.lit(0))).drop("place", "most")


def matched_or_new(events: DataFrame, sites: DataFrame, pad: float, bucket: float) -> DataFrame:
    """Each event (id, box) with the site whose box shares the most with it, or null: a new site is due."""
    wide = events.select("id", (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1"))
    return events.join(best_match(wide, sites.select("site_id", *BOX), bucket, "id", "site_id").select("id", F.col("match").alias("site_id")), "id", "left")


def cell_site_observations(members: DataFrame, rows: DataFrame) -> DataFrame:
    """One velocity observation of each site and pair from its cells (site_id, cell): the weighted mean over all of them,
    none rejected, and the number of nodes."""
    joined = members.join(rows, "cell")
    return weighted_mean(joined, ["site_id", "pair_key"], clip=99.0, carry={"nodes": F.sum("n"), "observed_at": F.max("pair_end")}).withColumnsRenamed({"mean": "v", "error": "se", "n": "cells"})


def cell_sites(cells: DataFrame) -> DataFrame:
    """A site of each cluster of cells (cluster, cell, z, slope, height): its box of cells, mean slope, heights, and what the
    strongest cell tells; ties to the smaller cell."""
    best = F.struct("z", -F.col("cell"))
    return cells.groupBy("cluster").agg(
        F.count("*").alias("cells"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"), F.avg("slope").alias("slope"), F.min("height").alias("low"), F.max("height").alias("high"),
        F.median("height").alias("middle"), F.max_by("cell", best).alias("best_cell"), F.max("z").alias("z"), F.max_by("ratio", best).alias("ratio"),
    )


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys that ``new`` holds, and ``new``: the exposures of a site are written anew."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def appended_once(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An append that a rerun doesn't repeat: rows of ``new`` whose keys are new, the first of each."""
    return old.unionByName(latest(new, keys, *[F.col(c) for c in new.columns]).join(old.select(*keys), keys, "left_anti"))
