"""Offsets between two scenes on a lattice of overlapping chips.

Pixels of a pair (keys, row, col, ref, sec) are dealt into tiles with a halo of half a chip, so pixels move once and not once for
each chip that holds them. In a task the chips of a tile's nodes are views of its dense arrays, and go through one transform
a batch. A node stands at the middle of its chip, at rows and columns half a chip, and steps from there, from the scene's
first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster, terrain, tiles

#: Chips that are transformed at once.
BATCH = 512


def highpassed(pair: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """``pair`` with ``a`` and ``b``, both sides without their Gaussian surroundings; what is missing is 0."""
    out = pair
    for side, name in (("ref", "a"), ("sec", "b")):
        out = terrain.highpass(out.withColumn("v", F.col(side)), keys, sigma).withColumnRenamed("high", name).drop("v")
    return out


def chips_at_nodes(chip: int, step: int, least: float):
    """Kernel: shift, peak and its height at each node whose chip lies in the scene and is seen in both by at least a share."""
    half = chip // 2

    def kernel(s: tiles.Stack) -> dict[str, np.ndarray]:
        out = {k: np.full(s.shape, np.nan) for k in ("dr", "dc", "corr", "snr")}
        row, col = s.at("_row"), s.at("_col")
        with np.errstate(invalid="ignore"):
            node = (row >= half) & (col >= half) & ((row - half) % step == 0) & ((col - half) % step == 0)
        # The chip lies in the scene, with a pixel to spare, if its corners exist.
        node &= s.view(s.held, half, half) & s.view(s.held, -half, -half)
        t, r, c = np.nonzero(node)
        views = {k: np.lib.stride_tricks.sliding_window_view(s.arrays[k], (chip, chip), axis=(1, 2)) for k in ("a", "b", "_seen")}
        for k in range(0, len(t), BATCH):
            at = t[k : k + BATCH], r[k : k + BATCH] + s.up - half, c[k : k + BATCH] + s.left - half
            fine = np.nan_to_num(views["_seen"][at]).mean((1, 2)) > least
            if fine.any():
                here = tuple(x[fine] for x in at)
                place = t[k : k + BATCH][fine], r[k : k + BATCH][fine], c[k : k + BATCH][fine]
                for name, x in zip(("dr", "dc", "corr", "snr"), raster.peak_offsets(*(np.nan_to_num(views[v][here]) for v in ("a", "b")))):
                    out[name][place] = x
        return out

    return kernel


def chip_lattice(pair: DataFrame, keys: list[str], chip: int = 64, step: int = 16, sigma: float | None = None, least: float = 0.9) -> DataFrame:
    """(keys, row, col, dr, dc, corr, snr) of all nodes that are seen well enough."""
    rows = highpassed(pair.select(*keys, "row", "col", "ref", "sec"), keys, sigma or chip / 6)
    seen = (F.col("ref").isNotNull() & F.col("sec").isNotNull()).cast("double")
    rows = rows.select(*keys, "row", "col", "a", "b", seen.alias("_seen"), F.col("row").cast("double").alias("_row"), F.col("col").cast("double").alias("_col"))
    out = tiles.over_tiles(rows, keys, ["a", "b", "_seen", "_row", "_col"], chips_at_nodes(chip, step, least), {k: "double" for k in ("dr", "dc", "corr", "snr")}, chip // 2)
    return out.where(F.col("corr").isNotNull()).select(*keys, "row", "col", "dr", "dc", "corr", "snr")


def offset_field(pair: DataFrame, keys: list[str], chip: int = 64, step: int = 16, max_shift: float | None = None, min_corr: float = 0.15, min_snr: float = 4.0, outlier_px: float = 1.0, where: DataFrame | None = None) -> DataFrame:
    """The nodes with what was measured there, and dx, dy (east and north, in pixels) where it holds: a clear peak, a shift of at
    most a quarter of the chip, and no more than ``outlier_px`` from the median around the node, first of dx, then, among what is
    left, of dy. ``where`` (keys, row, col) keeps the nodes at its pixels."""
    nodes = chip_lattice(pair, keys, chip, step)
    if where is not None:
        nodes = nodes.join(where.select(*keys, "row", "col").distinct(), [*keys, "row", "col"], "left_semi")
    far = F.hypot("dr", "dc") > (chip / 4 if max_shift is None else max_shift)
    fine = (F.col("corr") >= min_corr) & (F.col("snr") >= min_snr) & ~far
    out = nodes.withColumns({"dx": F.when(fine, F.col("dc")), "dy": F.when(fine, -F.col("dr"))}).withColumns({"_r": F.col("row"), "_c": F.col("col")})
    out = out.withColumns({"row": ((F.col("_r") - chip // 2) / step).cast("int"), "col": ((F.col("_c") - chip // 2) / step).cast("int")})
    for c in ("dx", "dy"):
        out = raster.median_filter(out.withColumn("v", F.col(c)), keys).drop("v")
        near = F.abs(F.col(c) - F.col("median")) <= outlier_px
        out = out.withColumns({k: F.when(near, F.col(k)) for k in ("dx", "dy")}).drop("median")
    return out.withColumns({"row": F.col("_r"), "col": F.col("_c")}).drop("_r", "_c")


def at_nodes(mask: DataFrame, keys: list[str], chip: int = 64, step: int = 16) -> DataFrame:
    """The pixels of a mask (keys, row, col) that are nodes."""
    half = chip // 2
    on = lambda c: (F.col(c) >= half) & ((F.col(c) - half) % step == 0)
    return mask.where(on("row") & on("col"))
