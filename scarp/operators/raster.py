"""Rasters as pixel rows (scene, row, col, v): neighbourhoods are kernels over dense tiles with a halo (``tiles``), regions are
groups. Kernels without a relational form run on Arrow batches, a tile at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .stats import MAD_SCALE


def shifted(px: DataFrame, keys: list[str], reach: int, value: str = "v") -> DataFrame:
    """Each pixel's value at every place within ``reach``: rows (keys, row, col, dr, dc, _n)."""
    moves = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)]))
    return px.select(*keys, "row", "col", F.col(value).alias("_n"), moves.alias("m")).select(*keys, (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), F.col("m.dr"), F.col("m.dc"), "_n")


def median_filter(px: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """``median`` of the window around each pixel, of the values that exist there."""
    return tiles.over_tiles(px, keys, ["v"], tiles.local_median("v", reach), {"median": "double"}, reach)


def lee_filter(px: DataFrame, keys: list[str], reach: int = 2) -> DataFrame:
    """Speckle filter of decibels in the linear domain: the local mean, and what is left weighted by local variance."""
    linear = px.withColumn("v", F.pow(F.lit(10.0), F.col("v") / 10))
    local = tiles.over_tiles(linear, keys, ["v"], tiles.local_moments("v", reach), {"mean": "double", "var": "double"}, reach)
    whole = local.groupBy(*keys).agg(F.avg("var").alias("_all"))
    w = F.try_divide(F.col("var"), F.col("var") + F.col("_all"))
    return local.join(whole, keys).withColumn("filtered", 10 * F.log10(F.col("mean") + F.coalesce(w, F.lit(0.0)) * (F.col("v") - F.col("mean")))).drop("_all", "v")


def log_ratio(pre: DataFrame, post: DataFrame, keys: list[str], reach: int = 0) -> DataFrame:
    """Change of decibels, of both sides without speckle if ``reach`` is not 0."""
    if reach:
        pre, post = (lee_filter(x, keys, reach).withColumnRenamed("filtered", "v") for x in (pre, post))
    a, b = pre.select(*keys, "row", "col", F.col("v").alias("_a")), post.select(*keys, "row", "col", F.col("v").alias("_b"))
    return a.join(b, [*keys, "row", "col"]).withColumn("change", F.col("_b") - F.col("_a")).drop("_a", "_b")


def gradient(axis: str, keys: list[str], resolution: float, z: str = "v") -> Column:
    """Central differences along an axis, one-sided at the ends."""
    by = Window.partitionBy(*keys, "col" if axis == "row" else "row").orderBy(axis)
    before, after = F.lag(z).over(by), F.lead(z).over(by)
    return F.when(before.isNull(), after - F.col(z)).when(after.isNull(), F.col(z) - before).otherwise((after - before) / 2) / resolution


def slope_aspect(px: DataFrame, keys: list[str], resolution: float) -> DataFrame:
    """slope in degrees, and aspect clockwise from north, facing down."""
    out = px.withColumn("_y", gradient("row", keys, resolution)).withColumn("_x", gradient("col", keys, resolution))
    return out.withColumn("slope", F.degrees(F.atan(F.hypot("_x", "_y")))).withColumn("aspect", F.pmod(F.degrees(F.atan2(-F.col("_x"), F.col("_y"))) + 360, F.lit(360.0))).drop("_x", "_y")


def seasonal_bands(px: DataFrame, keys: list[str], z: str, band_m: float, threshold: float, share: float, min_pixels: int) -> DataFrame:
    """Flags pixels of a height band in which a large share changes in one direction: snow, not an event."""
    by = Window.partitionBy(*keys)
    banded = px.withColumn("band", F.floor((F.col(z) - F.min(z).over(by)) / band_m).cast("int")).withColumn("sign", F.when(F.col("v") > threshold, 1).when(F.col("v") < -threshold, -1).otherwise(0))
    each = banded.groupBy(*keys, "band").agg(F.count("*").alias("_n"), F.avg((F.col("sign") == 1).cast("double")).alias("_up"), F.avg((F.col("sign") == -1).cast("double")).alias("_down"))
    flag = (F.col("_n") >= min_pixels) & (((F.col("sign") == 1) & (F.col("_up") > share)) | ((F.col("sign") == -1) & (F.col("_down") > share)))
    return banded.join(each, [*keys, "band"]).withColumn("seasonal", flag).drop("_n", "_up", "_down")


#: Pixels a side of the blocks that are labelled at once.
BLOCK = 256


def blocks_labelled(batches):
    """Labels within blocks, of rows (block, row, col) sorted by them: all blocks of a batch at once; the rows of a block
    that a batch cuts wait for the next. Pixels of one block are found by their place in the sorted rows, and labels
    spread to the smallest along edges, with each label's own label looked up in each round."""

    def labels(block: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        at = (np.cumsum(np.diff(block, prepend=block[:1]) != 0) << 20) + row % BLOCK * 1024 + col % BLOCK + 1
        label = np.arange(len(at))
        edges = []
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            inside = (row % BLOCK + dr < BLOCK) & (col % BLOCK + dc >= 0) & (col % BLOCK + dc < BLOCK)
            want = at + dr * 1024 + dc
            k = np.minimum(np.searchsorted(at, want), len(at) - 1)
            hit = inside & (at[k] == want)
            edges.append(np.stack([np.flatnonzero(hit), k[hit]]))
        u, v = np.concatenate(edges, axis=1)
        while len(u):
            low = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            while (label[label] != label).any():  # roots only are hooked, or links would be lost
                label = label[label]
            left = label[u] != label[v]
            u, v = u[left], v[left]
        return row[label] * (1 << 20) + col[label]

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        block = table["_block"].to_numpy()
        ended = np.flatnonzero(block != block[-1]) if len(block) else block
        cut = int(ended[-1]) + 1 if len(ended) else 0
        held = table.slice(cut)
        yield from labelled_part(table.slice(0, cut), labels)
    if held is not None:
        yield from labelled_part(held, labels)


def labelled_part(table: pa.Table, labels):
    if table.num_rows:
        found = labels(*(table[c].to_numpy().astype(np.int64) for c in ("_block", "row", "col")))
        yield from table.drop_columns(["_block"]).append_column("label", pa.array(found)).combine_chunks().to_batches()


def regions(px: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """Labels of 8-connected pixels: the smallest (row * 2**20 + col) of the region.

    Blocks of BLOCK x BLOCK pixels are labelled one by one; pixels on their borders then give edges between labels, and
    labels take the smallest that they meet, and its own label, until none changes. Only these edges are iterated.
    """
    from ..sources.shared import saved

    size = F.lit(BLOCK)
    block = F.xxhash64(*keys, F.floor(F.col("row") / size), F.floor(F.col("col") / size)).alias("_block")
    rows = px.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), block)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "_block")
    own = saved(rows.repartition("_block").sortWithinPartitions("_block", "row", "col").mapInArrow(blocks_labelled, f"{kinds}, label long"))
    rim = lambda c: (F.col(c) % BLOCK == 0) | (F.col(c) % BLOCK == BLOCK - 1)
    border = own.where(rim("row") | rim("col"))
    over = lambda c, d: F.floor(F.col(c) / size) != F.floor((F.col(c) - F.col(d)) / size)
    near = shifted(border, keys, 1, "label").where(over("row", "dr") | over("col", "dc")).join(border.hint("merge"), [*keys, "row", "col"]).where(F.col("_n") != F.col("label"))
    edges = saved(near.select(*keys, F.col("label").alias("a"), F.col("_n").alias("b")).distinct())
    if edges.isEmpty():
        return own
    to = saved(edges.select(*keys, F.col("a").alias("label")).distinct().withColumn("to", F.col("label")))
    changed = None
    for _ in range(most):
        b = to.select(*keys, F.col("label").alias("b"), F.col("to").alias("_b"))
        least = edges.join(b, [*keys, "b"]).groupBy(*keys, F.col("a").alias("label")).agg(F.min("_b").alias("_m"))
        step = to.join(least, [*keys, "label"]).withColumn("to", F.least("to", "_m")).drop("_m")
        up = to.select(*keys, F.col("label").alias("to"), F.col("to").alias("_up"))
        to = saved(step.join(up, [*keys, "to"], "left").select(*keys, "label", F.least("to", F.coalesce("_up", "to")).alias("to")))
        total = to.agg(F.sum(F.col("to").cast("decimal(38,0)"))).first()[0]
        if total == changed:
            return own.join(to, [*keys, "label"], "left").select(*keys, "row", "col", F.coalesce("to", "label").alias("label"))
        changed = total
    raise RuntimeError(f"regions did not settle in {most} rounds")


def region_shapes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Area, centre and the lengths of the axes of the ellipse with the region's second moments."""
    g = labelled.groupBy(*keys, "label").agg(
        F.count("*").alias("pixels"), F.avg("row").alias("row"), F.avg("col").alias("col"), F.var_pop("row").alias("_rr"), F.var_pop("col").alias("_cc"), F.covar_pop("row", "col").alias("_rc")
    )
    mid = (F.col("_rr") + F.col("_cc")) / 2 + 1 / 12
    root = F.sqrt(F.pow((F.col("_rr") - F.col("_cc")) / 2, 2) + F.pow("_rc", 2))
    return g.withColumn("major", 4 * F.sqrt(mid + root)).withColumn("minor", 4 * F.sqrt(F.greatest(mid - root, F.lit(0.0)))).drop("_rr", "_cc", "_rc")


def otsu(px: DataFrame, keys: list[str], bins: int, lo: float, hi: float) -> DataFrame:
    """The threshold with the largest variance between the two sides, from a histogram: one row a bin after the first
    aggregate, whatever the number of pixels."""
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - lo) / (hi - lo) * bins))).cast("int")
    h = px.where(F.col("v").isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n")).withColumn("mid", lo + (F.col("bin") + 0.5) * (hi - lo) / bins)
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    h = h.withColumn("n0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("mid")).over(up)).withColumn("n1", F.sum("n").over(all_) - F.col("n0")).withColumn("s1", F.sum(F.col("n") * F.col("mid")).over(all_) - F.col("s0"))
    between = F.col("n0") * F.col("n1") * F.pow(F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s1"), F.col("n1")), 2)
    h = h.withColumn("between", F.round(F.coalesce(between, F.lit(0.0)), 6))
    return h.groupBy(*keys).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("bin"), F.max("between").alias("between")).withColumn("threshold", lo + (F.col("bin") + 1) * (hi - lo) / bins)


def stable_ground(nodes: DataFrame, keys: list[str], stable: Column, min_nodes: int = 30) -> DataFrame:
    """Offsets less the median of stable ground, and the spread that is left there (null with too few stable nodes)."""
    by = Window.partitionBy(*keys)
    on = F.when(stable, F.col("v"))
    out = nodes.withColumn("_m", F.median(on).over(by)).withColumn("_n", F.count(on).over(by))
    out = out.withColumn("corrected", F.col("v") - F.when(F.col("_n") >= min_nodes, F.col("_m")).otherwise(0.0))
    spread = MAD_SCALE * F.median(F.abs(on - F.col("_m"))).over(by)
    return out.withColumn("nmad", F.when(F.col("_n") >= min_nodes, spread)).drop("_m", "_n")


def cell_medians(nodes: DataFrame, keys: list[str], size: int, noise: Column | float, min_nodes: int = 8, step=16, chip=64) -> DataFrame:
    """Median of the nodes of each cell of ``size`` pixels; its error counts nodes as far as their chips don't overlap."""
    g = nodes.groupBy(*keys, F.floor(F.col("row") / size).cast("int").alias("cell_row"), F.floor(F.col("col") / size).cast("int").alias("cell_col")).agg(F.median("v").alias("v"), F.count("v").alias("n"))
    free = F.greatest(F.lit(1.0), F.col("n") * (step / chip) ** 2)
    return g.where(F.col("n") >= min_nodes).withColumn("se", 1.2533 * noise / F.sqrt(free))


def region_summary(nodes: DataFrame, keys: list[str], noise: float) -> DataFrame:
    g = nodes.groupBy(*keys).agg(F.count("v").alias("n"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.9)).alias("p90"))
    few = F.col("n") < 3
    return g.select(*keys, "n", *[F.when(~few, F.col(c)).alias(c) for c in ("median", "mean", "p90")], F.when(~few, noise / F.sqrt(F.greatest(F.lit(1.0), F.col("n") / 16))).alias("se"))


def peak_offsets(reference: np.ndarray, secondary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shifts of stacks of chips (chip, row, column) by cross-correlation of windowed, standardised chips: rows and columns to a
    fraction of a pixel, the peak, and how far it stands above the rest. One transform for the whole stack."""
    n, height, width = reference.shape
    window = np.outer(np.hanning(height), np.hanning(width))

    def standard(x: np.ndarray) -> np.ndarray:
        mean, sd = x.mean((1, 2), keepdims=True), x.std((1, 2), keepdims=True)
        return (x - mean) / np.maximum(sd, 1e-6) * window

    f, g = np.fft.rfft2(standard(reference)), np.fft.rfft2(standard(secondary))
    c = np.fft.irfft2(np.conj(f) * g, s=(height, width)) / (window**2).sum()
    chip = np.arange(n)
    r, k = np.unravel_index(c.reshape(n, -1).argmax(1), (height, width))
    out = []
    for at, size, around in ((r, height, lambda d: c[chip, (r + d) % height, k]), (k, width, lambda d: c[chip, r, (k + d) % width])):
        low, mid, high = (around(d) for d in (-1, 0, 1))
        curve = low - 2 * mid + high
        part = np.clip(np.divide(0.5 * (low - high), curve, out=np.zeros(n), where=curve != 0), -0.5, 0.5)
        out.append(np.where(at <= size // 2, at, at - size) + part)
    peak = c[chip, r, k]
    return out[0], out[1], peak, peak / np.maximum(np.abs(c).mean((1, 2)), 1e-6)


def peak_offset(reference: np.ndarray, secondary: np.ndarray) -> tuple[float, float, float, float]:
    """``peak_offsets`` of one pair of chips."""
    return tuple(float(x[0]) for x in peak_offsets(reference[None], secondary[None]))


def offsets(pairs: DataFrame, size: int) -> DataFrame:
    """(pair, dr, dc, corr, snr) of chips given as flat arrays ``ref`` and ``sec`` of size * size values, a batch at once."""

    def run(batches):
        for batch in batches:
            chips = [c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size, size) for c in batch.columns[1:]]
            found = peak_offsets(*chips) if batch.num_rows else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in found]], ["pair", "dr", "dc", "corr", "snr"])

    return pairs.select("pair", "ref", "sec").mapInArrow(run, "pair long, dr double, dc double, corr double, snr double")


def tracked(nodes: DataFrame, keys: list[str], chip: int, min_corr: float = 0.1, min_snr: float = 4.0, most_px: float = 1.0) -> DataFrame:
    """Nodes of a lattice (dr, dc, corr, snr) that hold: a clear peak, a shift within a quarter of the chip, and no more than
    ``most_px`` from the median of the nodes around it that hold so far. With dx and dy, north up."""
    fine = (F.col("corr") >= min_corr) & (F.col("snr") >= min_snr) & (F.abs("dr") <= chip / 4) & (F.abs("dc") <= chip / 4)
    held = nodes.where(fine)
    for c in ("dr", "dc"):
        held = median_filter(held.withColumn("v", F.col(c)), keys).withColumnRenamed("median", f"_{c}").drop("v")
    near = (F.abs(F.col("dr") - F.col("_dr")) <= most_px) & (F.abs(F.col("dc") - F.col("_dc")) <= most_px)
    return held.where(near).withColumn("dx", F.col("dc")).withColumn("dy", -F.col("dr")).drop("_dr", "_dc", "dr", "dc")
