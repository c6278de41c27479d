"""Kernels over dense tiles with a halo.

Pixels (keys, row, col, values) are dealt into tiles of ``size`` x ``size``. A pixel goes to its own tile and, within the reach
of a kernel from a border, to the neighbours that look at it: the rows that are shuffled are the pixels and a rim, not a
window for each pixel. In each task tiles become dense arrays, several small ones stacked, and a kernel works on all their
pixels at once; results are kept for a tile's own pixels. No task holds more than ``CELLS`` places of arrays at once, and a
tile is bounded by its size, whatever the scene's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256
#: Places of a stack of dense tiles, about.
CELLS = 1 << 20


class Stack:
    """Tiles of one shape as arrays (tile, row, column), with room around for what lies outside."""

    def __init__(self, columns: dict[str, np.ndarray], tile: np.ndarray, row: np.ndarray, col: np.ndarray, halo: tuple[int, int, int, int]) -> None:
        self.up, self.down, self.left, self.right = halo
        self.shape = int(tile[-1]) + 1, int(row.max()) + 1, int(col.max()) + 1
        n, height, width = self.shape
        self.whole = n, height + self.up + self.down, width + self.left + self.right
        at = tile, row + self.up, col + self.left
        self.arrays = {}
        for name, values in columns.items():
            self.arrays[name] = np.full(self.whole, np.nan)
            self.arrays[name][at] = values
        self.held = np.zeros(self.whole, bool)
        self.held[at] = True

    def view(self, array: np.ndarray, dr: int = 0, dc: int = 0, grow: int = 0) -> np.ndarray:
        """The tiles' places in a padded array, ``grow`` places wider on each side, moved by (dr, dc)."""
        _, height, width = self.shape
        r, c = self.up + dr - grow, self.left + dc - grow
        return array[:, r : r + height + 2 * grow, c : c + width + 2 * grow]

    def at(self, name: str, dr: int = 0, dc: int = 0, grow: int = 0) -> np.ndarray:
        return self.view(self.arrays[name], dr, dc, grow)


ORDER = ["_tile", "_tr", "_tc"]


def dealt(px: DataFrame, keys: list[str], halo: tuple[int, int, int, int], size: int = SIZE) -> DataFrame:
    """A row of each pixel for each tile that looks at it: the tile's place, a number of key and place, and whether it is the
    pixel's own tile."""
    up, down, left, right = halo
    tile_of = lambda c, d: F.floor((F.col(c) + d) / size).cast("int")
    rows = px.withColumn("_tr", F.explode(F.sequence(tile_of("row", -down), tile_of("row", up))))
    rows = rows.withColumn("_tc", F.explode(F.sequence(tile_of("col", -right), tile_of("col", left))))
    own = (F.col("_tr") == tile_of("row", 0)) & (F.col("_tc") == tile_of("col", 0))
    return rows.withColumn("_own", own).withColumn("_tile", F.xxhash64(*keys, "_tr", "_tc"))


def over_tiles(px: DataFrame, keys: list[str], inputs: list[str], kernel: Callable[[Stack], dict[str, np.ndarray]], outputs: dict[str, str], halo: int | tuple[int, int, int, int], size: int = SIZE) -> DataFrame:
    """``px`` with the columns ``outputs`` (name: type) that ``kernel`` makes of the numeric columns ``inputs`` (null: NaN).

    ``halo`` is how far the kernel looks up, down, left and right, or one number for all. NaN in a result becomes null.
    Repeated pixels of a key count as the last of them in each place, and all get its results.
    """
    up, down, left, right = rims = (halo,) * 4 if isinstance(halo, int) else halo
    names, order = list(px.columns), ORDER
    if not outputs or not {*ORDER, "_own"}.isdisjoint(names):
        raise ValueError("nothing is asked for, or px has a column of a tile's")
    rows = dealt(px, keys, rims, size)
    kinds = [f"`{c}` {t}" for c, t in px.dtypes] + [f"`{c}` {t}" for c, t in outputs.items()]

    def done(table: pa.Table):
        """Results of whole tiles."""
        at = [table[c].to_numpy() for c in order]
        row, col = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        starts = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in at], axis=0)]))
        ends = np.append(starts[1:], len(row))
        row, col = (x - np.repeat(np.minimum.reduceat(x, starts), ends - starts) for x in (row, col))
        heights, widths = np.maximum.reduceat(row, starts) + 1, np.maximum.reduceat(col, starts) + 1
        first = 0
        while first < len(starts):
            last, tall, wide = first, 0, 0
            while last < len(starts):
                tall, wide = max(tall, int(heights[last])), max(wide, int(widths[last]))
                if last > first and (last - first + 1) * (tall + up + down) * (wide + left + right) > CELLS:
                    break
                last += 1
            part = table.slice(starts[first], ends[last - 1] - starts[first])
            here = slice(starts[first], ends[last - 1])
            tile = np.repeat(np.arange(last - first), (ends - starts)[first:last])
            values = {c: part[c].cast(pa.float64()).to_numpy() for c in inputs}
            found = kernel(Stack(values, tile, row[here], col[here], rims))
            keep = part["_own"].to_numpy()
            kept = part.filter(pa.array(keep)).select(names)
            for name, kind in outputs.items():
                result = found[name][tile[keep], row[here][keep], col[here][keep]]
                kept = kept.append_column(name, pa.array(result, from_pandas=True) if kind != "boolean" else pa.array(result.astype(bool)))
            yield from kept.combine_chunks().to_batches()
            first = last

    def run(batches):
        held, rows_held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(c).to_numpy() for c in order]
            inside = np.all([x == x[-1] for x in at], axis=0)
            cut = 0 if inside.all() else int(np.flatnonzero(~inside)[-1]) + 1
            if held and not all(held[-1].column(c)[held[-1].num_rows - 1].as_py() == x[0] for c, x in zip(order, at)):
                yield from done(pa.Table.from_batches(held))
                held = []
            if cut:
                yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, ", ".join(kinds))


def window_places(reach: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)]


def local_moments(name: str, reach: int):
    """Mean and population variance of the values in the window; null places don't count."""

    def kernel(s: Stack) -> dict[str, np.ndarray]:
        count, total = np.zeros(s.shape), np.zeros(s.shape)
        for d in window_places(reach):
            x = s.at(name, *d)
            on = ~np.isnan(x)
            count += on
            total += np.where(on, x, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total / count
        square = np.zeros(s.shape)
        for d in window_places(reach):
            square += np.nan_to_num(s.at(name, *d) - mean) ** 2
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"mean": mean, "var": square / count}

    return kernel


def local_median(name: str, reach: int):
    def kernel(s: Stack) -> dict[str, np.ndarray]:
        around = np.sort(np.stack([s.at(name, *d) for d in window_places(reach)]), axis=0)  # NaN comes last
        count = (~np.isnan(around)).sum(0)
        low, high = (np.take_along_axis(around, k[None], axis=0)[0] for k in (np.maximum(count - 1, 0) // 2, np.minimum(count // 2, len(around) - 1)))
        return {"median": (low + high) / 2}

    return kernel


def nearest_value(name: str, reach: int):
    """The value at the nearest place that has one; of equally near ones the smallest."""
    rings: dict[int, list[tuple[int, int]]] = {}
    for r, c in window_places(reach):
        rings.setdefault(r * r + c * c, []).append((r, c))

    def kernel(s: Stack) -> dict[str, np.ndarray]:
        out = np.full(s.shape, np.nan)
        for square in sorted(rings):
            if not np.isnan(out).any():
                break
            least = np.fmin.reduce([s.at(name, *d) for d in rings[square]])
            out = np.where(np.isnan(out), least, out)
        return {"_f": out}

    return kernel


def gaussian(name: str, sigma: float, reach: int):
    """Mean weighted by a Gaussian of the distance, of the places that exist within ``reach`` along both axes."""
    weight = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2.0 * sigma * sigma))

    def along(x: np.ndarray, axis: int, n: int) -> np.ndarray:
        return sum(w * np.take(x, range(k, k + n), axis=axis) for k, w in enumerate(weight))

    def kernel(s: Stack) -> dict[str, np.ndarray]:
        x = s.arrays[name]
        on = ~np.isnan(x)
        parts = [along(along(v, 1, s.shape[1]), 2, s.shape[2]) for v in (np.where(on, x, 0.0), on.astype(float))]
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"low": parts[0] / parts[1]}

    return kernel


def ray_steps(resolution: float, azimuth: float, elevation: float, reach_m: float) -> list[tuple[int, int, float]]:
    """Places on the ray towards the sun, and how much the ray has risen there."""
    turn, rise = np.radians(azimuth), np.tan(np.radians(max(elevation, 1.0))) * resolution
    return [(-round(k * float(np.cos(turn))), round(k * float(np.sin(turn))), k * rise) for k in range(1, int(reach_m / resolution) + 1)]


def halo_of(steps: list[tuple[int, int, float]]) -> tuple[int, int, int, int]:
    rows, cols = [0, *(s[0] for s in steps)], [0, *(s[1] for s in steps)]
    return -min(rows), max(rows), -min(cols), max(cols)


def shaded(name: str, steps: list[tuple[int, int, float]]):
    """Whether terrain on the ray rises above it."""

    def kernel(s: Stack) -> dict[str, np.ndarray]:
        z, found = s.at(name), np.zeros(s.shape, bool)
        for dr, dc, rise in steps:
            found |= s.at(name, dr, dc) - rise > z  # NaN is never higher
        return {"shadow": found}

    return kernel


def slope_parts(s: Stack, name: str, resolution: float, grow: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rise along rows and columns: central differences, one-sided where one neighbour is missing."""
    z = s.at(name, 0, 0, grow)
    out = []
    for dr, dc in ((1, 0), (0, 1)):
        before, after = s.at(name, -dr, -dc, grow), s.at(name, dr, dc, grow)
        out.append(np.where(np.isnan(before), after - z, np.where(np.isnan(after), z - before, (after - before) / 2)) / resolution)
    return out[0], out[1]


def static_layers(name: str, glacier: str, resolution: float, reach: int, far_m: float):
    """Slope in degrees, aspect smoothed over neighbours, and whether ice is within ``far_m``."""
    near = [(r, c) for r, c in window_places(reach) if np.hypot(r, c) * resolution <= far_m]

    def kernel(s: Stack) -> dict[str, np.ndarray]:
        y, x = slope_parts(s, name, resolution, 1)
        aspect = np.arctan2(-x, y)
        sin, cos = np.zeros(s.shape), np.zeros(s.shape)
        rows, cols = s.shape[1:]
        for dr, dc in window_places(1):
            here = np.s_[:, 1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]
            # Means of both over the same places: their number doesn't matter to the angle.
            sin += np.nan_to_num(np.sin(aspect[here]))
            cos += np.nan_to_num(np.cos(aspect[here]))
        inner = np.s_[:, 1:-1, 1:-1]
        ice = np.zeros(s.shape, bool)
        for d in near:
            ice |= s.at(glacier, *d) == 1
        return {"slope": np.degrees(np.arctan(np.hypot(x[inner], y[inner]))), "aspect": np.degrees(np.arctan2(sin, cos)) % 360, "near_ice": ice}

    return kernel
