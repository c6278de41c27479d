"""Downstream routing over elevation: receivers are a set operation, walks are one group a start."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import shifted

#: Length of a diagonal step in pixels (fixed value).
DIAGONAL = 1.4142135


def receivers(px: DataFrame, keys: list[str], resolution: float) -> DataFrame:
    """For each pixel the neighbour with the steepest drop a unit of distance (null at pits); ties to the smaller place."""
    near = shifted(px, keys, 1).where("dr <> 0 or dc <> 0")
    drop = (F.col("v") - F.col("_n")) / (resolution * F.when((F.col("dr") != 0) & (F.col("dc") != 0), DIAGONAL).otherwise(1.0))
    met = px.join(near, [*keys, "row", "col"]).withColumn("drop", drop).where("drop > 0")
    best = met.groupBy(*keys, "row", "col").agg(F.max_by(F.struct((F.col("row") - F.col("dr")).alias("to_row"), (F.col("col") - F.col("dc")).alias("to_col"), "drop"), F.struct(F.round("drop", 9), F.col("dr"), F.col("dc"))).alias("b"))
    return px.join(best, [*keys, "row", "col"], "left").select(*keys, "row", "col", "b.to_row", "b.to_col", "b.drop")


AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def escape(z: np.ndarray, pit: tuple[int, int], visited: set, most: int) -> list[tuple[int, int]]:
    """Route out of a pit: its surroundings are flooded, lowest first, and the first cell that the flood touches and that
    is an edge cell, or lower than the pit and new to the walk, is the way out."""
    rows, cols = z.shape
    queue, origin = [(z[pit], pit)], {pit: pit}
    for _ in range(most):
        if not queue:
            break
        _, at = heapq.heappop(queue)
        for dr, dc in AROUND:
            to = (at[0] + dr, at[1] + dc)
            if to in origin or not (0 <= to[0] < rows and 0 <= to[1] < cols):
                continue
            origin[to] = at
            if to[0] in (0, rows - 1) or to[1] in (0, cols - 1) or (z[to] < z[pit] and to not in visited):
                route = []
                while to != pit:
                    route.append(to)
                    to = origin[to]
                return route[::-1]
            heapq.heappush(queue, (z[to], to))
    return []


def descend(z: np.ndarray, start: tuple[int, int], resolution: float, max_km: float, most: int = 200_000) -> list[tuple[int, int, float]]:
    """Cells and kilometres of the walk down the steepest unvisited neighbour, out of pits by ``escape``; it ends at the edge
    or after ``max_km``."""
    rows, cols = z.shape
    at, along, out, visited = start, 0.0, [(*start, 0.0)], {start}
    while along < max_km and 0 < at[0] < rows - 1 and 0 < at[1] < cols - 1:
        drops = [((z[at] - z[n]) / (DIAGONAL if dr and dc else 1.0), -k, n) for k, (dr, dc) in enumerate(AROUND) if (n := (at[0] + dr, at[1] + dc)) not in visited]
        best = max(drops, default=(0.0, 0, at))
        route = [best[2]] if best[0] > 0 else escape(z, at, visited, most)
        if not route:
            break
        for n in route:
            along += resolution / 1000 * (DIAGONAL if n[0] != at[0] and n[1] != at[1] else 1.0)
            out.append((*n, along))
            visited.add(n)
            at = n
    return out


def snapped_starts(px: DataFrame, keys: list[str], starts: DataFrame, reach: int = 3) -> DataFrame:
    """``starts`` (keys, start_id, row, col) moved to the lowest cell within ``reach``; ties to the smaller place."""
    near = starts.select(*keys, "start_id", F.explode(F.sequence(F.col("row") - reach, F.col("row") + reach)).alias("row"), "col").withColumn("col", F.explode(F.sequence(F.col("col") - reach, F.col("col") + reach)))
    low = near.join(px, [*keys, "row", "col"]).groupBy(*keys, "start_id").agg(F.min(F.struct("v", "row", "col")).alias("m"))
    return low.select(*keys, "start_id", "m.row", "m.col")


def paths(tiles: DataFrame, starts: DataFrame, rows: int, cols: int, resolution: float, max_km: float) -> DataFrame:
    """(start_id, step, row, col, along_km) from ``starts`` (start_id, tile, row, col) on ``tiles`` (tile, z: flat array).
    Each start is a row with its tile, so starts spread over all tasks."""

    def run(batches):
        for batch in batches:
            out = []
            for sid, r, c, z in zip(*(x.to_pylist() for x in batch.columns)):
                for k, (a, b, km) in enumerate(descend(np.array(z, float).reshape(rows, cols), (r, c), resolution, max_km)):
                    out.append((sid, k, a, b, km))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["start_id", "step", "row", "col", "along_km"])

    return starts.join(tiles, "tile").select("start_id", "row", "col", "z").mapInArrow(run, "start_id long, step int, row int, col int, along_km double")
