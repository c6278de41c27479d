"""Exact top-k search by inner product as a Voronoi join.

Vectors become integers, floor(scale * x). A bounded set of pivots cuts the space into cells. A summary of each cell, its
radius and the few members nearest its pivot, is small and goes to every task. From the members a query gets a first lower
bound for its k-th best score; no vector of a cell can score above <query, pivot> + |query| * radius, so a query goes only
to the cells whose bound reaches its own. The data is far larger than the queries and moves once: queries are replicated to
the cells, not vectors to the queries.

A group is a chunk of a cell's queries with a part of its vectors, both bounded: a cell with a third of all rows makes more
groups, not larger ones. In a group the vectors are cut into blocks by their distance from the cell's centre; a block has a
centre, a radius and a largest norm of its own, and is passed over for the queries whose running k-th score it can't reach.
A group returns k rows a query, and a last merge keeps the k best. ``discarded`` tells the share of blocks passed over; in
many dimensions without clusters no bound of this kind discards anything, and each query is compared with all vectors.

Nulls, ties, repeats: vectors that are null, or hold a null or a non-finite component, and rows with a null id take no
part; vectors shorter than others count as padded with zeros; ties go to the smaller id; rows with the query's own id are
not its candidates; repeated rows are candidates each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices

PIVOTS = 48
#: Queries and vectors of a group, about, and those that are scored at once.
CHUNK_QUERIES, CHUNK_ROWS = 8192, 16384
BLOCK_QUERIES, BLOCK_ROWS = 256, 1024


def integers(embedding: Column, scale: int) -> Column:
    """The vector as longs; null if it takes no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles, padded to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(column) and (np.diff(ends, prepend=0) == dim).all():
        return flat.reshape(len(column), dim).astype(float)
    out = np.zeros((len(column), dim))
    for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
        out[k, : b - a] = flat[a:b]
    return out


class Cells:
    """Pivots, and by cell its radius and nearest members (ids and vectors)."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots, self.dim = pivots, pivots.shape[1]
        self.radius = np.full(len(pivots), -1.0)
        self.ids, self.members = np.zeros(0, np.int64), np.zeros((0, self.dim))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row, and the distance to it."""
        square = (x * x).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1)[None]
        cell = square.argmin(1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))

    def needed(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries by cells: whether a vector of the cell may be among the k best of the query; and the lower bounds."""
        scores = x @ self.members.T
        scores[ids[:, None] == self.ids[None]] = -np.inf
        low = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(x), -np.inf)
        high = x @ self.pivots.T + np.sqrt((x * x).sum(1))[:, None] * self.radius[None]
        low -= 1e-6 * (1 + np.abs(low))
        return (high >= low[:, None]) & (self.radius >= 0)[None], low


def summarised(vectors: DataFrame, pivots: int, k: int) -> Cells | None:
    """The cells. The driver gets the pivots, and from each cell k + 1 members and a radius: bounded by parameters."""
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots * 8).select("v").collect()
    dim = vectors.agg(F.max(F.size("v"))).first()[0]
    if not chosen or not dim:
        return None
    x = np.unique(np.array([r["v"] + [0] * (dim - len(r["v"])) for r in chosen], float), axis=0)
    picked = [0]  # far points first: each next pivot is the one farthest from those before
    far = ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(pivots, len(x)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    cells = Cells(x[picked])

    def local(batches):
        radius, best = np.full(len(cells.pivots), -1.0), {}
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            cell, distance = cells.of(x)
            np.maximum.at(radius, cell, distance)
            for c in np.unique(cell):
                own = np.flatnonzero(cell == c)
                own = own[np.lexsort((ids[own], distance[own]))][: k + 1]
                best[c] = sorted([*best.get(c, []), *((distance[i], int(ids[i]), x[i].astype(np.int64).tolist()) for i in own)])[: k + 1]
        rows = [(int(c), float(radius[c]), *m) for c, ms in best.items() for m in ms]
        yield pa.RecordBatch.from_arrays([pa.array(list(a)) for a in zip(*rows)] if rows else [pa.array([], t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))], ["cell", "radius", "distance", "vec_id", "v"])

    found = vectors.mapInArrow(local, "cell long, radius double, distance double, vec_id long, v array<long>")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("distance", "vec_id"))
    widest = F.max("radius").over(Window.partitionBy("cell"))
    rows = found.select("*", place.alias("place"), widest.alias("widest")).where(F.col("place") <= k + 1).collect()
    for r in rows:
        cells.radius[r["cell"]] = r["widest"] * (1 + 1e-9) + 1e-9
    cells.ids = np.array([r["vec_id"] for r in rows], np.int64)
    cells.members = np.array([r["v"] + [0] * (dim - len(r["v"])) for r in rows], float)
    return cells


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return np.lexsort((ids, -scores))[:k]


def solved(q: np.ndarray, x: np.ndarray, low: np.ndarray, rows: np.ndarray, r_ids: np.ndarray, k: int) -> tuple[list, int, int]:
    """The k best (query id, row id, score) of each query among ``rows``, and the blocks compared and passed over.

    ``low`` is what a score must reach to matter; it rises with the scores that are found."""
    centre = rows.mean(0)
    order = np.argsort(((rows - centre) ** 2).sum(1), kind="stable")
    rows, r_ids, norms = rows[order], r_ids[order], np.sqrt((rows[order] ** 2).sum(1))
    blocks = []
    for a in range(0, len(rows), BLOCK_ROWS):
        own = rows[a : a + BLOCK_ROWS]
        mid = own.mean(0)
        blocks.append((a, mid, np.sqrt(((own - mid) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-9, norms[a : a + BLOCK_ROWS].max()))
    out, compared, passed = [], 0, 0
    for start in range(0, len(q), BLOCK_QUERIES):
        own, own_ids, bound = x[start : start + BLOCK_QUERIES], q[start : start + BLOCK_QUERIES], low[start : start + BLOCK_QUERIES].copy()
        size = np.sqrt((own * own).sum(1))
        best: list[list[tuple[float, int]]] = [[] for _ in own_ids]
        for a, mid, radius, norm in sorted(blocks, key=lambda b: -float((own @ b[1]).max())):
            high = np.minimum(own @ mid + size * radius, size * norm)
            on = np.flatnonzero(high * (1 + 1e-9) + 1e-6 >= bound)
            compared, passed = compared + len(on), passed + len(own_ids) - len(on)
            if not len(on):
                continue
            near = r_ids[a : a + BLOCK_ROWS]
            scores = own[on] @ rows[a : a + BLOCK_ROWS].T
            scores[own_ids[on][:, None] == near[None]] = -np.inf
            for i, values in zip(on, scores):
                fine = np.flatnonzero((values >= bound[i]) & (values > -np.inf))
                fine = fine[best_rows(near[fine], values[fine], k)]
                if len(fine):
                    best[i] = sorted([*best[i], *((-values[j], int(near[j])) for j in fine)])[:k]
                    if len(best[i]) == k:
                        bound[i] = max(bound[i], -best[i][-1][0])
        out += [(int(own_ids[i]), j, int(-s)) for i, found in enumerate(best) for s, j in found]
    return out, compared, passed


def nearest(table: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``.

    ``table`` has vec_id and embedding. Inner products are exact: they stay below 2**53.
    """
    groups = solved_groups(table, every, k, scale, pivots)
    found = groups.where(F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def discarded(table: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """One row: pairs of a query and a block that were compared, those passed over, and the latter's share."""
    sums = solved_groups(table, every, k, scale, pivots).agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"))
    return sums.withColumn("share", F.coalesce(F.try_divide("passed", F.col("compared") + F.col("passed")), F.lit(0.0)))


def solved_groups(table: DataFrame, every: int, k: int, scale: int, pivots: int) -> DataFrame:
    """(query_id, vec_id, score, compared, passed): the best rows of each group, and a row of counts for each."""
    spark = table.sparkSession
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"))
    vectors = saved(vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()))
    cells = summarised(vectors, pivots, k)
    if cells is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score long, compared long, passed long")
    dim, counted = cells.dim, len(cells.pivots)

    def cell_of(batches):
        for batch in batches:
            cell, _ = cells.of(matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cell), *batch.columns], ["cell", "vec_id", "v"])

    def wanted(batches):
        for batch in slices(batches):
            need, low = cells.needed(batch.column(0).to_numpy(), matrix(batch.column(1), dim), k)
            q, c = np.nonzero(need)
            at = pa.array(q)
            yield pa.RecordBatch.from_arrays([pa.array(c), batch.column(0).take(at), batch.column(1).take(at), pa.array(low).take(at)], ["cell", "vec_id", "v", "low"])

    celled = vectors.mapInArrow(cell_of, "cell long, vec_id long, v array<long>")
    asked = vectors.where(F.col("vec_id") % every == 0).mapInArrow(wanted, "cell long, vec_id long, v array<long>, low double")
    # One number a cell: into how many chunks and parts its queries and vectors are dealt.
    many = [{r["cell"]: -(-r["n"] // most) for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()} for df, most in ((asked, CHUNK_QUERIES), (celled, CHUNK_ROWS))]
    chunks, parts = (F.element_at(F.array(*[F.lit(x.get(c, 1)) for c in range(counted)]), (F.col("cell") + 1).cast("int")) for x in many)

    def every_of(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    queries = asked.select("cell", F.pmod(F.xxhash64("vec_id", F.lit(7)), chunks).cast("int").alias("chunk"), every_of(parts).alias("part"), "vec_id", "v", "low")
    data = celled.select("cell", F.pmod(F.xxhash64("vec_id", F.hash("v")), parts).cast("int").alias("part"), every_of(chunks).alias("chunk"), "vec_id", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out, compared, passed = [], 0, 0
        if left.num_rows and right.num_rows:
            out, compared, passed = solved(left["vec_id"].to_numpy(), matrix(left["v"], dim), left["low"].to_numpy(), matrix(right["v"], dim), right["vec_id"].to_numpy(), k)
        columns = [*(zip(*out) if out else ([], [], []))]
        return pa.table(
            [*[pa.array([*c, None], pa.int64()) for c in columns], pa.array([0] * len(out) + [compared], pa.int64()), pa.array([0] * len(out) + [passed], pa.int64())],
            names=["query_id", "vec_id", "score", "compared", "passed"],
        )

    by = ["cell", "chunk", "part"]
    return queries.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(solve, "query_id long, vec_id long, score long, compared long, passed long")
