"""Hard-negative mining with an inverted multi-index.

Vectors become integers, floor(scale * x), and are cut into two halves. Each half-space has a codebook, fitted on a bounded
sample (``SAMPLE_ROWS``); a row's cell is its pair of nearest codes. Every row is in the index: rows are dealt into parts of
bounded size by cell, so a part holds near cells, and a cell with a third of all rows makes more parts, not a larger one. In
a part, each code has the largest distance of its rows from it, a radius that is tighter than one over all rows.

An anchor visits a part's cells from the best bound down. Its score with a row is the sum of two half scores, and in a half
no row of a code scores above <q, code> + |q| * radius or below <q, code> - |q| * radius. The codes of either half are
sorted by that bound, and a heap walks their pairs in descending order of the sum (multi-sequence), so all cells that are
still to come are below the last bound. A window (a range of scores, of which the k best rows are wanted) is certified and
closed once its k-th score is above the next bound, or the next bound is below the window; cells that lie above all open
windows are passed over. The search of a part is exact, so no recall is lost anywhere.

Two searches are made: one for each anchor's positives, the best rows of its own label, with one window that holds every
score; and one for its negatives, rows of other labels, with a window for each positive. Each part returns k rows a window
and a last merge keeps the k best. Anchors and parts are grouped in bounded chunks; nothing of the rows goes to the driver
but the sample and a count for each cell.

Nulls, ties, repeats: rows with a null id, label or vector, or a vector with a null or a non-finite component, take no part;
shorter vectors count as padded with zeros; ties go to the smaller id; rows that share an anchor's id are never its
positives or negatives, and of several such rows the one with the smallest label and vector is the anchor; repeated rows
are candidates each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .vectors import best_rows, integers, matrix

#: Codes of a half-space, and the rows that they are fitted on.
CODES, SAMPLE_ROWS, FIT_ROUNDS = 16, 8192, 8
#: Anchors and rows of a group, about; anchors that are scored with a cell at once; rows that an anchor takes in a step.
CHUNK_ANCHORS, PART_ROWS, BLOCK_ANCHORS, STEP_ROWS = 16384, 16384, 128, 512
WINDOWS = "array<struct<place: bigint, low: bigint, high: bigint>>"


def slack(x: np.ndarray) -> np.ndarray:
    """A bound raised by more than what rounding takes from it."""
    return x + 1e-9 * np.abs(x) + 1e-6


def fitted(x: np.ndarray, codes: int) -> np.ndarray:
    """A codebook: Lloyd's rounds from points far from each other."""
    x = np.unique(x, axis=0)
    picked = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(codes, len(x)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    book = x[picked]
    for _ in range(FIT_ROUNDS):
        own = nearest_code(x, book)
        sums = np.zeros_like(book)
        np.add.at(sums, own, x)
        many = np.bincount(own, minlength=len(book))
        book = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], book)
    return book


def nearest_code(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1)[None] - 2 * x @ book.T).argmin(1)


class Halves:
    """Two codebooks, and what they say of vectors."""

    def __init__(self, sample: np.ndarray, codes: int) -> None:
        self.cut = sample.shape[1] // 2
        self.books = [fitted(half, codes) for half in self.of(sample)]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        return [nearest_code(half, book) for half, book in zip(self.of(x), self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = self.codes(x)
        return first * len(self.books[1]) + second


class MultiIndex:
    """The inverted multi-index of a part: rows by cell, and a radius for each code."""

    def __init__(self, halves: Halves, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.halves = halves
        codes = halves.codes(x)
        wide = len(halves.books[1])
        cell = codes[0] * wide + codes[1]
        order = np.argsort(cell, kind="stable")
        self.x, self.ids, self.labels = x[order], ids[order], labels[order]
        self.ends = np.searchsorted(cell[order], np.arange(len(halves.books[0]) * wide + 1))
        self.radii = []
        for half, book, own in zip(halves.of(x), halves.books, codes):
            radius = np.full(len(book), -np.inf)
            np.maximum.at(radius, own, np.sqrt(((half - book[own]) ** 2).sum(1)))
            self.radii.append(radius)

    def search(self, ids: np.ndarray, x: np.ndarray, labels: np.ndarray, windows: list, same: bool, k: int) -> tuple[list, int]:
        """(anchor, place of the window, row, score) of the k best rows in each window, and how many rows were scored.
        ``windows`` has a list of (place, low, high) for each anchor."""
        out, scored = [], 0
        for a in range(0, len(x), BLOCK_ANCHORS):
            block = slice(a, a + BLOCK_ANCHORS)
            high, low = [], []
            for half, book, radius in zip(self.halves.of(x[block]), self.halves.books, self.radii):
                mid, reach = half @ book.T, np.sqrt((half * half).sum(1))[:, None] * np.where(radius < 0, 0, radius)[None]
                high.append(np.where(radius[None] < 0, -np.inf, slack(mid + reach)))
                low.append(np.where(radius[None] < 0, -np.inf, -slack(reach - mid)))
            scores: dict[int, np.ndarray] = {}
            for i in range(len(high[0])):
                own = Wanted(windows[a + i], k)
                mask = (ids[a + i], labels[a + i], same)
                scored += self.visit(x[block], i, [h[i] for h in high], [v[i] for v in low], scores, own, mask)
                out += [(int(ids[a + i]), *found) for found in own.rows()]
        return out, scored

    def visit(self, block: np.ndarray, i: int, high: list, low: list, scores: dict, wanted: "Wanted", mask: tuple) -> int:
        """Anchor ``i`` of a block walks the cells. Scores of a cell are computed for the whole block when the first of its
        anchors comes there."""
        wide = len(high[1])
        order = [np.argsort(-h, kind="stable") for h in high]
        first, second = (h[o].tolist() for h, o in zip(high, order))
        heap, seen, scored, cells, held = [(-first[0] - second[0], 0, 0)], {(0, 0)}, 0, [], 0
        while heap and wanted.open:
            bound, p, q = heapq.heappop(heap)
            if bound == np.inf:
                break
            for n in ((p + 1, q), (p, q + 1)):
                if n[0] < len(first) and n[1] < len(second) and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (-first[n[0]] - second[n[1]], *n))
            c, d = int(order[0][p]), int(order[1][q])
            cell = c * wide + d
            size = int(self.ends[cell + 1] - self.ends[cell])
            if size and low[0][c] + low[1][d] <= wanted.highest:
                cells.append(cell)
                held += size
            rest = -heap[0][0] if heap else -np.inf
            if cells and (held >= STEP_ROWS or not heap or rest == -np.inf):
                scored += held
                self.take(block, i, cells, scores, wanted, mask)
                cells, held = [], 0
            if not cells:
                wanted.certify(rest)
        if cells and wanted.open:
            scored += held
            self.take(block, i, cells, scores, wanted, mask)
        return scored

    def take(self, block: np.ndarray, i: int, cells: list[int], scores: dict, wanted: "Wanted", mask: tuple) -> None:
        for c in cells:
            if c not in scores:
                scores[c] = block @ self.x[self.ends[c] : self.ends[c + 1]].T
        places = np.concatenate([np.arange(self.ends[c], self.ends[c + 1]) for c in cells])
        values = np.concatenate([scores[c][i] for c in cells])
        own_id, label, same = mask
        fine = ((self.labels[places] == label) == same) & (self.ids[places] != own_id) & (values >= wanted.lowest) & (values <= wanted.highest)
        wanted.add(self.ids[places[fine]], values[fine])


class Wanted:
    """The windows of an anchor, the best rows of each so far, and which are still open."""

    def __init__(self, windows: list[tuple[int, float, float]], k: int) -> None:
        self.k = k
        self.best = {place: (np.zeros(0, np.int64), np.zeros(0)) for place, _, _ in windows}
        self.open = {place: (low, high) for place, low, high in windows if low <= high}
        self.span()

    def span(self) -> None:
        self.lowest = min((low for low, _ in self.open.values()), default=np.inf)
        self.highest = max((high for _, high in self.open.values()), default=-np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for place, (low, high) in self.open.items():
            inside = (scores >= low) & (scores <= high)
            own_ids, own = np.concatenate([self.best[place][0], ids[inside]]), np.concatenate([self.best[place][1], scores[inside]])
            keep = best_rows(own_ids, own, self.k)
            self.best[place] = own_ids[keep], own[keep]

    def certify(self, bound: float) -> None:
        """Closes windows to which no row with a score of at most ``bound`` can add."""
        closed = [place for place, (low, _) in self.open.items() if bound < low or len(self.best[place][0]) == self.k and bound < self.best[place][1][-1]]
        if closed:
            for place in closed:
                del self.open[place]
            self.span()

    def rows(self):
        for place, (ids, scores) in self.best.items():
            yield from ((place, int(r), int(s)) for r, s in zip(ids.tolist(), scores.tolist()))


def halves_of(rows: DataFrame, codes: int) -> tuple[Halves, int] | None:
    """The codebooks and the vectors' length; None without any component."""
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
    if not dim or not sample.num_rows:
        return None
    return Halves(matrix(sample["v"], dim), codes), dim


class Index:
    """All rows in parts, by cell."""

    def __init__(self, rows: DataFrame, codes: int, part_rows: int = PART_ROWS) -> None:
        """``rows`` has vec_id, label and v, none null."""
        self.halves, self.dim = halves_of(rows, codes) or (None, 0)
        if self.halves is None:
            return
        halves, dim = self.halves, self.dim

        def with_cell(batches):
            for batch in batches:
                cell = halves.cells(matrix(batch.column(2), dim)) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *batch.columns], ["cell", "vec_id", "label", "v"])

        celled = saved(rows.select("vec_id", "label", "v").mapInArrow(with_cell, "cell long, vec_id long, label long, v array<long>"))
        # A count for each cell: neighbouring cells share a part, a large cell is dealt into several.
        counts = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        first, many = [0] * len(halves.books[0]) * len(halves.books[1]), [1] * len(halves.books[0]) * len(halves.books[1])
        part, held = 0, 0
        for cell in range(len(first)):
            n = counts.get(cell, 0)
            if held and held + n > part_rows:
                part, held = part + 1, 0
            first[cell], many[cell] = part, max(1, -(-n // part_rows))
            held += n
            if many[cell] > 1:
                part, held = part + many[cell], 0
        self.parts = part + (held > 0)
        at = (F.col("cell") + 1).cast("int")
        start, count = (F.element_at(F.array(*[F.lit(x) for x in values]), at) for values in (first, many))
        self.rows = celled.withColumn("part", (start + F.pmod(F.xxhash64("vec_id", F.hash("v")), count)).cast("int"))

    def best(self, anchors: DataFrame, same: bool, k: int, chunk: int = CHUNK_ANCHORS) -> DataFrame:
        """(anchor_id, place, vec_id, score, scored) of each part: the k best rows of an anchor's label, or of other labels, in
        each of its windows, and a row without an anchor that tells how many rows the part scored. ``anchors`` has anchor_id,
        label, v and windows."""
        chunks = max(1, -(-anchors.count() // chunk))
        halves, dim = self.halves, self.dim
        asked = anchors.select(F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"), "anchor_id", "label", "v", "windows")
        data = self.rows.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "part", "vec_id", "label", "v")

        def solve(left: pa.Table, right: pa.Table) -> pa.Table:
            out, scored = [], 0
            if left.num_rows and right.num_rows:
                index = MultiIndex(halves, matrix(right["v"], dim), right["vec_id"].to_numpy(), right["label"].to_numpy())
                windows = [[(w["place"], -np.inf if w["low"] is None else w["low"], np.inf if w["high"] is None else w["high"]) for w in ws] for ws in left["windows"].to_pylist()]
                out, scored = index.search(left["anchor_id"].to_numpy(), matrix(left["v"], dim), left["label"].to_numpy(), windows, same, k)
            columns = [*(zip(*out) if out else ([], [], [], []))]
            return pa.table([*[pa.array([*c, None], pa.int64()) for c in columns], pa.array([None] * len(out) + [scored], pa.int64())], names=["anchor_id", "place", "vec_id", "score", "scored"])

        by = ["chunk", "part"]
        return asked.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(solve, "anchor_id long, place long, vec_id long, score long, scored long")


def prepared(table: DataFrame, scale: int) -> DataFrame:
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(F.col("embedding"), scale).alias("v"))
    return saved(rows.dropna())


def one_window() -> Column:
    """Every score."""
    return F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))).cast(WINDOWS)


def placed(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each anchor and window over all parts."""
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    return found.where(F.col("anchor_id").isNotNull()).select("anchor_id", "place", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def mined(table: DataFrame, every: int = 100, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, codes: int = CODES, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows of ``table`` (vec_id, embedding, label) whose id is divisible by ``every``. Negatives of an anchor and
    one of its positives score between ``low`` and ``high`` percent of the positive. Inner products are exact: they stay
    below 2**53.
    """
    rows = prepared(table, scale)
    index = Index(rows, codes, part_rows)
    if index.halves is None:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    anchors = saved(anchors.select(F.col("vec_id").alias("anchor_id"), "x.label", "x.v"))
    own = placed(index.best(anchors.withColumn("windows", one_window()), True, positives), positives)
    own = saved(own.select("anchor_id", F.col("rank").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * p <= 100 * n <= high * p, in whole numbers.
    score = F.col("positive_score")
    window = F.struct("place", F.ceil((low * score).cast("decimal(28,2)") / 100).cast("long").alias("low"), F.floor((high * score).cast("decimal(28,2)") / 100).cast("long").alias("high"))
    asked = own.groupBy("anchor_id").agg(F.collect_list(window).cast(WINDOWS).alias("windows")).join(anchors, "anchor_id")
    found = placed(index.best(asked, False, negatives), negatives)
    return found.join(own, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def scored_share(table: DataFrame, every: int = 100, scale: int = 256, positives: int = 5, codes: int = CODES, part_rows: int = PART_ROWS) -> float:
    """Share of all pairs of an anchor and a row that the search for positives scored."""
    rows = prepared(table, scale)
    index = Index(rows, codes, part_rows)
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", "v", one_window().alias("windows"))
    done = index.best(anchors, True, positives).agg(F.sum("scored")).first()[0]
    return done / max(1, anchors.count() * rows.count())
