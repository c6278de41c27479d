"""Near-duplicate documents by an LSH forest of MinHash signatures, and the components of their links.

A document's set holds the 64-bit hashes of its word shingles; equal sets are one class. The least hashes in
``TREES * DEPTH`` ranges make as many minima (an empty range borrows from the next that isn't), and each tree is an order of
its own ``DEPTH`` minima: all classes sorted by that part of their signature.

1. Neighbours. In each sorted order a class is a candidate with the one before it, if they have ``LEAST_DEPTH`` minima in
   common: that is the class with the longest common prefix on that side.
2. Regions. Rows of an order that share a prefix are a region. Where a region holds more than ``REGION`` rows the tree goes
   deeper, so each row gets the least depth at which its region is small: shallow where documents are few, deep where they
   crowd. A row is also in its region of ``SHALLOW`` depth, however large, where thousands of near copies of one text meet the
   text itself. Members of a region are compared with one centre only, the one that shares most regions with the others, in
   a few rounds, so the pairs of a large region are not looked at.
3. All candidates are bounded by sizes and bitmaps first, and confirmed on full sets.
4. A forest is a filter by chance. What it may have missed is found by an exact join. In an order of all shingles, rare
   before frequent, two sets with enough overlap have shingles of their prefixes in common: ``COMMON`` for the most different
   sizes, as prefixes are longer by as many less one, and by what a prefix is too long for the overlap that is due more for
   sizes closer to each other. So a pair of classes in different components that meets in so many lists of shingles is
   confirmed on full sets, others can't be linked. The lists of shingles that are known to be in over ``HOT`` sets go through the tiles
   of ``jaccard`` instead, where one meeting is enough. No link between components is lost.

Rows of equal signature are dealt apart by a hash of their id, so one group of copies doesn't fill a task.

Nulls, ties, repeats: null or empty text has an empty set, links with nothing and is a component of its own; a row with a
null id takes no part, has a null component and isn't kept; rows that share an id are one document; repeated rows get equal
results; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, saved
from .jaccard import MAX_WANTED, MULTIPLIER, Corpus, Texts, exact_links, live_pairs, mixed, prefixes, star_links, with_bits, with_components

WORDS = 2
TREES, DEPTH, LEAST_DEPTH, SHALLOW = 8, 8, 2, 4
#: Rows of a region, where the tree is deep enough for it; rows that a task looks at together.
REGION, BLOCK_ROWS = 16, 1 << 18
EDGES = np.arange(TREES * DEPTH, dtype=np.uint64) << np.uint64(64 - (TREES * DEPTH - 1).bit_length())
#: Shingles that a pair's prefixes must have in common, and sets in which a shingle is hot.
COMMON, HOT = 3, 256
PLACES = 1 << 31
#: Bits of the bitmap that each row of a hot list carries: near copies of one text are many, and close to the bound.
COARSE_BITS = 1024
TOKENS = "node long, band long, shallow long, neighbour long"


def signature(h: np.ndarray) -> np.ndarray:
    """The minima of a set of sorted hashes, in 32 bits each; two minima are packed into one number."""
    first = np.searchsorted(h, EDGES)
    held = np.flatnonzero(np.append(first[1:], len(h)) > first)
    # The next range that isn't empty, around the end; how far it is counts, so that only equal borrowings are equal.
    at = np.searchsorted(held, np.arange(len(EDGES)))
    source = held[at % len(held)]
    far = (source - np.arange(len(EDGES))) % len(EDGES)
    minima = mixed(h[first[source]] + far.astype(np.uint64) * MULTIPLIER) >> np.uint64(32)
    return (minima[::2] << np.uint64(32) | minima[1::2]).view(np.int64)


def depths(common: np.ndarray, most: int = REGION, least: int = LEAST_DEPTH, deepest: int = DEPTH) -> np.ndarray:
    """For sorted rows, of which row k shares ``common[k]`` minima with the row before it (-1 for the first of a tree): the depth
    of each row's region, 0 if it is alone at the least depth."""
    found = np.zeros(len(common), np.int64)
    settled = np.zeros(len(common), bool)
    for d in range(least, deepest + 1):
        region = np.cumsum(common < d)
        size = np.bincount(region)[region]
        found[~settled & (size > 1)] = d  # a row that is alone deeper down stays with the larger region
        settled |= size <= most
    return found


def forest(batches):
    """From sorted (tree, four numbers, node): each row's two regions, and its neighbour."""
    last = None
    for batch in merged(batches):
        tree, *packed, node = (c.to_numpy() for c in batch.columns)
        if not len(node):
            continue
        packed = [p.view(np.uint64) for p in packed]
        values = np.stack([half for p in packed for half in (p >> np.uint64(32), p & np.uint64(0xFFFFFFFF))], axis=1)
        same = np.concatenate([[False], tree[1:] == tree[:-1]])
        equal = np.concatenate([np.zeros((1, DEPTH), bool), values[1:] == values[:-1]])
        if last is not None and last[0] == tree[0]:
            same[0], equal[0] = True, values[0] == last[1]
        common = np.where(same, np.cumprod(equal, axis=1).sum(1), -1)
        depth = depths(common)
        before = np.append(-1 if last is None else last[2], node[:-1])
        last = (tree[-1], values[-1], node[-1])
        prefix = np.zeros((len(node), DEPTH + 1), np.uint64)
        prefix[:, 0] = tree.astype(np.uint64) + np.uint64(1)
        for d in range(DEPTH):
            prefix[:, d + 1] = mixed(prefix[:, d] * MULTIPLIER + values[:, d])
        band = prefix[np.arange(len(node)), depth].view(np.int64)
        met = common >= SHALLOW
        met |= np.append(met[1:], len(met) > 0)  # the last may go on in the next block
        shallow = prefix[:, SHALLOW].view(np.int64)
        near = common >= LEAST_DEPTH
        keep = (depth > 0) | near | met
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(band[keep], mask=depth[keep] == 0), pa.array(shallow[keep], mask=~met[keep]), pa.array(before[keep], mask=~near[keep])], ["node", "band", "shallow", "neighbour"])


def merged(batches):
    """The batches of a task in larger ones."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def candidates(classes: DataFrame) -> DataFrame:
    """(node, band, shallow, neighbour): for each class and tree the numbers of its regions and its neighbour in order, all may
    be null. ``classes`` has node, and the packed signature in ``bands``."""
    wide = DEPTH // 2
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = classes.select("node", "bands", trees.alias("tree"))
    packed = [F.get("bands", F.col("tree") * wide + k).alias(f"s{k}") for k in range(wide)]
    order = ["tree", *[f"s{k}" for k in range(wide)], "salt"]
    rows = rows.select("tree", *packed, "node", F.xxhash64("node").alias("salt"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.select("tree", *[f"s{k}" for k in range(wide)], "node").mapInArrow(forest, TOKENS)


def least_common(percent: int) -> int:
    """``COMMON``, or less where the smallest sets that may link with a different one can't have so much in common."""
    smallest = -(-percent // (100 - percent))
    return max(1, min(COMMON, -(-percent * smallest // 100)))


def due(x: np.ndarray, y: np.ndarray, percent: int, common: int) -> np.ndarray:
    """How many shingles the prefixes of linked sets of these sizes have in common. Of the overlap that is due, a set has at
    most those outside its prefix there, and the shared ones come in the same order in both."""
    overlap = -(-percent * (x + y) // (100 + percent))
    outside = [-(-percent * n // 100) - common for n in (x, y)]
    return overlap - np.maximum(*outside)


def meetings(percent: int, common: int):
    """From rows (shingle, node, comp, n and place), sorted by shingle: a row (a, b, due) for each pair of different components
    in each list, unless sizes and places rule it out. Lists are worked on in whole; a batch may end within one."""

    def run(batches):
        rest = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(rest, columns)]
            last = np.searchsorted(columns[0], columns[0][-1]) if len(columns[0]) else 0
            rest = [c[last:] for c in columns]
            yield paired(*[c[:last] for c in columns])
        if rest is not None:
            yield paired(*rest)

    def paired(shingle, node, comp, packed):
        n, place = packed // PLACES, packed % PLACES
        a, b, least = [], [], []
        at = np.arange(len(shingle))
        if len(shingle):  # lists of one component have no pairs
            starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            mixed_up = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
            at = at[np.repeat(mixed_up, np.diff(np.append(starts, len(shingle))))]
        step = 1
        while True:
            at = at[at + step < len(shingle)]
            at = at[shingle[at] == shingle[at + step]]
            if not len(at):
                break
            other = at + step
            x, y, i, j = n[at], n[other], place[at], place[other]
            most = np.minimum(i, j) + np.minimum(x - i, y - j)
            fine = (comp[at] != comp[other]) & ((100 + percent) * most >= percent * (x + y))
            a.append(node[at[fine]])
            b.append(node[other[fine]])
            least.append(due(x[fine], y[fine], percent, common))
            step += 1
        a, b, least = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b, least))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(least)], ["a", "b", "due"])

    return run


def counted_links(corpus: Corpus, named: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """All links (a, b) between different components of ``named``."""
    facts = with_components(corpus.classes, named)
    common = least_common(percent)
    first = prefixes(texts.docs, corpus.frequent, percent, texts.words, common, HOT)
    first = saved(first.join(facts.select("node", "n", "comp"), F.col("doc_id") == F.col("node")).where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("node", "n", "comp", "prefix", "cold"))
    lists = first.select("node", "n", "comp", F.posexplode(F.slice("prefix", F.lit(1), F.col("cold"))).alias("place", "shingle"))
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = lists.select("shingle", "node", "comp", (F.col("n") * PLACES + F.col("place")).alias("packed")).repartition(parts, "shingle").sortWithinPartitions("shingle")
    met = lists.mapInArrow(meetings(percent, common), "a long, b long, due long").groupBy("a", "b").agg(F.count("*").alias("k"), F.max("due").alias("due")).where(F.col("k") >= F.col("due")).select("a", "b")
    hot = first.where(F.col("cold") < F.size("prefix")).select("node", "n", "comp", F.slice("prefix", F.col("cold") + 1, F.size("prefix") - F.col("cold")).alias("prefix"))
    pairs = saved(met.union(live_pairs(saved(hot), facts, percent)).distinct())
    return exact_links(with_bits(pairs, facts, percent), texts, percent)


def linked(table: DataFrame, words: int = WORDS, percent: int = 80, rounds: int = 2, most_ids: int = MAX_WANTED) -> DataFrame:
    """One row per row of ``table`` (doc_id, text): doc_id, n_shingles, component_id, kept (the id is its component's).
    ``most_ids`` is how many places of documents are sent to all tasks at once; it changes the plan only."""
    corpus = Corpus(table, words, signature, COARSE_BITS)
    found = saved(candidates(corpus.classes))
    regions = found.groupBy("node").agg(F.array_union(F.collect_set("band"), F.collect_set("shallow")).alias("bands"))
    facts = corpus.classes.select("node", "n", "bits")
    crowded = saved(facts.join(regions, "node"))
    near = found.where(F.col("neighbour").isNotNull()).select(F.least("node", "neighbour").alias("a"), F.greatest("node", "neighbour").alias("b")).distinct()
    with Texts(corpus.docs, most_ids, words) as texts:
        sure = exact_links(with_bits(near, facts, percent), texts, percent)
        stars = star_links(crowded, texts, percent, rounds, sure, ("k", "rank"))
        joined = corpus.joined(stars, texts, percent, counted_links)
        return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
