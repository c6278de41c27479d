"""Near-duplicate documents by an exact Jaccard join on word shingles, and the components of its links.

A document's set holds the 64-bit hashes of its 5-word shingles. Equal sets are one class, represented by the smallest id;
all else works on classes.

1. Star links. Minima of the set's hashes in 64 ranges make 16 band keys. In each bucket of a band, members are compared
   with one centre only, each with the centre that it meets most often, in a few rounds with other centres for buckets
   that still hold several components. This joins large groups of near copies without looking at their pairs.
2. The exact join. In one order of all shingles, rare before frequent, two sets with enough overlap share a shingle in
   their prefixes. A prefix shingle held by a single component cannot add a link; those held by two or more are live. In a
   live shingle's list, members outside its largest component meet the members whose size band is theirs or the next (a
   tile; long lists make several tiles of bounded size); sizes, places in the prefixes and the bit counts of hashed bitmaps bound the overlap from above; what passes is
   decided by intersecting the sorted hash arrays. Every pair in different components that could link passes here, so no
   link between components is lost.

The frequency order needs estimates only, as any order gives the same result: shingles that many sets of one task hold are
reported by the task, and the most frequent ``MAX_FREQUENT`` are known to all.

Nulls, ties, repeats: null or empty text has an empty set, links with nothing and is a component of its own; a row with a
null id takes no part and has a null component; rows that share an id are one document; repeated rows get equal results;
an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, saved, shared_dir, slices, small
from .graph import components

WORDS = 5
BANDS, RANGES = 16, 4
#: Bits of a bitmap for each element of its set, and the most bits.
BITS_EACH, MOST_BITS = 2, 1 << 16
#: Bits of the coarse bitmap that each row of a list carries.
COARSE_BITS = 256
#: Pairs with one representative that one task decides together.
MEMBERS = 64
#: A task reports shingles that so many different sets of a block hold.
BLOCK_SETS, BLOCK_SHINGLES = 3, 2_000_000
MAX_FREQUENT = 1 << 18
#: Members of a tile's list that one task compares, and places of documents in a list that is sent to all tasks.
TILE_ROWS, MAX_WANTED = 2048, 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Bytes that are hashed at once, about.
PART = 1 << 18
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


class Shingles:
    """Sorted distinct 64-bit hashes of the word shingles of texts, from arrays of their bytes.

    A word's hash is a sum over its bytes, each a random number of its value times a power of its place, taken from running
    sums over the whole part; the power of the word's start is divided out, as it is odd and has an inverse.
    """

    def __init__(self, words: int = WORDS) -> None:
        self.least = words
        rng = np.random.default_rng(20240611)
        self.table = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.grow(PART)

    def grow(self, size: int) -> None:
        inverse = pow(int(MULTIPLIER), -1, 1 << 64)
        self.power, self.inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, m, np.uint64)])) for m in (MULTIPLIER, np.uint64(inverse)))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of a part."""
        x = np.frombuffer(data, np.uint8)
        if len(x) > len(self.power):
            self.grow(len(x))
        word = np.concatenate([[False], ~SPACES[x], [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.table[x] * self.power[: len(x)])])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts]), starts

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The set of each text: with fewer words than a shingle has, the whole sequence is one."""
        out, own, size = [], [], 0
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
            if len(data) > PART:
                out += self.sets(own)
                out.append(self.shingles(np.concatenate([self.words(p)[0] for p in cut(data)])))
                own, size = [], 0
                continue
            own.append(data)
            size += len(data)
            if size >= PART:
                out += self.sets(own)
                own, size = [], 0
        return out + self.sets(own)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if not texts:
            return []
        words, starts = self.words(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        bounds = np.append(0, np.searchsorted(starts, ends))
        return [self.shingles(words[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def shingles(self, words: np.ndarray) -> np.ndarray:
        n, least = len(words), self.least
        if n < least:
            h = np.full(min(n, 1), n, np.uint64)
            for k in range(n):
                h = h * MULTIPLIER + words[k]
            return mixed(h)
        h = words[: n - least + 1].copy()
        for k in range(1, least):
            h *= MULTIPLIER
            h += words[k : n - least + 1 + k]
        return np.unique(mixed(h))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def cut(data: bytes):
    """A long text in parts that end between words."""
    at = 0
    while at < len(data):
        end = at + PART
        while end < len(data) and not SPACES[data[end]]:
            end += 1
        yield data[at:end]
        at = end


EDGES = np.arange(BANDS * RANGES, dtype=np.uint64) << np.uint64(64 - (BANDS * RANGES).bit_length() + 1)


def band_keys(h: np.ndarray) -> list[int]:
    """Keys of the bands that hold a hash: the least hashes of their ranges."""
    first = np.searchsorted(h, EDGES)
    least = np.append(h, np.uint64(0))[first]
    held = np.append(first[1:], len(h)) > first
    least = np.where(held, least, np.uint64(0)).reshape(BANDS, RANGES)
    return [xxhash.xxh64_intdigest(least[b].tobytes(), seed=b) - (1 << 63) for b in np.flatnonzero(held.reshape(BANDS, RANGES).any(1)).tolist()]


def bitmap(h: np.ndarray, size: int | None = None) -> np.ndarray:
    """Which remainders the hashes leave; as many bits as a power of two that fits the set's size, or ``size``."""
    size = size or min(MOST_BITS, max(64, 1 << (BITS_EACH * len(h) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(h & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def lists(values: list, kind=pa.int64()) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.asarray(v) for v in values]) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64), kind))


SKETCH = "doc_id long, n long, d1 long, d2 long, bands array<long>, bits array<long>, coarse array<long>, shingle long, sets long"


def sketch(words: int = WORDS, keys=band_keys, coarse_bits: int = COARSE_BITS):
    """A row for each document, and rows (shingle, sets) of shingles that many sets of a block hold. ``keys`` makes of a set
    the numbers that stand in its ``bands``."""

    def run(batches):
        hashes, seen, held, size = Shingles(words), set(), [], 0

        def frequent():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n >= BLOCK_SETS], n[n >= BLOCK_SETS]
            none = [pa.nulls(len(found), t) for t in (*[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3)]
            return pa.RecordBatch.from_arrays([*none, pa.array(found.view(np.int64)), pa.array(n)], names)

        names = ["doc_id", "n", "d1", "d2", "bands", "bits", "coarse", "shingle", "sets"]
        for batch in slices(batches):
            ids = batch.column(0)
            n, d1, d2, bands, bits, coarse = [], [], [], [], [], []
            for h in hashes.of(batch.column(1).to_pylist()):
                n.append(len(h))
                digest = xxhash.xxh3_128_digest(h.tobytes())
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                bands.append(keys(h) if len(h) else [])
                bits.append(bitmap(h))
                coarse.append(bitmap(h, coarse_bits))
                if len(h) and digest not in seen:
                    seen.add(digest)
                    held.append(h)
                    size += len(h)
                    if size >= BLOCK_SHINGLES:
                        yield frequent()
                        held, size, seen = [], 0, set()
            rest = [pa.nulls(len(n), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists(bands), lists(bits), lists(coarse), *rest], names)
        if held:
            yield frequent()

    return run


def overlap_bound(a: str, b: str) -> Column:
    """Most elements that two sets can share: each bit that only one has stands for an element that the other lacks.
    A bitmap twice as long as the other is folded to its length; sets whose sizes differ more are not bounded here."""

    def folded(x: Column, y: Column) -> Column:
        half = F.size(y)
        return F.when(F.size(x) == half, x).when(F.size(x) == 2 * half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q)))

    def only(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)

    x, y = F.col(f"{a}bits"), F.col(f"{b}bits")
    short = F.size(x) < F.size(y)
    u, v = F.when(short, x).otherwise(folded(x, y)), F.when(short, folded(y, x)).otherwise(y)
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return F.least(n, m, n - F.coalesce(only(u, v), F.lit(0)), m - F.coalesce(only(v, u), F.lit(0)))


def linkable(shared: Column, a: str, b: str, percent: int) -> Column:
    return (100 + percent) * shared >= percent * (F.col(f"{a}n") + F.col(f"{b}n"))


def as_sets(words: int):
    """A row for each place in which a document is wanted."""

    def packed(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.binary())], ["centre", "part", "member", "node", "own"])

    def run(batches):
        hashes = Shingles(words)
        for batch in slices(batches):
            rows, size = [], 0
            nodes, texts, wanted = (c.to_pylist() for c in batch.columns)
            for node, own, places in zip(nodes, hashes.of(texts), wanted):
                own = own.tobytes()
                for x in places:
                    rows.append((x["centre"], x["part"], x["member"], node, own))
                    size += len(own)
                    if size > 4_000_000:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)

    return run


def intersecting(percent: int):
    """Members follow their centre in each task's sorted rows, so one set is held at a time."""

    def run(batches):
        key, centres = None, []
        for batch in slices(batches):
            out = []
            for centre, part, member, node, own in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(own, np.uint64)
                if (centre, part) != key:
                    key, centres = (centre, part), []
                if not member:
                    centres.append(own)
                    continue
                for x in centres:
                    shared = len(np.intersect1d(x, own, assume_unique=True))
                    if (100 + percent) * shared >= percent * (len(x) + len(own)):
                        out.append((node, centre))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


class Texts:
    """The documents, to be joined with lists of ids. A short list goes to where the texts are, and they don't move. For
    the first longer one the texts are laid out by id in a bucketed table, so from then on only the lists move. That table
    lies in the shared folder and is gone at the end of the ``with`` statement."""

    def __init__(self, docs: DataFrame, most_ids: int = MAX_WANTED, words: int = WORDS) -> None:
        self.docs, self.most, self.words, self.table = docs, most_ids, words, ""

    def __enter__(self) -> "Texts":
        return self

    def __exit__(self, *error) -> None:
        if self.table:
            self.docs.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")

    def of(self, wanted: DataFrame, places: int) -> DataFrame:
        """(node, text, places) of ``wanted`` (node, places), which holds that many places in all."""
        if places <= self.most:
            return self.docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("node"))
        spark = self.docs.sparkSession
        if not self.table:
            self.table = f"scarp_{uuid.uuid4().hex}"
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.docs.rdd.getNumPartitions())
            by_id = self.docs.where(F.col("doc_id").isNotNull()).repartition(buckets, "doc_id")
            by_id.write.bucketBy(buckets, "doc_id").option("path", f"{shared_dir(spark)}/{self.table}").saveAsTable(self.table)
        return spark.table(self.table).join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("node"))


def exact_links(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives whose sets are similar enough.

    b is the centre, and its members a are dealt into parts, so a centre of very many pairs takes many tasks. Only the
    documents of ``pairs`` are hashed again, and each set is shuffled once for each part that wants it.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("long").alias("parts"))
    dealt = pairs.join(many, "b").select("a", F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    members = dealt.select(F.col("a").alias("node"), F.struct("centre", "part", F.lit(1).cast("long").alias("member")).alias("x"))
    heads = dealt.select("centre", "part").distinct().select(F.col("centre").alias("node"), F.struct("centre", "part", F.lit(0).cast("long").alias("member")).alias("x"))
    wanted = saved(narrow(members.union(heads).groupBy("node").agg(F.collect_list("x").alias("places"))))
    places = wanted.agg(F.sum(F.size("places"))).first()[0]
    if not places:
        return pairs.select("a", "b")
    sets = texts.of(wanted, places).select("node", "text", "places").mapInArrow(as_sets(texts.words), "centre long, part long, member long, node long, own binary")
    sets = sets.repartition("centre", "part").sortWithinPartitions("centre", "part", "member")
    return saved(sets.mapInArrow(intersecting(percent), "a long, b long"))  # as wide as the sets are


def with_bits(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for enough overlap."""
    x, y = (facts.select(F.col("node").alias(k), F.col("n").alias(f"{k}n"), F.col("bits").alias(f"{k}bits")) for k in "ab")
    return saved(narrow(pairs.join(x, "a").join(y, "b").where(linkable(overlap_bound("a", "b"), "a", "b", percent)).select("a", "b")))


def star_links(classes: DataFrame, texts: Texts, percent: int, rounds: int, links: DataFrame | None = None, first: tuple[str, str] = ("rank", "k")) -> DataFrame:
    """Links (a, b) found in the buckets of the bands, besides ``links`` that are known. Of the centres that a node meets it
    takes the best by ``first``: the hub score, and how often they meet.

    A node's hub score is the summed size of its buckets: of near copies of one text, the text itself shares more buckets
    with the others than any two of these share. In each round a bucket's centre is the best hub of its largest component
    that was no centre before, so first the text, then those that it linked and that others may link with.
    """
    held = classes.select("node", F.explode("bands").alias("band"))
    often = held.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select(F.col("band").alias("_band"), "k")
    held = saved(held.join(often, F.col("band") == F.col("_band")).select("node", "band", "k"))
    hubs = saved(narrow(held.groupBy("node").agg(F.sum("k").alias("hub"))))
    held = saved(held.join(hubs, "node").select("node", "band", "hub"))
    facts = classes.select("node", "n", "bits")
    tried = None
    for _ in range(rounds):
        own = held.withColumn("comp", F.col("node")).withColumn("size", F.lit(1).cast("long"))
        if links is not None:
            named = components(links)
            sizes = named.groupBy("label").agg(F.count("*").alias("size"))
            named = named.join(sizes, "label")
            own = held.join(named, "node", "left").select("band", "node", "hub", F.coalesce("label", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
        if tried is not None:
            own = own.join(small(tried, tried.count()), F.col("node") == F.col("_tried"), "left")
        fresh = F.col("_tried").isNull() if tried is not None else F.lit(True)
        order = F.struct("size", "hub", F.xxhash64("node").alias("h"), "node", "comp")
        centre = own.groupBy("band").agg(F.max(F.when(fresh, order)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi and c is not null")
        centre = centre.select(F.col("band").alias("_band"), F.col("c.node").alias("centre"), F.col("c.comp").alias("its"), F.col("c.hub").alias("rank"))
        met = own.join(centre, F.col("band") == F.col("_band")).where(F.col("comp") != F.col("its")).groupBy("node", "centre").agg(F.count("*").alias("k"), F.max("rank").alias("rank"))
        best = met.groupBy("node").agg(F.max(F.struct(*first, "centre")).alias("c")).select(F.col("node").alias("a"), F.col("c.centre").alias("b"))
        best = saved(narrow(best))
        used = best.select(F.col("b").alias("_tried")).distinct()
        tried = saved(narrow(used if tried is None else used.union(tried).distinct()))
        found = exact_links(with_bits(best, facts, percent), texts, percent)
        links = found if links is None else links.union(found)
    return links


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int, words: int = WORDS, common: int = 1, hot: int = 1 << 62) -> DataFrame:
    """(doc_id, prefix, cold): the first shingles of each set, rare ones first, so many that two sets with enough overlap have
    ``common`` of them in common; and how many of these are not known to be in more than ``hot`` sets, which come first."""
    known, counts = frequent

    def run(batches):
        hashes = Shingles(words)
        for batch in slices(batches):
            out, cold = [], []
            for h in hashes.of(batch.column(1).to_pylist()):
                most = len(h) - -(-percent * len(h) // 100) + common
                few = 0
                if len(h) and len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    n = np.where(known[at] == h, counts[at], 0)
                    if n.any():
                        order = np.argsort(n, kind="stable")
                        h = h[order]
                        few = int((n[order[:most]] > hot).sum())
                out.append(h[:most].view(np.int64))
                cold.append(len(out[-1]) - few)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(out), pa.array(cold, pa.int32())], ["doc_id", "prefix", "cold"])

    return docs.mapInArrow(run, "doc_id long, prefix array<long>, cold int")


def tile_pairs(few: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in each (shingle, tile) that sizes, places and coarse bitmaps don't rule out.

    The list of a very frequent shingle is cut into chunks on either side, and each pair of chunks is a key of its own, so
    no task compares more than TILE_ROWS members with as many.
    """
    key = ["shingle", "tile"]
    x_size, y_size = (df.groupBy(*key).agg(F.count("*").alias("k")).where(F.col("k") > TILE_ROWS).select(*key, F.ceil(F.col("k") / TILE_ROWS).cast("int").alias(c)) for df, c in ((few, "xs"), (listed, "ys")))
    hot = saved(narrow(x_size.join(y_size, key, "full").select(F.col("shingle").alias("_s"), F.col("tile").alias("_t"), F.coalesce("xs", F.lit(1)).alias("xs"), F.coalesce("ys", F.lit(1)).alias("ys"))))
    side = small(hot, hot.count())

    def chunked(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        found = df.join(side, (F.col("shingle") == F.col("_s")) & (F.col("tile") == F.col("_t")), "left")
        return found.withColumn(mine, F.pmod(F.hash("node"), F.coalesce(own, F.lit(1)))).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    carried = ("node", "n", "comp", "place", "main")
    key = [*key, "i", "j"]
    x = chunked(few, "xs", "ys", "i", "j").select(*key, *[F.col(c).alias(f"a{c}") for c in carried], F.col("coarse").alias("abits"))
    y = chunked(listed, "ys", "xs", "j", "i").select(*key, *[F.col(c).alias(f"b{c}") for c in carried], F.col("coarse").alias("bbits"))
    placed = F.least(F.col("an") - F.col("aplace"), F.col("bn") - F.col("bplace"))
    once = F.col("bmain") | (F.col("anode") < F.col("bnode"))
    fits = once & (F.col("acomp") != F.col("bcomp")) & linkable(placed, "a", "b", percent) & linkable(overlap_bound("a", "b"), "a", "b", percent)
    return x.join(y, key).where(fits).select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"))


def with_components(classes: DataFrame, named: DataFrame) -> DataFrame:
    return saved(classes.select("node", "n", "bits", "coarse").join(named, "node", "left").select("node", "n", "bits", "coarse", F.coalesce("label", "node").alias("comp")))


def live_links(corpus: "Corpus", named: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """All links (a, b) between different components of ``named``."""
    facts = with_components(corpus.classes, named)
    first = prefixes(texts.docs, corpus.frequent, percent, texts.words)
    first = saved(first.join(facts.select("node", "n", "comp"), F.col("doc_id") == F.col("node")).select("node", "n", "comp", "prefix"))
    return exact_links(with_bits(live_pairs(first, facts, percent), facts, percent), texts, percent)


def live_pairs(first: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of their prefixes and that no bound rules out. ``first`` has
    node, n, comp, prefix."""
    tokens = first.select("node", "comp", F.explode("prefix").alias("shingle"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("comp", "node") for f in (F.min, F.max)]
    live = saved(tokens.groupBy("shingle").agg(F.count("*").alias("k"), *ends).where("min_comp <> max_comp").select(F.col("shingle").alias("_shingle"), "k", F.col("min_node").alias("a"), F.col("max_node").alias("b")))
    two = live.where("k = 2").select("a", "b").distinct()  # a list of two is its only pair
    live = live.where("k > 2").select("_shingle")
    listed = first.select("node", "n", "comp", F.posexplode("prefix").alias("place", "shingle")).join(small(live, live.count()), F.col("shingle") == F.col("_shingle"))
    listed = saved(listed.select("shingle", "node", "n", "comp", "place"))
    most = listed.groupBy("shingle", "comp").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("comp", "k").alias("main"))
    listed = listed.withColumn("tile", F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int"))
    listed = listed.join(facts.select("node", "coarse"), "node")
    listed = listed.join(most, "shingle").withColumn("main", F.col("comp") == F.col("main"))
    few = listed.where("not main").withColumn("tile", F.explode(F.array(*[F.col("tile") + d for d in (-1, 0, 1)])))
    return two.union(tile_pairs(few, listed, percent)).distinct()


class Corpus:
    """The documents of a table (doc_id, text), sketched once: their rows, the classes of equal sets, and the shingles that
    are known to be frequent."""

    def __init__(self, table: DataFrame, words: int = WORDS, keys=band_keys, coarse_bits: int = COARSE_BITS) -> None:
        self.docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        sketches = saved(self.docs.mapInArrow(sketch(words, keys, coarse_bits), SKETCH))
        self.rows = sketches.where(F.col("n").isNotNull())
        sums = sketches.where(F.col("n").isNull()).groupBy("shingle").agg(F.sum("sets").alias("k")).orderBy(F.desc("k"), "shingle").limit(MAX_FREQUENT).toPandas()
        known = sums["shingle"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(known)
        self.frequent = known[order], sums["k"].to_numpy(np.int64)[order]
        some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        # Equal sets have equal sketches.
        classes = self.rows.where(some).groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), *[F.any_value(c).alias(c) for c in ("n", "bands", "bits", "coarse")])
        self.classes = saved(classes)

    def joined(self, links: DataFrame, texts: Texts, percent: int, complete=live_links) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, by ``links`` and all others between their components,
        which ``complete`` finds."""
        named = components(links)
        more = complete(self, named, texts, percent)
        final = components(named.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
        of_class = self.classes.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "node").join(final, "node", "left").select("_d1", "_d2", F.coalesce("label", "node").alias("component"))
        of_class = saved(of_class.groupBy("_d1", "_d2").agg(F.min("component").alias("component")))
        out = self.rows.select("doc_id", "n", "d1", "d2").join(of_class, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & F.col("doc_id").isNotNull(), "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def linked(table: DataFrame, percent: int = 75, rounds: int = 2, most_ids: int = MAX_WANTED) -> DataFrame:
    """One row per row of ``table`` (doc_id, text): doc_id, n_shingles, component_id. ``most_ids`` is how many places of
    documents are sent to all tasks at once; it changes the plan only."""
    corpus = Corpus(table)
    with Texts(corpus.docs, most_ids) as texts:
        return corpus.joined(star_links(corpus.classes, texts, percent, rounds), texts, percent)


def representatives(table: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``table`` whose id stands for its component, the smallest one: all columns, and of rows that share that
    id all of them. The columns may have any names: they stand in one struct meanwhile."""
    found = linked(table.select("doc_id", "text"), percent)
    gone = saved(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct())
    rows = table.select(F.struct(*table.columns).alias("row"))
    return rows.join(small(gone, gone.count()), F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")
