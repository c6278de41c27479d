"""Toxicity: a linear-chain conditional random field over words tags toxic spans; its marginals make the document score.

Evidence. In a bounded sample of labelled rows, words and word beginnings are counted by class. A word's evidence is the
log-odds of the most specific of these (the word itself, else its longest counted beginning) that is well attested. Words
with little evidence are plain, the others fall into a few classes. Labelled tokens: a word with evidence in a toxic
document is T, all else is O.

Model. A two-state chain with a weight for each class in state T and one for T after T, fitted by Newton's method to the
likelihood of the tags. Runs of plain words are powers of one 2 x 2 matrix, so forward and backward passes are exact at
every word with evidence and cost nothing elsewhere. A logistic model on the marginals (their sum, largest, and sum a word)
is fitted on the same sample and gives the score; offending offsets are the words with a marginal of at least one half.

Nulls, ties, repeats: null text counts as empty and scores as a text without evidence; labels with a null id or a null
``toxic`` are not used; of several labels of one id the largest holds; without labelled rows of both classes every score is
0; repeated rows get equal results; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved, slices, small

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows learned from, by class (0, 1): those with the smallest hashes of their ids.
SAMPLE_ROWS = (5000, 2500)
#: Characters of the word beginnings that are counted.
HEAD, LONGEST = 4, 8
#: Lower ends of the classes of evidence, in log-odds.
CLASSES = (1.5, 2.5, 3.5, 5.0)


def lowered(text: str) -> str:
    """The text in lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(v if len(v := c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    """From the word itself to its shortest beginning."""
    return [f"={word}", *[word[:k] for k in range(min(len(word), LONGEST), HEAD - 1, -1)]]


def labelled(docs: DataFrame, labels: DataFrame, rows: tuple[int, int]) -> DataFrame:
    """(toxic, text) of the sample. The chosen ids are bounded by ``rows``, and sent to where the texts are."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == k).orderBy(*order).limit(rows[k]) for k in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_id"), "toxic")
    return docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("toxic", "text")


def evidence(sample: DataFrame, sizes: tuple[int, int]) -> dict[str, float]:
    """Log-odds by feature. Only beginnings that are well attested in toxic texts, and what refines them, are kept: all of
    them, as they are features of the bounded sample."""

    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in slices(batches):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(WORD.findall(lowered(text))) for f in features(w)}:
                    sums.setdefault(f, [0, 0])[y] += 1
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()]), pa.array([v[1] for v in sums.values()])], ["f", "n0", "n1"])

    least = max(3, math.ceil(0.01 * sizes[1]))
    odds = F.log(((F.col("n1") + 0.5) / (sizes[1] + 1)) / ((F.col("n0") + 0.5) / (sizes[0] + 1)))
    counted = saved(
        sample.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= 3).withColumn("odds", odds)
    )
    head = F.substring(F.regexp_replace("f", "^=", ""), 1, HEAD)
    heads = saved(counted.where((F.col("n1") >= least) & (F.col("odds") >= 2.0)).select(head.alias("head")).distinct())
    near = counted.withColumn("head", head).join(small(heads, heads.count()), "head", "left_semi")
    found = {r["f"]: (r["odds"], r["n1"], r["n0"]) for r in near.collect()}
    strong = {f for f, (v, n1, _) in found.items() if n1 >= least and v >= 2.0}

    def attested(f: str) -> bool:
        """Strong by itself, or it refines a strong feature, downwards or with many sightings of its own."""
        return f in strong or any(g in strong for g in features(f.lstrip("="))[1:]) and (found[f][0] < 1 or found[f][1] + found[f][2] >= least)

    return {f: v for f, (v, _, _) in found.items() if attested(f)}


class Tagger:
    """Words to classes of evidence."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds = odds
        self.heads = {f.lstrip("=")[:HEAD] for f in odds}
        self.memo: dict[str, int] = {}

    def class_of(self, word: str) -> int:
        k = self.memo.get(word)
        if k is None:
            v = next((self.odds[f] for f in features(word) if f in self.odds), 0.0)
            k = sum(v >= c for c in CLASSES)
            if len(self.memo) < 200_000:
                self.memo[word] = k
        return k

    def active(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """Number of words, and (place, class) of those that aren't plain."""
        words, heads = WORD.findall(lowered(text)), self.heads
        return len(words), [(i, k) for i, w in enumerate(words) if w[:HEAD] in heads and (k := self.class_of(w))]


class Chain:
    """Exact inference: w[0] is the weight of a plain word in state T, w[k] of class k, and ``a`` of T after T."""

    def __init__(self, w, a: float) -> None:
        self.w, self.a = list(map(float, w)), float(a)
        t = math.exp(self.w[0])
        m = np.array([[1.0, t], [1.0, t * math.exp(self.a)]])
        half, det = (m[0, 0] + m[1, 1]) / 2, m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]
        root = math.sqrt(max(half * half - det, 1e-300))
        self.big, low = half + root, half - root
        self.ratio = low / self.big
        self.first = (m - low * np.eye(2)) / (self.big - low)
        self.rest = np.eye(2) - self.first

    def power(self, n: int) -> tuple[float, float, float, float]:
        """Matrix of n plain words, divided by the n-th power of its largest eigenvalue."""
        r = self.ratio**n
        x = self.first + r * self.rest
        return x[0, 0], x[0, 1], x[1, 0], x[1, 1]

    def marginals(self, n: int, active: list[tuple[int, int]]) -> list[float]:
        """P(T) at each active word of a text of n words."""
        e = math.exp(self.a)
        powers = []
        last = -1
        for i, _ in active:
            powers.append(self.power(i - last - 1) if i - last > 1 else None)
            last = i
        tail = self.power(n - 1 - last)
        o, t, forward = 1.0, 0.0, []
        for (i, k), p in zip(active, powers):
            if p:
                o, t = o * p[0] + t * p[2], o * p[1] + t * p[3]
            u = math.exp(self.w[k])
            o, t = o + t, (o + t * e) * u
            s = o + t
            o, t = o / s, t / s
            forward.append((o, t))
        bo, bt = tail[0] + tail[1], tail[2] + tail[3]
        out = [0.0] * len(active)
        for j in range(len(active) - 1, -1, -1):
            fo, ft = forward[j]
            z = fo * bo + ft * bt
            out[j] = ft * bt / z if z > 0 else 0.0
            u = math.exp(self.w[active[j][1]])
            bo, bt = bo + u * bt, bo + u * e * bt
            if powers[j]:
                p = powers[j]
                bo, bt = p[0] * bo + p[1] * bt, p[2] * bo + p[3] * bt
            s = bo + bt
            bo, bt = bo / s, bt / s
        return out


def fit_chain(rows: list[tuple[int, int, list]]) -> Chain:
    """Newton's method on the tags' likelihood; derivatives by differences, all texts at once.

    A text is a list of runs: before each active word a power of the plain matrix, then its own matrix. Texts are in order
    of their active words, so the j-th words of all texts that have one are the first rows."""
    k = len(CLASSES)
    rows = sorted(rows, key=lambda r: -len(r[2]))
    count = np.array([len(r[2]) for r in rows])
    first = np.cumsum(count) - count
    gaps, kinds = np.zeros(count.sum(), int), np.zeros(count.sum(), int)
    tails = np.zeros(len(rows), int)
    gold = np.zeros(k + 2)
    for d, (y, n, active) in enumerate(rows):
        last = -1
        for j, (i, c) in enumerate(active):
            gaps[first[d] + j], kinds[first[d] + j] = i - last - 1, c
            if y:
                gold[c] += 1
                gold[k + 1] += j > 0 and i == last + 1
            last = i
        tails[d] = n - 1 - last
    plain = np.array([n - len(a) for _, n, a in rows])
    longer = np.searchsorted(-count, -np.arange(count.max(initial=0)), side="left")  # texts with more than j active words

    def value(x: np.ndarray) -> float:
        chain = Chain(x[: k + 1], x[k + 1])
        log_big, e = math.log(chain.big), math.exp(x[k + 1])

        def run(o, t, n):
            r = chain.ratio ** n.astype(float)
            p = [chain.first[i, j] + r * chain.rest[i, j] for i in (0, 1) for j in (0, 1)]
            return o * p[0] + t * p[2], o * p[1] + t * p[3]

        o, t, logs = np.ones(len(rows)), np.zeros(len(rows)), plain * log_big
        weights = np.exp(np.append(x[: k + 1], 0.0))
        for j, m in enumerate(longer):
            on, at = slice(0, m), first[:m] + j
            a, b = run(o[on], t[on], gaps[at])
            a, b = a + b, (a + b * e) * weights[kinds[at]]
            s = a + b
            o[on], t[on] = a / s, b / s
            logs[on] += np.log(s)
        a, b = run(o, t, tails)
        return float(x @ gold - (logs + np.log(a + b)).sum() - 0.5 * ((x - start) ** 2).sum())

    start = np.array([-8.0, *[0.0] * k, 0.5])
    x, h = start.copy(), 1e-3
    eye = np.eye(len(x)) * h
    for _ in range(12):
        f0 = value(x)
        up, down = [value(x + d) for d in eye], [value(x - d) for d in eye]
        g = np.array([(u - v) / (2 * h) for u, v in zip(up, down)])
        hess = np.diag([(u - 2 * f0 + v) / h**2 for u, v in zip(up, down)])
        for i in range(len(x)):
            for j in range(i):
                hess[i, j] = hess[j, i] = (value(x + eye[i] + eye[j]) - up[i] - up[j] + f0) / h**2
        step = np.linalg.solve(hess - 1e-3 * np.eye(len(x)), -g)
        scale = min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        while scale > 1e-4 and value(x + scale * step) < f0:
            scale /= 2
        x = x + scale * step
        if np.abs(scale * step).max() < 1e-3:
            break
    return Chain(x[: k + 1], x[k + 1])


def summary(n: int, marginals: list[float]) -> tuple[float, float, float, float]:
    total = sum(marginals)
    return 1.0, math.log1p(total), max(marginals, default=0.0), math.log1p(100 * total / max(n, 1))


def fit_score(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method; more evidence never lowers the score."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - 0.1 * b
        b_new = b + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b)), g)
        if np.abs(b_new - b).max() < 1e-6:
            break
        b = b_new
    return np.append(b[:1], np.maximum(b[1:], 0.0))


class Model:
    def __init__(self, odds: dict[str, float], chain: Chain, weights: list[float]) -> None:
        self.odds, self.chain, self.weights = odds, chain, weights

    def score(self, n: int, marginals: list[float]) -> float:
        z = sum(a * b for a, b in zip(summary(n, marginals), self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = SAMPLE_ROWS) -> Model | None:
    """The model, or None if there are no labelled rows of either class. The driver gets features and, of each sampled
    text, the places of its words with evidence; never texts."""
    sample = saved(labelled(docs, labels, rows).repartition(8))
    sizes = Counter({r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()})
    if not (sizes[0] and sizes[1]):
        return None
    odds = evidence(sample, (sizes[0], sizes[1]))

    def encode(batches):
        tagger = Tagger(odds)
        for batch in slices(batches):
            found = [tagger.active(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([[x for pair in a for x in pair] for _, a in found], pa.list_(pa.int64()))], ["toxic", "n", "active"]
            )

    rows_ = [(r["toxic"], r["n"], list(zip(r["active"][::2], r["active"][1::2]))) for r in sample.mapInArrow(encode, "toxic int, n long, active array<long>").collect()]
    rows_.sort()
    chain = fit_chain(rows_)
    x = np.array([summary(n, chain.marginals(n, a) if a else []) for _, n, a in rows_])
    y = np.array([r[0] for r in rows_], float)
    return Model(odds, chain, fit_score(x, y, np.ones(len(y))).tolist())


def score(docs: DataFrame, labels: DataFrame, sample_rows: tuple[int, int] = SAMPLE_ROWS, threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, and ``offsets``, the offending
    words as start:end in code points of the text."""
    model = learn(docs, labels, sample_rows)

    def predict(batches):
        tagger = Tagger(model.odds if model else {})
        for batch in slices(batches):
            scores, offsets = [], []
            for text in batch.column(1).to_pylist():
                n, active = tagger.active(text or "")
                marginals = model.chain.marginals(n, active) if active else []
                scores.append(model.score(n, marginals) if model else 0.0)
                bad = {i for (i, _), p in zip(active, marginals) if p >= 0.5}
                offsets.append(",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(WORD.finditer(lowered(text))) if i in bad) if bad else "")
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(offsets, pa.string())], ["doc_id", "held_out", "score", "predicted", "offsets"]
            )

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return rows.mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int, offsets string")
