"""Language identification as a mixture of languages, fitted to each document by expectation-maximisation.

Each language has a distribution of hashed letter trigrams, learned from a bounded sample of rows with a known language.
A document's trigrams are draws from a mixture of them. Its language set grows from the likeliest single language by the
one with the steepest likelihood, as long as the likelihood gained pays the penalty for a further language; the
proportions come from EM. The language with the largest proportion is predicted, and that proportion is the score.

Nulls, ties, repeats: null text, or text without a letter, is ``und`` with score 0; rows with a null language or a null
id are not learned from; with nothing to learn from, all is ``und``; ties between languages go to the first by name;
repeated rows get equal results; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, small

GRAMS = 1 << 15
#: Rows learned from in each language, about: a share of its rows, chosen by the hash of the id.
ROWS_PER_LANGUAGE = 3000


class Letters:
    """Trigram ids of texts, by arrays of code points. Built in each task."""

    def __init__(self) -> None:
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(65536)), bool, 65536)

    def grams(self, text: str) -> np.ndarray | None:
        """Ids of the trigrams around each letter of the lower-cased text; None if it has no letter."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.is_letter[np.minimum(points, 65535)]
        wide = np.flatnonzero(points > 65535)
        if wide.size:
            letter[wide] = [chr(c).isalpha() for c in points[wide]]
        if not letter.any():
            return None
        x = np.where(letter, points, 32).astype(np.uint32)
        h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        return (h >> np.uint32(17))[letter[1:-1]].astype(np.int64)


def learn(docs: DataFrame, rows_per_language: int) -> tuple[list[str], np.ndarray]:
    """Names, and probabilities by language and trigram id. Tasks send counts, never texts: languages x GRAMS at most."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    rows = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = small(rows.select(F.col("lang").alias("_lang"), (F.lit(float(rows_per_language)) / F.col("n")).alias("_share")), rows.count())
    sample = known.join(share, F.col("lang") == F.col("_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("_share") * 1_000_000).select("lang", "text")

    def count(batches):
        letters, sums = Letters(), {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (g := letters.grams(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + np.bincount(g, minlength=GRAMS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.zeros((len(names), GRAMS))
    for k, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[k, own["gram"].to_numpy()] = own["n"].to_numpy()
    return names, (table + 0.05) / (table + 0.05).sum(axis=1, keepdims=True)


def mixture(ids: np.ndarray, n: np.ndarray, p: np.ndarray, penalty: float, rounds: int = 12) -> tuple[list[int], np.ndarray]:
    """Language set and proportions of a document with ``n`` of each trigram in ``ids``, by penalised likelihood."""
    like = p[:, ids]
    total = n.sum()
    single = np.log(like) @ n
    chosen, share, best = [int(single.argmax())], np.ones(1), single.max()
    mixed = like[chosen[0]]
    while len(chosen) < len(p):
        gain = (like / mixed) @ n
        gain[chosen] = -np.inf
        new = int(gain.argmax())
        if gain[new] <= total:  # the likelihood falls along every other language
            break
        trial, w = [*chosen, new], np.append(share * 0.8, 0.2)
        part = like[trial]
        for _ in range(rounds):
            w = w * ((part / (w @ part)) @ n) / total
        value = np.log(w @ part) @ n
        if value - best < penalty * np.log(total + 1):
            break
        chosen, share, best, mixed = trial, w, value, w @ part
    return chosen, share


def identify(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, penalty: float = 4.0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, and ``mixture``, the
    languages found with their proportions."""
    names, p = learn(docs, rows_per_language)

    def predict(batches):
        letters = Letters()
        for batch in slices(batches):
            pred, score, parts = [], [], []
            for text in batch.column(1).to_pylist():
                g = letters.grams(text) if text and names else None
                if g is None:
                    pred.append("und"), score.append(0.0), parts.append("")
                    continue
                n = np.bincount(g, minlength=GRAMS)
                ids = np.flatnonzero(n)
                chosen, share = mixture(ids, n[ids].astype(float), p, penalty)
                order = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
                pred.append(names[chosen[order[0]]]), score.append(float(min(1.0, share[order[0]])))
                parts.append(",".join(f"{names[chosen[k]]}:{share[k]:.3f}" for k in order))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred), pa.array(score, pa.float64()), pa.array(parts)], ["doc_id", "held_out", "lang_pred", "score", "mixture"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return rows.mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, mixture string")
