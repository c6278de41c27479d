"""SentencePiece encoding and decoding, word by word over shared prefixes.

A text, its spaces marked, falls into marked words that no piece crosses. The distinct words of a block of texts are
sorted, which is a depth-first walk of their trie: between two neighbours only the letters after their common prefix are
new, and the forward states of the prefix are reused.

Both walks are Viterbi's algorithm; the scores differ. Unigram models: a path scores the sum of its pieces, and a state is
the best score of a prefix with its last piece. BPE models give pieces ranks, not scores to be summed, and the best sum is
not their segmentation; there each step from one piece to the next scores 0 if the two can stand side by side without
being merged and minus infinity if not, which is decided by the order of the merges at their border and remembered. One
path to each prefix scores 0, so a state is its last piece. Words that begin with several marks are merged by definition,
with a heap, as the pieces of runs of marks have equal ranks. Ids are those of the model.

Characters that no piece holds become their bytes. Decoding joins the pieces' bytes, and each text is decoded again and
compared. The model file's place is a parameter; every task reads the vocabulary from the job, not from a file. A task holds
words and blocks of bounded size; a longer text is encoded in parts that end between words.

Nulls, ties, repeats: null text counts as empty and has no pieces; equal scores go to the longer piece; repeated rows get
equal results; an empty table gives an empty result. A "▁" in a text is a space, as the model has it. Other columns
of the input are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Characters of the texts that are encoded together.
BLOCK_CHARS = 1_000_000
#: Distinct words, their characters, and pairs of pieces that are remembered.
MEMORY_WORDS, MEMORY_CHARS, MEMORY_PAIRS = 500_000, 8_000_000, 300_000
UNKNOWN = -1


class Vocabulary:
    """Pieces with their scores, and what the walk needs of them; built once and sent with the job."""

    def __init__(self, model_file: str, kind: str = "bpe") -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.kind = kind
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.text = [b"" if model.is_control(i) else model.id_to_piece(i).encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses words")
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.usable = dict(self.ids)
        if kind == "bpe":
            for piece, i in self.ids.items():
                halves = self.derivation(piece)
                if halves is None:
                    del self.usable[piece]  # merging its own letters leads elsewhere: it is in no encoding
                    continue
                self.left[i], self.right[i] = self.side(piece, halves, 0), self.side(piece, halves, 1)
        by_end: dict[str, set[int]] = {}
        for piece in self.usable:
            if len(piece) > 2:
                by_end.setdefault(piece[-3:], set()).add(len(piece))
        #: Lengths of the pieces that end with three letters, longest first.
        self.lengths = {end: (*sorted(n, reverse=True), 2, 1) for end, n in by_end.items()}

    def merged(self, word: str, halves: dict | None = None) -> list[str]:
        """The model's segmentation by its definition: the best pair of neighbours is merged, again and again."""
        parts: list[str] = list(word)
        after, before = [*range(1, len(parts) + 1)], [*range(-1, len(parts) - 1)]
        due: list[tuple[float, int, str, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (v := self.score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(due, (-v, a, parts[a], parts[b]))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while due:
            _, a, x, y = heapq.heappop(due)
            b = after[a]
            if parts[a] != x or b >= len(parts) or parts[b] != y:
                continue  # one of the two was merged since
            if halves is not None:
                halves[x + y] = (x, y)
            parts[a], parts[b], after[a] = x + y, "", after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a], a), offer(a, after[a])
        return [p for p in parts if p]

    def derivation(self, piece: str) -> dict | None:
        halves: dict = {}
        return halves if len(self.merged(piece, halves)) == 1 else None

    def side(self, piece: str, halves: dict, which: int) -> list[tuple[str, float]]:
        """What stands at the piece's left (0) or right (1) end as it grows, with the score of the merge that made it."""
        chain = []
        while piece in halves:
            chain.append((piece, self.score[piece]))
            piece = halves[piece][which]
        return [(piece, 0.0), *reversed(chain)]


class Neighbours(dict):
    """Whether piece a may stand before piece b, by a * 2**20 + b."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.v = vocabulary

    def __missing__(self, key: int) -> bool:
        if len(self) > MEMORY_PAIRS:
            self.clear()
        a, b = key >> 20, key & 0xFFFFF
        value = self[key] = a < 0 or self.apart(self.v.right[a], self.v.left[b])
        return value

    def apart(self, x: list, y: list) -> bool:
        """Both ends grow by their merges, best score first; they stay apart if the pair at the border is never due
        before the next of these. Among equal scores the leftmost pair is merged."""
        score, i, j = self.v.score, 0, 0
        low = float("-inf")
        while True:
            left = x[i + 1][1] if i + 1 < len(x) else low
            right = y[j + 1][1] if j + 1 < len(y) else low
            border = score.get(x[i][0] + y[j][0])
            if border is not None and border > left and border >= right:
                return False
            if left == low and right == low:
                return True
            if left >= right:
                i += 1
            else:
                j += 1


class Encoder:
    """Encodes words; remembers a bounded number of them. Ids of word k are flat[start[k]:start[k] + size[k]]."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.near = Neighbours(vocabulary)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat, self.start, self.size = array("i"), array("q"), array("q")

    def add(self, words: set[str]) -> None:
        """Encodes words not known yet, in order of the trie."""
        walk = self.walk_bpe if self.v.kind == "bpe" else self.walk_unigram
        for word, ids in walk(sorted(words)):
            self.known[word] = len(self.start)
            self.chars += len(word)
            self.start.append(len(self.flat))
            self.size.append(len(ids))
            self.flat.extend(ids)

    def fallback(self, letter: str) -> list[int]:
        if not self.v.bytes:
            return [self.v.unknown]
        return [self.v.bytes[b] for b in letter.encode("utf-8", "replace")]

    def traced(self, word: str, last: list[int], begin: list[int]) -> list[int]:
        out, i = [], len(word)
        while i:
            if last[i] == UNKNOWN:
                out += reversed(self.fallback(word[i - 1]))
            else:
                out.append(last[i])
            i = begin[i]
        out.reverse()
        return out

    def walk_bpe(self, words: list[str]):
        get, near, lengths, short = self.v.usable.get, self.near, self.v.lengths.get, (2, 1)
        last, begin = [UNKNOWN], [0]
        before = ""
        for word in words:
            if word.startswith(MARK + MARK):
                yield word, [i for p in self.v.merged(word) for i in ([self.v.ids[p]] if p in self.v.ids else self.fallback(p))]
                continue
            size, k = len(word), 0
            most = min(size, len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], begin[k + 1 :]
            for i in range(k + 1, size + 1):
                for n in lengths(word[i - 3 : i], short) if i > 2 else short:
                    j = i - n
                    if j < 0:
                        continue
                    t = get(word[j:i])
                    if t is not None and (j == 0 or near[(last[j] << 20) + t]):
                        last.append(t)
                        begin.append(j)
                        break
                else:
                    last.append(UNKNOWN)
                    begin.append(i - 1)
            before = word
            yield word, self.traced(word, last, begin)

    def walk_unigram(self, words: list[str]):
        ids, score, longest = self.v.ids, self.v.score, self.v.longest
        lost = min(score.values()) - 10.0
        last, begin, best = [UNKNOWN], [0], [0.0]
        before = ""
        for word in words:
            size, k = len(word), 0
            most = min(size, len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], begin[k + 1 :], best[k + 1 :]
            for i in range(k + 1, size + 1):
                top, piece, place = best[i - 1] + lost, UNKNOWN, i - 1
                for j in range(i - 1, max(0, i - longest) - 1, -1):
                    p = word[j:i]
                    if p in score and best[j] + score[p] >= top:
                        top, piece, place = best[j] + score[p], ids[p], j
                best.append(top), last.append(piece), begin.append(place)
            before = word
            yield word, self.traced(word, last, begin)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's end."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        if len(marked) == 1 and len(marked[0]) > 2 * BLOCK_CHARS:
            found = [self.encode_marked([t])[0] for t in parts_of(marked[0])]
            return np.concatenate(found), np.array([sum(map(len, found))])
        return self.encode_marked(marked)

    def encode_marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        segments = [SEGMENT.findall(t) for t in texts]
        new = {w for s in segments for w in s} - self.known.keys()
        if len(new) + len(self.known) > MEMORY_WORDS or self.chars > MEMORY_CHARS:
            self.forget()
            new = {w for s in segments for w in s}
        self.add(new)
        words = np.fromiter((self.known[w] for s in segments for w in s), np.int64)
        start, size, flat = np.array(self.start), np.array(self.size), np.array(self.flat)  # copies: the arrays grow later
        sizes = size[words]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(start[words] - (ends - sizes), sizes) + np.arange(total)] if total else np.zeros(0, np.int32)
        counts = np.cumsum([len(s) for s in segments])
        return ids.astype(np.int32), np.append(0, ends)[counts]


def decoded(ids: list[int], text: list[bytes]) -> str:
    """The text of piece ids."""
    found = b"".join([text[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
    return found[1:] if found.startswith(" ") else found


def parts_of(text: str):
    """A marked text in parts of about BLOCK_CHARS, cut before a mark that follows another character."""
    at = 0
    while at < len(text):
        end = at + BLOCK_CHARS
        while 0 < end < len(text) and not (text[end] == MARK != text[end - 1]):
            end = text.find(MARK, end + 1)
        end = end if 0 < end < len(text) else len(text)
        yield text[at:end]
        at = end


def blocks(texts: list[str]):
    """Ranges of texts of about BLOCK_CHARS."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_file: str, kind: str = "bpe") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids, and decoded_ok, whether the ids decode to the
    text again."""
    vocabulary = Vocabulary(model_file, kind)

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                ids, ends = encoder.encode(texts[a:b])
                starts = np.append(0, ends[:-1])
                fine = [decoded(ids[s:e].tolist(), vocabulary.text) == t.replace(MARK, " ") for s, e, t in zip(starts, ends, texts[a:b])]
                column = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ends - starts), column, pa.array(fine)], ["doc_id", "n_tokens", "ids", "decoded_ok"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids array<int>, decoded_ok boolean")


def decode(encoded: DataFrame, model_file: str, kind: str = "bpe") -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null."""
    text = Vocabulary(model_file, kind).text

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decoded(x, text) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
