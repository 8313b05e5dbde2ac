"""Benchmark decontamination: a BM25 inverted index of the test items, queried with every training passage.

The index holds, per term, the items that have it with their BM25 weight as a share of the score that the item's own
text would get, in blocks with the block's largest weight.  Every passage (a window of words, half overlapping) of
every document is a query.  Block-max WAND retrieves all items that reach the threshold and skips blocks whose
largest weights can't.  Before that, the few postings of the rarer terms are summed for a whole batch of passages: a
passage in which no item could reach the threshold, even with all of its common terms, needs no query.  A
retrieved item is confirmed on word n-grams: both its question and its answer must be found around the passage.

An item longer than a passage is also indexed in pieces no longer than the stride, half overlapping, so that a passage
holds any of them whole; each piece has the score of its own text, and what is confirmed is the whole item, around
every passage that retrieves it until one is confirmed.

The index is built on the driver and sent out; its size is checked first.  Items beyond ``MOST_BYTES`` are dealt to
several indexes, each within the bound, and the passages are queried against one after the other.

Defined results: null and empty texts and items have no terms and match nothing; repeated rows match each on their
own; long texts are queried whole; an empty table on either side gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, texts, tidy

PASSAGE, STRIDE = 96, 48  # words
THRESHOLD = 0.5  # of the score of the item's own text
OVERLAP = 0.6  # of the n-grams of the question, and of the answer
GRAM = 3
BLOCK = 32  # postings a block
K1, B = 1.2, 0.75
MOST_BYTES = 32 << 20  # of items in an index, long ones with their pieces

_CUT = bytes(32 if chr(c) in ".,;:!?\"'()[]{}<>|/\\*_#`~=+-" else c for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def terms(text: str) -> list[bytes]:
    return text.lower().encode().translate(_CUT).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last line is the answer if there are several, else the last sentence if there are several, else the last third."""
    lines = [x for x in text.split("\n") if terms(x)]
    parts = lines if len(lines) > 1 else [x for x in _SENTENCE.split(text) if terms(x)]
    if len(parts) > 1:
        return terms(" ".join(parts[:-1])), terms(parts[-1])
    words = terms(text)
    cut = len(words) - max(1, len(words) // 3)
    return (words[:cut], words[cut:]) if cut else (words, words)


def grams(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _part(words: list[bytes]) -> tuple[int, set[tuple[bytes, ...]]]:
    size = max(1, min(GRAM, len(words)))
    return size, grams(words, size)


def entries(words: list[bytes]) -> list[list[bytes]]:
    """The item itself and, if it is longer than a passage, its pieces."""
    if len(words) <= PASSAGE:
        return [words]
    return [words, *(words[i : i + STRIDE] for i in [*range(0, len(words) - STRIDE, STRIDE // 2), len(words) - STRIDE])]


class Index:
    """Postings in entry order with block maxima; weights are shares of each entry's own score; ``of`` has an entry's item."""

    def __init__(self, items: list[tuple[int, str]], frequencies: Counter[bytes], number: int, mean: float):
        self.items = [i for i, _ in items]
        words = [terms(t) for _, t in items]
        pieces = [(i, x) for i, own in enumerate(words) for x in entries(own)]
        self.of = [i for i, _ in pieces]
        idf = {t: math.log(1 + (number - n + 0.5) / (n + 0.5)) for t, n in frequencies.items()}
        held: dict[bytes, list[tuple[int, float]]] = {}
        for k, (_, own) in enumerate(pieces):
            weight = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(own) / mean)) for t, n in Counter(own).items()}
            total = sum(weight.values())
            for t, w in weight.items():
                held.setdefault(t, []).append((k, w / total))
        self.docs = {t: [k for k, _ in p] for t, p in held.items()}
        self.weights = {t: [w for _, w in p] for t, p in held.items()}
        self.tops = {t: [max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for t, w in self.weights.items()}
        self.best = {t: max(w) for t, w in self.weights.items()}
        self.parts = [tuple(map(_part, question_and_answer(t))) for _, t in items]
        most = max(8, len(pieces) // 50)
        self.rare = {t: n for n, t in enumerate(t for t, p in self.docs.items() if len(p) <= most)}
        own = [(self.docs[t], self.weights[t]) for t in self.rare]
        self.rare_ends = np.cumsum([0, *(len(d) for d, _ in own)])
        self.rare_items = np.array([k for d, _ in own for k in d], dtype=np.int64)
        self.rare_weights = np.array([w for _, ws in own for w in ws])
        self.rest = 1.0 - np.bincount(self.rare_items, weights=self.rare_weights, minlength=len(pieces))  # by the entry's common terms
        self.longest = max((len(w) for w in words), default=0)

    def query(self, words: set[bytes], least: float) -> list[tuple[int, float]]:
        """All items with a score of ``least`` or more, by block-max WAND: least item first, nothing skipped that could reach it."""
        cursors = [[self.docs[t], self.weights[t], self.tops[t], self.best[t], 0] for t in words if t in self.docs]
        out, slack = [], least - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0][c[4]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0][cursors[pivot][4]]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][4]] == item:
                pivot += 1
            ends, block_bound = [], 0.0
            for c in cursors[: pivot + 1]:  # the block in which each cursor would find the pivot
                at = bisect_left(c[0], item, c[4])
                if at < len(c[0]):
                    block_bound += c[2][at // BLOCK]
                    ends.append(c[0][min(len(c[0]), (at // BLOCK + 1) * BLOCK) - 1] + 1)
            if block_bound < slack:  # no item up to the nearest block end can reach it
                goal = max(item + 1, min(ends))
                if pivot + 1 < len(cursors):
                    goal = max(item + 1, min(goal, cursors[pivot + 1][0][cursors[pivot + 1][4]]))
                moved = cursors[: pivot + 1]
            elif cursors[0][0][cursors[0][4]] == item:
                score = sum(c[1][c[4]] for c in cursors[: pivot + 1])
                if score >= slack:
                    out.append((item, score))
                goal, moved = item + 1, cursors[: pivot + 1]
            else:
                goal, moved = item, [c for c in cursors[:pivot] if c[0][c[4]] < item]
            for c in moved:
                c[4] = bisect_left(c[0], goal, c[4])
            cursors = [c for c in cursors if c[4] < len(c[0])]
        return out


class Searcher:
    def __init__(self, index: Index, least: float = THRESHOLD, overlap: float = OVERLAP):
        self.index, self.least, self.overlap = index, least, overlap

    def passages(self, texts: list[list[bytes]]) -> dict[int, list[int]]:
        """First words, by text, of the passages in which some item may reach the threshold."""
        ix = self.index
        get = ix.rare.get
        size = np.array([len(w) for w in texts])
        windows = np.maximum(1, -(-(size - (PASSAGE - STRIDE)) // STRIDE))
        base = np.cumsum(windows) - windows
        term = np.fromiter((get(w, -1) for words in texts for w in words), dtype=np.int64, count=int(size.sum()))
        at = np.flatnonzero(term >= 0)
        term = term[at]
        of = np.repeat(np.arange(len(texts)), size)[at]
        step = (at - (np.cumsum(size) - size)[of]) // STRIDE
        n = (ix.rare_ends[term + 1] - ix.rare_ends[term]).astype(np.int64)
        row = np.repeat(np.arange(len(term)), n)
        posting = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + ix.rare_ends[term][row]
        item, weight = ix.rare_items[posting], ix.rare_weights[posting]
        keys, gains = [], []
        for back in range(PASSAGE // STRIDE):  # a word is in the windows that begin up to PASSAGE before it
            w = step[row] - back
            ok = (w >= 0) & (w < windows[of[row]])
            keys.append(item[ok] * int(windows.sum()) + base[of[row]][ok] + w[ok])
            gains.append(weight[ok])
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        gain = np.bincount(inverse, weights=np.concatenate(gains), minlength=len(key))
        sure = np.flatnonzero(ix.rest >= self.least - 1e-9)  # items of common terms only: every window is theirs
        hit = np.arange(int(windows.sum())) if len(sure) else np.unique(key[gain + ix.rest[key // int(windows.sum())] >= self.least - 1e-9] % int(windows.sum()))
        out: dict[int, list[int]] = {}
        for d, w in zip((np.searchsorted(base, hit, side="right") - 1).tolist(), hit.tolist(), strict=True):
            out.setdefault(d, []).append((w - int(base[d])) * STRIDE)
        return out

    def documents(self, texts: list[str]) -> list[list[tuple[int, int, float, float, float]]]:
        """By text: (item, first word of its best passage, score, share of the question, share of the answer) of confirmed items."""
        bags = [terms(t) for t in texts]
        out: list[list[tuple[int, int, float, float, float]]] = [[] for _ in texts]
        if not texts or not self.index.items:
            return out
        for d, begins in self.passages(bags).items():
            words = bags[d]
            found: dict[int, dict[int, float]] = {}
            for b in begins:
                for entry, score in self.index.query(set(words[b : b + PASSAGE]), self.least):
                    at = found.setdefault(self.index.of[entry], {})
                    at[b] = max(at.get(b, 0.0), score)
            for item, at in sorted(found.items()):
                for b, score in sorted(at.items(), key=lambda x: (-x[1], x[0])):
                    around = words[max(0, b - self.index.longest) : b + PASSAGE + self.index.longest]
                    q, a = (len(p & grams(around, n)) / max(1, len(p)) for n, p in self.index.parts[item])
                    if q >= self.overlap and a >= self.overlap:
                        out[d].append((self.index.items[item], b, score, q, a))
                        break
        return out


def indexes(benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> Iterator[Index]:
    """One index if the items are within ``most_bytes``, else several; item statistics are of all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    octets = F.octet_length("text")
    size = items.agg(F.sum(F.when(octets >= 2 * PASSAGE, 3 * octets).otherwise(octets))).first()[0] or 0  # with pieces, thrice
    parts = max(1, -(-size // most_bytes))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    frequencies: Counter[bytes] = Counter()
    number = total = 0
    if parts > 1:  # the statistics need every item; they are gathered part by part too
        for k in range(parts):
            for r in dealt.where(F.col("part") == k).toLocalIterator():
                own = terms(r["text"])
                frequencies.update(set(own))
                number, total = number + 1, total + len(own)
    for k in range(parts):
        rows = sorted((r["item_id"], r["text"]) for r in dealt.where(F.col("part") == k).collect() if terms(r["text"]))
        if parts == 1:
            for _, t in rows:
                own = terms(t)
                frequencies.update(set(own))
                number, total = number + 1, total + len(own)
        if rows:
            yield Index(rows, frequencies, number, total / max(1, number))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, first_word, score, question_overlap, answer_overlap) of every confirmed pair."""
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(Searcher(index, least, overlap))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *hit) for d, hits in zip(batch.column(0).to_pylist(), shared.value.documents(batch.column(1).to_pylist()), strict=True) for hit in hits]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        part = texts(docs).mapInArrow(tidy(run), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` without a confirmed item, filtered where they are read, index after index, without a join."""
    spark = docs.sparkSession
    bound_batches(spark)
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(Searcher(index, least, overlap))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = shared.value.documents([t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
