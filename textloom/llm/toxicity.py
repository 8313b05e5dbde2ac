"""Toxicity by multiple-instance learning.

A document is a bag of distinct sentences.  A sentence's probability is a logistic function of the weights of its
distinct words and of their first characters, none of them negative, so that no harmless word can hide an offending
one; the document's is the noisy-or of its sentences with one leak for the whole document, so that a
sentence without a known feature adds nothing and neither length nor repetition makes a document toxic.  Only
documents have labels: the gradient of a document's loss goes to each sentence in proportion to its own probability,
so that training finds the offending sentences by itself; ``locate`` returns them.

Defined results: null and empty texts have no sentence and score 0; ties don't arise, a score depends on its own text
alone; repeated rows get equal results; long texts are scored whole; an empty table gives an empty one; further
columns are not read.  Without a labelled row of either kind nothing offends: the model has no features, and every
text scores 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, label_sample, tidy

MOST_DOCS = 6_000  # bound of the training sample
HEADS = (4, 5)  # characters from a longer word's start that stand for it
EPOCHS, LEAST_STEPS, BATCH = 12, 1500, 32  # few documents are gone through more often
TOXIC_WEIGHT = 1.5  # of a toxic document in the loss: they are the rarer
REST = -6.5  # logit of a sentence without a known feature
LEAST_DOCS = 4  # training documents a feature must have
MOST_WORDS = 200_000  # in the cache

_END = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def sentences(text: str) -> list[str]:
    return [s for s in _END.split(text) if s and not s.isspace()]


def features(word: str) -> list[str]:
    """A short word as it is between punctuation marks, lower-cased; a longer one's beginnings, which its inflections share."""
    core = _EDGE.sub("", word.lower())
    if len(core) <= max(HEADS):
        return [core] if core else []
    return [f"{core[:n]}-" for n in HEADS]


def surprise(z: np.ndarray | float) -> np.ndarray | float:
    """-log(1 - p) of the probability with logit z, exact for small ones too."""
    return np.logaddexp(0, z)


class Model:
    def __init__(self, weights: dict[str, float], leak: float):
        self.weights, self.leak = weights, leak
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "leak": self.leak, "known": {}}

    def word(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(self.known) < MOST_WORDS:
                self.known[word] = got
        return got

    def released(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches; workers live on, so that the words met go at a task's end, however it ends."""
        try:
            yield from batches
        finally:
            self.known.clear()

    def sums(self, parts: list[str]) -> np.ndarray:
        word, known, sums = self.word, self.known, []
        for s in parts:
            words = set(s.split())
            try:
                sums.append(sum(map(known.__getitem__, words)))
            except KeyError:
                sums.append(sum(map(word, words)))
        return np.array(sums, dtype=np.float64)

    def score(self, text: str | None) -> float:
        found = self.sums(list(set(sentences(text)))) if text else ()
        if not len(found):
            return 0.0
        return float(-np.expm1(-np.sort(surprise(found[found > 0] + REST) - surprise(REST)).sum() - surprise(self.leak)))

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, str, float]]:
        """(number, sentence, probability) of the sentences that offend."""
        if not text:
            return []
        parts = sentences(text)
        p = 1 / (1 + np.exp(-self.sums(parts) - REST))
        return [(i, parts[i], float(p[i])) for i in np.flatnonzero(p >= least).tolist()]


def gradient(w: np.ndarray, leak: float, f: np.ndarray, at: np.ndarray, count: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Loss of some documents, the features met and their gradients, and the leak's.

    ``f``, ``at``: feature and sentence of each occurrence; ``count``: sentences (one at least) of each document.
    With L = the sum over sentences of log(1 + e^z) above that of ``REST``, plus the leak's once, a document's
    probability is 1 - e^-L, and the loss is L if it is clean and -log(1 - e^-L) if it is toxic.
    """
    first = np.cumsum(count) - count
    z = np.bincount(at, weights=w[f], minlength=int(count.sum())) + REST
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    total = np.add.reduceat(surprise(z) - surprise(REST), first) + surprise(leak)
    whole = np.maximum(-np.expm1(-total), 1e-9)
    slope = np.where(y == 1, TOXIC_WEIGHT * (whole - 1) / whole, 1.0)
    u, inv = np.unique(f, return_inverse=True)
    g = np.bincount(inv, weights=(np.repeat(slope, count) * p)[at], minlength=len(u))
    loss = np.where(y == 1, -TOXIC_WEIGHT * np.log(whole), total).sum()
    return float(loss), u, g, float(slope.sum() / (1 + np.exp(-leak)))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 3, ridge: float = 1e-3) -> Model:
    """Noisy-or loss over documents, Adagrad, over the features of LEAST_DOCS documents or more."""
    seen: Counter[str] = Counter()
    known: dict[str, list[str]] = {}
    for text in texts:
        words = set(text.split())
        for w in words.difference(known):
            known[w] = features(w)
        seen.update({f for w in words for f in known[w]})
    names = sorted(f for f, n in seen.items() if n >= LEAST_DOCS)
    number = {f: i for i, f in enumerate(names)}
    rows = {w: [number[f] for f in fs if f in number] for w, fs in known.items()}
    del known, seen
    bags = []
    for text in texts:
        parts = [[f for w in set(s.split()) for f in rows[w]] for s in dict.fromkeys(sentences(text))]
        bags.append((np.array([f for r in parts for f in r], dtype=np.int32), np.repeat(np.arange(len(parts)), [len(r) for r in parts]).astype(np.int32), len(parts)))
    w, gw = np.zeros(len(names)), np.full(len(names), 1e-3)
    leak, gb = -5.0, 1e-3
    rng, y = np.random.default_rng(seed), np.array(labels)
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(bags))))):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            pick = [i for i in order[k : k + BATCH] if bags[i][2]]
            if not pick:
                continue
            count = np.array([bags[i][2] for i in pick])
            first = np.cumsum(count) - count
            f = np.concatenate([bags[i][0] for i in pick])
            at = np.concatenate([bags[i][1] + b for i, b in zip(pick, first, strict=True)])
            # half of the features are hidden in toxic documents: else the first words to be learned explain the rest away
            shown = (rng.random(len(w)) < 0.5)[f] | np.repeat(y[pick] == 0, count)[at]
            _, u, g, total = gradient(w, leak, f[shown], at[shown], count, y[pick])
            g = g / BATCH + ridge
            gw[u] += g * g
            w[u] = np.maximum(w[u] - 0.3 * g / np.sqrt(gw[u]), 0)
            total /= BATCH
            gb += total * total
            leak -= 0.2 * total / np.sqrt(gb)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(leak))


def train(labelled: DataFrame, most: int = MOST_DOCS) -> Model:
    """``labelled``: (doc_id, text, toxic).  At most about ``most`` documents, by a hash of the id, reach the driver."""
    rows = label_sample(labelled.where("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), "doc_id"), most).collect()
    rows = sorted((str(r["doc_id"]), r["text"], r["toxic"]) for r in rows)
    if len({r[2] for r in rows}) < 2:
        return Model({}, -math.inf)
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: Model, held_out: Column | None = None, threshold: float = 0.7, with_spans: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, on demand with the offending sentences."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the features of the bounded training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in m.released(batches):
            texts = batch.column(2).to_pylist()
            scores = [m.score(t) for t in texts]
            cols = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted"]
            if with_spans:
                kind = pa.list_(pa.struct([("sentence", pa.int32()), ("text", pa.string()), ("p", pa.float64())]))
                cols.append(pa.array([[{"sentence": i, "text": s, "p": p} for i, s, p in m.locate(t)] for t in texts], kind))
                names.append("offending")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, held_out boolean, score double, predicted int"
    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), schema + (", offending array<struct<sentence: int, text: string, p: double>>" if with_spans else ""))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, filtered where they are read, without a join."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.value.released(batches):
            yield batch.filter(pa.array([shared.value.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
