"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer numpy network.

Every token bucket has a fixed sparse random index vector.  A bucket's context vector is the sum of the index vectors
of the tokens around it over the *whole* corpus: a sum, so that each task adds up its own part of the input, however
many tasks there are, and the parts are added by bucket.  There are ``BUCKETS`` buckets of ``DIM`` numbers, whatever
the corpus (4 MB).  A document is the
mean and the spread of its tokens' unit vectors, and a two-layer network on these, trained with numpy, gives a logit
whose temperature is fitted on labelled documents that the network did not train on.

Defined results: null and empty texts are pooled as a zero vector and scored like any other; ties don't arise, a score
depends on its own text alone; repeated rows get equal results; long texts are pooled whole; an empty table gives an
empty one; further columns are not read.  Without labelled rows of both kinds every text scores the share of label 1
among the labels, 0.5 without any.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, label_sample, texts, tidy

BUCKETS = 1 << 14
DIM = 64
NONZERO = 4  # entries of an index vector, half of them negative
REACH = 2  # tokens on either side that count as context
MOST_DOCS = 8_000  # bound of the training sample
HIDDEN = 32
MOST_WORDS = 300_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def index_vectors(seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Positions (BUCKETS, NONZERO) of the index vectors' entries, and their signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)).astype(np.int32), np.tile([1.0, -1.0], NONZERO // 2)


class Words:
    """Text to token buckets, with a bounded cache of the words met."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            got = tuple(_bucket(t) for t in _TOKEN.findall(word.lower()))
            if len(self.known) < MOST_WORDS:
                self.known[word] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        try:
            got = [i for w in words for i in known[w]]
        except KeyError:
            word = self._word
            got = [i for w in words for i in word(w)]
        return np.array(got, dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors (BUCKETS, DIM) from all documents; what reaches the driver is this fixed-size table."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        words, total = Words(), np.zeros(BUCKETS * DIM)
        stop = np.full(REACH, -1)
        held: list[np.ndarray] = []
        size = 0

        def fold() -> None:
            ids = np.concatenate(held)
            # -1 separates documents: pairs with it are left out
            for gap in range(1, REACH + 1):
                a, b = ids[:-gap], ids[gap:]
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                for x, y in ((a, b), (b, a)):
                    at = (x[:, None] * DIM + places[y]).reshape(-1)
                    np.add(total, np.bincount(at, weights=np.tile(signs, len(x)), minlength=len(total)), out=total)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = words.ids(text)
                held += [ids, stop]
                size += len(ids)
                if size > 400_000:
                    fold()
                    held, size = [], 0
        if held:
            fold()
        grid = total.reshape(BUCKETS, DIM)
        rows = np.flatnonzero(grid.any(axis=1))
        if len(rows):
            # whole numbers: their sum doesn't depend on the order of the tasks
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(list(grid[rows].astype(np.int64)), pa.list_(pa.int64()))], ["bucket", "v"])

    parts = texts(docs).select("text").mapInArrow(tidy(run), "bucket int, v array<long>")
    summed = parts.groupBy("bucket").agg(*(F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)))
    out = np.zeros((BUCKETS, DIM), dtype=np.float64)
    got = summed.toPandas()
    if len(got):
        out[got["bucket"].to_numpy()] = got[[f"v{i}" for i in range(DIM)]].to_numpy(dtype=np.float64)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread, and mean likeness of neighbours, of a document's word vectors, and its length on a log scale."""
    if not len(ids):
        return np.zeros(2 * DIM + 3, dtype=np.float32)
    x = vectors[ids]
    mean = x.mean(axis=0)
    spread = np.sqrt(np.maximum((x * x).mean(axis=0) - mean * mean, 0))
    near = float((x[1:] * x[:-1]).sum(axis=1).mean()) if len(ids) > 1 else 0.0
    return np.concatenate([mean, spread, [near, float(np.linalg.norm(mean)), np.log1p(len(ids)) / 10]]).astype(np.float32)


class Network:
    def __init__(self, width: int, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.shift, self.scale = np.zeros(width), np.ones(width)
        self.p = {"a": rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), "ab": np.zeros(HIDDEN), "b": rng.normal(0, 0.1, HIDDEN), "bb": np.zeros(1)}
        self.temperature = 1.0

    @classmethod
    def constant(cls, width: int, share: float) -> Network:
        net = cls(width)
        net.p["b"][:] = 0
        net.p["bb"][:] = np.log(max(share, 1e-12) / max(1 - share, 1e-12))
        return net

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.shift) / self.scale) @ self.p["a"] + self.p["ab"], 0)
        return h @ self.p["b"] + self.p["bb"][0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, ridge: float = 1e-4, seed: int = 29) -> None:
        rng = np.random.default_rng(seed)
        self.shift, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.shift) / self.scale
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for k in range(0, len(z), 64):
                t += 1
                q, p = order[k : k + 64], self.p
                pre = z[q] @ p["a"] + p["ab"]
                h = np.maximum(pre, 0)
                d = (1 / (1 + np.exp(-np.clip(h @ p["b"] + p["bb"][0], -30, 30))) - y[q]) / len(q)
                dh = d[:, None] * p["b"] * (pre > 0)
                g = {"a": z[q].T @ dh + ridge * p["a"], "ab": dh.sum(0), "b": h.T @ d + ridge * p["b"], "bb": np.array([d.sum()])}
                rate = 0.005 * (1 - epoch / epochs)
                for key, v in p.items():
                    m[key] += 0.1 * (g[key] - m[key])
                    s[key] += 0.01 * (g[key] ** 2 - s[key])
                    v -= rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(s[key] / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on documents that were not trained on."""
        z = self.logits(x)

        def loss(t: float) -> float:
            u = np.clip(z / t, -40, 40)
            return float((np.logaddexp(0, u) - y * u).mean())

        self.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 81)), key=loss)


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """A fifth of the rows, every fifth in the given order, is kept for the temperature."""
    kept = np.arange(len(x)) % 5 == 4
    net = Network(x.shape[1])
    net.fit(x[~kept], y[~kept])
    if kept.any():
        net.calibrate(x[kept], y[kept])
    return net


def train(labelled: DataFrame, vectors: np.ndarray, most: int = MOST_DOCS) -> Network:
    """``labelled``: (doc_id, text, quality).  At most about ``most`` documents, by a hash of the id, reach the driver, as pooled vectors."""
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            x = [pool(words.ids(t or ""), shared.value).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    rows = label_sample(labelled.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text"), most)
    got = rows.mapInArrow(tidy(run), "doc_id long, quality int, x array<float>").toPandas()
    got = got.sort_values(["doc_id", "quality"], kind="stable")
    if got["quality"].nunique() < 2:
        return Network.constant(2 * DIM + 3, float(got["quality"].mean()) if len(got) else 0.5)
    return fit(np.array(got["x"].tolist(), dtype=np.float64), got["quality"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, held_out: Column | None = None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast((vectors, net))  # 4 MB and a small network, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        v, n = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            p = n.probabilities(np.array([pool(words.ids(t or ""), v) for t in batch.column(2).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
