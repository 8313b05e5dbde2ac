"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over windows of ``WINDOW`` bytes, each filter's maximum over
the window is kept, and a softmax layer tells the language.  The network is trained with numpy (Adam, gradients
written out) on windows of labelled text.  For scoring, embedding and filters are folded into two tables indexed by
byte pairs, which gives the same sums at two look-ups a position.

Training takes windows, not whole texts: ``WINDOWS_A_DOC`` of each sampled document, drawn by a generator seeded with
the text itself, cut out where the document is read, so that the driver gets ``MOST_DOCS * WINDOWS_A_DOC`` windows of
``WINDOW`` bytes at most.  Both are bounds of the training sample; scoring reads every window of every text.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; a text shorter than a window is
padded with byte 0, which is embedded like any other; long texts are scored whole, as the mean of their windows' log
probabilities weighted by length; of languages that tie the first by name is taken; repeated rows get equal results;
an empty table gives an empty one; further columns are not read.  Without labelled rows no language is known, and all
texts are ``und``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, label_sample, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
EMBED = 8
MOST_DOCS = 4_000  # bound of the training sample
WINDOWS_A_DOC = 3  # in the training sample
STEPS, BATCH = 700, 64

_SPAN = max(WIDTHS)
_PLACES = WINDOW - _SPAN + 1


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and how many bytes of it each holds."""
    n = max(1, -(-len(raw) // WINDOW))
    grid = np.frombuffer(raw.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)
    size = np.full(n, WINDOW)
    size[-1] = max(1, len(raw) - (n - 1) * WINDOW)
    return grid, size


class Network:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        total = FILTERS * len(WIDTHS)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": rng.normal(0, 0.3, (_SPAN, EMBED, total)).astype(np.float32),
            "bias": np.zeros(total, np.float32),
            "out": rng.normal(0, 0.2, (total, len(classes))).astype(np.float32),
            "out_bias": np.zeros(len(classes), np.float32),
        }
        self.mask = np.zeros((_SPAN, 1, total), np.float32)  # a filter of width w sees its first w bytes
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1

    def step(self, grid: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch of windows."""
        p, n = self.p, len(grid)
        filters = p["filters"] * self.mask
        x = p["embed"][grid]
        taps = np.concatenate([x[:, j : j + _PLACES] for j in range(_SPAN)], axis=2)
        flat = filters.reshape(_SPAN * EMBED, -1)
        conv = taps @ flat
        best = conv.argmax(axis=1)
        pooled = np.take_along_axis(conv, best[:, None], axis=1)[:, 0] + p["bias"]
        hidden = np.maximum(pooled, 0)
        logits = hidden @ p["out"] + p["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        loss = float(-np.log(prob[np.arange(n), labels] + 1e-9).mean())
        d = prob.copy()
        d[np.arange(n), labels] -= 1
        d /= n
        g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
        back = (d @ p["out"].T) * (pooled > 0)
        g["bias"] = back.sum(0)
        seen = taps[np.arange(n)[:, None], best]  # each filter's winning bytes
        g["filters"] = np.einsum("nf,nft->tf", back, seen).reshape(filters.shape) * self.mask
        to = (back[:, :, None] * flat.T[None]).reshape(n, -1, _SPAN, EMBED)
        at = grid[np.arange(n)[:, None, None], best[:, :, None] + np.arange(_SPAN)]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], at.reshape(-1), to.reshape(-1, EMBED))
        return loss, g

    def fit(self, grid: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, STEPS + 1):
            pick = rng.integers(0, len(grid), BATCH)
            _, g = self.step(grid[pick], labels[pick])
            rate = 0.01 * min(1.0, 2 * (1 - t / (STEPS + 1)))
            for k, v in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] * g[k] - s[k])
                v -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the filters over bytes 0 and 1, and 2 and 3, by byte pair."""
        per = np.einsum("be,sef->sbf", self.p["embed"], self.p["filters"] * self.mask)
        return tuple((per[j][:, None] + per[j + 1][None]).reshape(65536, -1).astype(np.float32) for j in (0, 2))


class Scorer:
    def __init__(self, net: Network):
        self.first, self.second = net.tables()
        self.p, self.classes = net.p, net.classes

    def log_probabilities(self, grid: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(grid), 16):  # small enough that the sums stay in the cache
            b = grid[k : k + 16].astype(np.int32)
            pair = (b[:, :-1] << 8) + b[:, 1:]
            conv = self.first[pair[:, :_PLACES]]
            conv += self.second[pair[:, 2 : 2 + _PLACES]]
            out.append(conv.max(axis=1))
        hidden = np.maximum(np.concatenate(out) + self.p["bias"], 0)
        logits = hidden @ self.p["out"] + self.p["out_bias"]
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [t if self.classes and has_letter(t) else None for t in texts]
        parts = [windows(t.encode()) for t in known if t is not None]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if parts:
            logs = self.log_probabilities(np.concatenate([g for g, _ in parts]))
            size = np.concatenate([s for _, s in parts]).astype(np.float64)
            count = np.array([len(s) for _, s in parts])
            begin = np.cumsum(count) - count
            mean = np.add.reduceat(logs * size[:, None], begin, axis=0) / np.add.reduceat(size, begin)[:, None]
            prob = np.exp(mean - mean.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            best = prob.argmax(axis=1)
            for i, b, q in zip((i for i, t in enumerate(known) if t is not None), best.tolist(), prob.max(axis=1).tolist(), strict=True):
                langs[i], scores[i] = self.classes[b], min(1.0, q)
        return langs, scores


def train(labelled: DataFrame, most: int = MOST_DOCS) -> Network:
    """``labelled``: (doc_id, text, lang).  Of at most about ``most`` documents, by a hash, some windows reach the driver."""
    bound_batches(labelled.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    raw = text.encode()
                    grid, _ = windows(raw)
                    pick = np.random.default_rng(zlib.crc32(raw)).choice(len(grid), min(WINDOWS_A_DOC, len(grid)), replace=False)
                    rows.append((doc, lang, grid[pick].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "lang", "windows"])

    known = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = label_sample(known, most).mapInArrow(tidy(cut), "doc_id long, lang string, windows binary").collect()
    rows = sorted((r["lang"], bytes(r["windows"])) for r in rows)
    classes = sorted({lang for lang, _ in rows})
    net = Network(classes)
    if rows:
        grids = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, w in rows]
        net.fit(np.concatenate(grids), np.repeat([classes.index(lang) for lang, _ in rows], [len(g) for g in grids]))
    return net


def identify(docs: DataFrame, net: Network, held_out: Column | None = None) -> DataFrame:
    """Adds lang_pred and score to (doc_id, held_out) of every row of ``docs``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 80 kB, fixed by the network's shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            langs, scores = scorer.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
