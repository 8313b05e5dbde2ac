"""Detectors over long-form features: Bloom readout, centroid, nearest neighbours, logistic regression, patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import match_any
from ..sources.shared import cut
from .features import unit_rows
from .metrics import auc


def bloom_fit(codes: DataFrame, labels: DataFrame, row: str, cell: str, gamma: float, normalised: bool = False) -> DataFrame:
    """(label, cell, f): gamma to the number of training codes of the class with the cell; unseen cells are not stored and stand for 1."""
    seen = codes.join(labels, row)
    n = seen.groupBy("label", cell).agg(F.count("*").cast("double").alias("n"))
    if normalised:
        size = labels.groupBy("label").count()
        least = size.agg(F.min("count").alias("least"))
        n = n.join(F.broadcast(size), "label").crossJoin(F.broadcast(least)).withColumn("n", F.col("n") * F.col("least") / F.col("count"))
    return n.select("label", cell, F.pow(F.lit(float(gamma)), F.col("n")).alias("f"))


def bloom_score(codes: DataFrame, filters: DataFrame, row: str, cell: str) -> DataFrame:
    """(phi1 - phi0 + 1) / 2, where phi is 1 minus the mean filter value over a row's active cells."""

    def phi(label: int) -> DataFrame:
        f = filters.where(F.col("label") == label).select(cell, "f")
        return codes.join(f, cell, "left").groupBy(row).agg((1 - F.avg(F.coalesce("f", F.lit(1.0)))).alias(f"phi{label}"))

    return phi(1).join(phi(0), row).select(row, ((F.col("phi1") - F.col("phi0") + 1) / 2).alias("score"))


def bloom_update(counts: DataFrame, more: DataFrame, cell: str) -> DataFrame:
    """Online learning: class counts of (label, cell, n) with those of another batch."""
    return counts.unionByName(more).groupBy("label", cell).agg(F.sum("n").alias("n"))


def centroid_score(train: DataFrame, labels: DataFrame, x: DataFrame, row: str) -> DataFrame:
    """(cos to class 1 - cos to class 0 + 1) / 2 with unit rows and unit class means."""
    unit = unit_rows(train, row)
    size = labels.groupBy("label").count()
    mean = unit.join(labels, row).groupBy("label", "bin").agg(F.sum("value").alias("value")).join(F.broadcast(size), "label").withColumn("value", F.col("value") / F.col("count"))
    centre = unit_rows(mean, "label").groupBy("bin").agg((F.sum(F.when(F.col("label") == 1, F.col("value")).otherwise(0.0)) - F.sum(F.when(F.col("label") == 0, F.col("value")).otherwise(0.0))).alias("c"))
    return unit_rows(x, row).join(centre, "bin", "left").groupBy(row).agg(((F.sum(F.col("value") * F.coalesce("c", F.lit(0.0))) + 1) / 2).alias("score"))


BLOCK = 8192  # vectors of a block: 2 MB at 64 floats


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, those without a length as they are; sums run from the left, as in the definition."""
    total = np.zeros(len(v))
    for j in range(v.shape[1]):
        total += v[:, j] * v[:, j]
    norm = np.sqrt(total)
    return v / np.where(norm == 0, 1.0, norm)[:, None]


def _rounded(x: np.ndarray) -> np.ndarray:
    """Nine decimals of the shortest decimal form, halves away from zero, as Spark rounds."""
    near = np.floor(np.abs(x) * 1e9 + 0.5)
    for i in np.flatnonzero(np.abs(np.abs(x) * 1e9 % 1 - 0.5) < 1e-5).tolist():
        near[i] = int(Decimal(repr(abs(float(x[i])))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return np.where(near > 0, np.copysign(near, x), near) / 1e9


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(ids, dim, data): blocks of vectors of one dimension as doubles, by id; without data those with a null in them, which have no cosine."""
    kind = rows.schema[key].dataType
    total = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, data = pa.concat_arrays([x for x, _ in held[dim]]), np.concatenate([x for _, x in held[dim]])
            order = pc.sort_indices(pa.table({"k": ids}), sort_keys=[("k", "ascending")], null_placement="at_start")
            ids, data, held[dim] = ids.take(order), data[order.to_numpy()], []
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([dim], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["ids", "dim", "data"])

        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            sizes = pc.list_value_length(v).fill_null(-1).to_numpy(zero_copy_only=False).copy()
            values, ends = v.flatten(), np.cumsum(np.maximum(sizes, 0))
            empty = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
            starts = ends - np.maximum(sizes, 0)
            flat = values.to_numpy(zero_copy_only=False)
            sizes[empty[ends] > empty[starts]] = -1
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for part in np.array_split(own, -(-len(own) // BLOCK)):
                    at = starts[part][:, None] + np.arange(max(dim, 0))
                    held.setdefault(dim, []).append((ids.take(pa.array(part)), flat[at].astype(np.float64).reshape(len(part), max(dim, 0))))
                    if sum(len(x) for x, _ in held[dim]) >= BLOCK:
                        yield block(dim)
        for dim in held:
            if held[dim]:
                yield block(dim)

    plain = rows.select(F.col(key).alias("id"), F.transform(vector, lambda e: e.cast("double")).alias("v"))
    out = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("dim", T.IntegerType()), T.StructField("data", T.BinaryType())])
    return cut(plain.repartition(max(1, -(-total // BLOCK))).mapInArrow(run, out))


class _Nearest:
    """What of each block of references can be among the k nearest of one block of queries, block after block."""

    def __init__(self, data: bytes, dim: int, n: int, k: int):
        self.dim, self.k = dim, k
        self.unit = _unit(np.frombuffer(data).reshape(n, max(dim, 0))) if dim >= 0 else None
        self.least = np.full((n, k), -np.inf)  # the largest cosines so far, from the left

    def meet(self, data: bytes, dim: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(places of queries, places of references, cosines or none); references lie by id."""
        rows, k = len(self.least), self.k
        if dim < 0 or dim != self.dim:  # null, which comes last
            some = min(k, n)
            for a in range(0, rows, BLOCK):
                part = np.arange(a, min(a + BLOCK, rows))
                yield np.repeat(part, some), np.tile(np.arange(some), len(part)), None
            return
        unit = _unit(np.frombuffer(data).reshape(n, dim))
        # of equal rows only the first k can be among the nearest
        _, copy = np.unique(np.ascontiguousarray(unit + 0.0).view(f"V{8 * dim}").ravel(), return_inverse=True) if dim else (None, np.zeros(n, np.int64))
        order = np.argsort(copy, kind="stable")
        first = np.searchsorted(copy[order], copy[order])
        own = np.sort(order[np.arange(n) - first < k])
        unit = unit[own]
        short, wide = unit.astype(np.float32), len(own)
        margin = np.float64((dim + 4) * 2.0**-22 + 2e-9)  # beyond the error of a float's product of unit rows, and of the rounding
        odd = np.isnan(unit).any() or np.isnan(self.unit).any()
        for a in range(0, rows, 256):
            q = self.unit[a : a + 256]
            s = q.astype(np.float32) @ short.T
            if odd:
                s[np.isnan(s)] = np.inf
            groups = min(wide, max(64, 2 * k))
            size = wide // groups
            top = s[:, : groups * size].reshape(len(q), groups, size).max(axis=2)
            floor = self.least[a : a + 256, 0]
            if groups >= k:  # k groups have a row of this or more each
                floor = np.maximum(floor, np.partition(top, groups - k, axis=1)[:, groups - k])
            i, j = np.divmod(np.flatnonzero(s >= (floor - margin).astype(np.float32)[:, None]), wide)
            sim = np.zeros(len(i))
            for b in range(0, len(i), 1 << 16):
                part = slice(b, b + (1 << 16))
                for c in range(dim):
                    sim[part] += q[i[part], c] * unit[j[part], c]
            none = np.isnan(sim)
            sim[~none] = _rounded(sim[~none])
            order = np.lexsort((j, -np.where(none, np.inf, sim), i))
            i, j, sim = i[order], j[order], sim[order]
            keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & ((np.where(np.isnan(sim), np.inf, sim) >= self.least[a + i, 0]))
            i, j, sim = i[keep], j[keep], sim[keep]
            more = np.full((len(q), k), -np.inf)
            more[i, np.arange(len(i)) - np.searchsorted(i, i)] = np.where(np.isnan(sim), np.inf, sim)
            self.least[a : a + 256] = np.sort(np.concatenate([self.least[a : a + 256], more], axis=1), axis=1)[:, k:]
            yield a + i, own[j], sim


def knn(queries: DataFrame, train: DataFrame, query: str, ref: str, vector: str, k: int) -> DataFrame:
    """(query, ref, sim, rank): the k training rows of largest cosine, the smaller id on ties.

    Every query meets every training row, a block of each at a time: products in single precision leave out what is
    surely not among the nearest, the others are summed in doubles.
    """
    out = T.StructType([queries.schema[query], train.schema[ref], T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                q_ids, q_dim, q_data, r_ids, r_dim, r_data = (batch.column(c)[n] for c in range(6))
                if last is None or not q_data.equals(last[1]) or not q_ids.equals(last[0]):
                    last, held = (q_ids, q_data), _Nearest(q_data.as_py(), q_dim.as_py(), len(q_ids), k)
                for i, j, sim in held.meet(r_data.as_py(), r_dim.as_py(), len(r_ids)):
                    sims = pa.nulls(len(i), pa.float64()) if sim is None else pa.array(sim)
                    yield pa.RecordBatch.from_arrays([q_ids.values.take(pa.array(i)), r_ids.values.take(pa.array(j)), sims], out.names)

    names = ("ids", "dim", "data")
    q = _blocks(queries, query, vector).select(*(F.col(c).alias(f"q_{c}") for c in names))
    r = _blocks(train, ref, vector).select(*(F.col(c).alias(f"r_{c}") for c in names))
    near = q.crossJoin(r).mapInArrow(run, out)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("sim"), ref))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_score(neighbours: DataFrame, labels: DataFrame, query: str, ref: str, k: int) -> DataFrame:
    """k = 1: half plus or minus half the similarity; else the share of label 1."""
    j = neighbours.join(labels.select(F.col(labels.columns[0]).alias(ref), "label"), ref)
    if k == 1:
        return j.select(query, F.when(F.col("label") == 1, 0.5 + 0.5 * F.col("sim")).otherwise(0.5 - 0.5 * F.col("sim")).alias("score"))
    return j.groupBy(query).agg(F.avg(F.col("label").cast("double")).alias("score"))


def logistic(train: DataFrame, features: str, label: str, c: float, iterations: int = 100):
    """L2 logistic regression with balanced classes; c scales the summed loss, so the mean loss takes 1 / (c * weight)."""
    from pyspark.ml.classification import LogisticRegression

    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(0.0)
    for y, n in counts.items():
        weight = F.when(F.col(label) == y, total / (len(counts) * n)).otherwise(weight)
    est = LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-6)
    return est.fit(train.withColumn("_w", weight).withColumn(label, F.col(label).cast("double")))


def pattern_score(rows: DataFrame, patterns: list[str]) -> DataFrame:
    return rows.withColumn("score", match_any(F.col("text"), patterns))


def best_of_grid(scores: DataFrame, grid: str = "g") -> DataFrame:
    """The first grid value of largest AUC of (g, score, label)."""
    return auc(scores, [grid]).orderBy(F.desc("auc"), grid).limit(1)


def smallest_best(scores: DataFrame, grid: str = "c") -> float | None:
    """The smallest grid value among those of largest AUC; the grid's middle if no AUC is defined."""
    rows = sorted((r[grid], r["auc"]) for r in auc(scores, [grid]).collect())  # a row a grid value
    have = [r for r in rows if r[1] is not None]
    if not have:
        return rows[len(rows) // 2][0] if rows else None
    top = max(a for _, a in have)
    return next(g for g, a in have if a == top)


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


@dataclass(frozen=True)
class Detector:
    name: str
    family: str
    score: Callable[..., DataFrame]


#: A detector is a function from frames to (row, score); guards that need weights plug in here.
DETECTORS: dict[str, Detector] = {d.name: d for d in (Detector("bloom", "code", bloom_score), Detector("centroid", "lexical", centroid_score), Detector("knn", "lexical", knn_score), Detector("regex", "lexical", pattern_score))}


def register(name: str, family: str, score: Callable[..., DataFrame]) -> None:
    DETECTORS[name] = Detector(name, family, score)


def prescore(texts: list[DataFrame], cache: DataFrame) -> DataFrame:
    """Distinct texts of several frames that a score cache lacks: (text_hash, text)."""
    every = texts[0]
    for t in texts[1:]:
        every = every.unionByName(t)
    return every.dropDuplicates(["text_hash"]).join(cache.select("text_hash"), "text_hash", "left_anti")
