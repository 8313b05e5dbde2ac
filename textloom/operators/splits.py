"""Reproducible splits, samples, quotas and pools, drawn by hashes of ids: the same rows however the data lies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import VAL_SHARE


def draw(key: str, seed: str) -> Column:
    """A uniform order of keys, the same in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_bucket(key: str, mod: int, rest: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod == rest


def stratified(rows: DataFrame, key: str, strata: str, share: float = VAL_SHARE, seed: str = "val") -> DataFrame:
    """Adds ``chosen``: of each stratum the first round(share * n) by ``draw``, halves to even."""
    w = Window.partitionBy(strata)
    return rows.withColumn("chosen", F.row_number().over(w.orderBy(draw(key, seed), key)) <= F.bround(share * F.count("*").over(w)))


def by_cluster(rows: DataFrame, cluster: str, share: float = VAL_SHARE, seed: str = "val") -> DataFrame:
    """Adds ``chosen`` for whole clusters; the draw is on the distinct clusters, cut by a threshold rank."""
    units = rows.select(cluster).distinct()
    n = units.count()
    ranked = units.orderBy(draw(cluster, seed), cluster).limit(int(_even(share * n)))
    return rows.join(ranked.withColumn("chosen", F.lit(True)), cluster, "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def _even(x: float) -> int:
    low = math.floor(x)
    return low if x - low < 0.5 or (x - low == 0.5 and low % 2 == 0) else low + 1


def proportional_head(rows: DataFrame, strata: str, unit: str, cap: int) -> DataFrame:
    """Units to keep so that about ``cap`` rows stay: each stratum's share of them, at least its first unit, whole units in order."""
    sizes = rows.groupBy(strata, unit).count()
    total = rows.count()
    shares = sizes.groupBy(strata).agg(F.sum("count").alias("n")).select(strata, F.greatest(F.lit(1), F.bround(cap * F.col("n") / F.lit(max(total, 1)))).alias("quota"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(strata).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("before", before).join(shares, strata).where("before < quota").select(strata, unit, "count")


def balanced(rows: DataFrame, key: str, label: str, seed: str = "balance") -> DataFrame:
    """Every class at the size of the smallest."""
    least = rows.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(draw(key, seed), key))).where(F.col("_n") <= least).drop("_n")


def few_shot(rows: DataFrame, key: str, label: str, n: int, seed: str = "few") -> DataFrame:
    """``n`` of each class."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(draw(key, seed), key))).where(F.col("_n") <= n).drop("_n")


def round_robin(rows: DataFrame, base: str, group: str, key: str, most: int) -> DataFrame:
    """Of each base the first ``most`` rows, the groups taking turns."""
    turn = F.row_number().over(Window.partitionBy(base, group).orderBy(key))
    nth = F.row_number().over(Window.partitionBy(base).orderBy("turn", group, key))
    return rows.withColumn("turn", turn).withColumn("nth", nth).where(F.col("nth") <= most)


def interleave(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """``turn`` is a row's number in its kind: (turn, kind) is the interleaved order."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(kind).orderBy(key)))


def shard(rows: DataFrame, strata: str, key: str, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.row_number().over(Window.partitionBy(strata).orderBy(key)) - 1, F.lit(shards)))


def folds(rows: DataFrame, by: str) -> DataFrame:
    """(fold, role, rows...) for each value of ``by`` held out once; the fold list is the column's own distinct values."""
    names = rows.select(F.col(by).alias("fold")).distinct()
    return rows.crossJoin(names).withColumn("role", F.when(F.col(by) == F.col("fold"), "test").otherwise("train"))


def fold_usable(folded: DataFrame, label: str, least: int = 1) -> DataFrame:
    """Counts of a fold and whether both sides have ``least`` rows of both classes."""
    cells = {f"{r}_{y}": F.sum(((F.col("role") == r) & (F.col(label) == y)).cast("int")) for r in ("train", "test") for y in (0, 1)}
    out = folded.groupBy("fold").agg(*(c.alias(k) for k, c in cells.items()))
    return out.withColumn("usable", F.least(*cells) >= least)


def group_folds(rows: DataFrame, group: str, k: int = 3) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.crc32(F.col(group).cast("string").cast("binary")), F.lit(k)))


def pool(rows: DataFrame, condition: Column, target: int) -> DataFrame:
    """(n, target, shortfall) of the rows that may serve as negatives."""
    n = F.sum(F.coalesce(condition, F.lit(False)).cast("int"))
    return rows.agg(n.alias("n")).select("n", F.lit(target).alias("target"), F.greatest(F.lit(0), target - F.col("n")).alias("shortfall"))
