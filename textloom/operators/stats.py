"""Cluster bootstrap, intervals, equivalence, multiplicity and randomisation tests, power."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import ALPHA


def cluster_weights(rows: DataFrame, cluster: str, draws: int, strata: list[str] | None = None, seed: str = "boot") -> DataFrame:
    """(strata, cluster, draw, w): how often each of k clusters is drawn in k draws with replacement, within its stratum.

    Draw d's slot s takes the cluster with number md5(seed:d:s) mod k, so that any engine draws the same.  The table
    has at most draws * k rows; it is made by explode on the clusters and summed, and nothing of it is collected.
    """
    by = strata or []
    units = rows.select(*by, cluster).distinct()
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    numbered = units.withColumn("no", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("k", F.count("*").over(w))
    slots = numbered.select(*by, F.col("no").alias("slot"), "k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *by, "draw", "slot")), 1, 8), 16, 10).cast("long"), F.col("k"))
    drawn = slots.withColumn("no", pick).groupBy(*by, "draw", "no").agg(F.count("*").alias("w"))
    return drawn.join(numbered.select(*by, "no", cluster), [*by, "no"]).select(*by, cluster, "draw", "w")


def bootstrap_rate(rows: DataFrame, value: str, cluster: str, draws: int, by: list[str] | None = None) -> DataFrame:
    """(by, draw, stat): the mean of ``value`` in each draw; rows are summed per cluster before they meet the draws."""
    by = by or []
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    both = sums.join(cluster_weights(rows, cluster, draws, by), [*by, cluster])
    return both.groupBy(*by, "draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("stat"))


def bootstrap_auc(rows: DataFrame, cluster: str, draws: int, by: list[str] | None = None) -> DataFrame:
    """(by, draw, stat): the weighted Mann-Whitney statistic of each draw; null where a draw lost a class."""
    by = by or []
    cells = rows.groupBy(*by, cluster, "score").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("n"))
    drawn = cells.join(cluster_weights(rows, cluster, draws, by), [*by, cluster]).groupBy(*by, "draw", "score").agg(F.sum(F.col("w") * F.col("p")).alias("p"), F.sum(F.col("w") * F.col("n")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "draw").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = drawn.withColumn("won", F.col("p") * (below + F.col("n") / 2)).groupBy(*by, "draw").agg(F.sum("won").alias("won"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return total.select(*by, "draw", F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("won") / (F.col("np") * F.col("nn"))).alias("stat"))


def macro_draws(per_source: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The mean over sources in each draw; a draw in which a source lost a class is undefined as a whole."""
    by = by or []
    return per_source.groupBy(*by, "draw").agg(F.avg("stat").alias("stat"), F.count_if(F.col("stat").isNull()).alias("lost")).select(*by, "draw", F.when(F.col("lost") == 0, F.col("stat")).alias("stat"))


def percentile_ci(draws: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """Interval over the defined draws, linear between order statistics, and how many were defined."""
    q = F.percentile("stat", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.groupBy(*by).agg(q.alias("q"), F.count("stat").alias("n_valid"), F.count("*").alias("n_boot")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n_valid", "n_boot")


def paired_diff(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """stat of a minus stat of b on the same draws."""
    return a.withColumnRenamed("stat", "sa").join(b.withColumnRenamed("stat", "sb"), [*by, "draw"]).select(*by, "draw", (F.col("sa") - F.col("sb")).alias("stat"))


def bootstrap_p(draws: DataFrame, by: list[str]) -> DataFrame:
    """min(1, 2 * min(P(stat <= 0), P(stat >= 0)))."""
    return draws.where("stat is not null").groupBy(*by).agg(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("stat") <= 0).cast("double")), F.avg((F.col("stat") >= 0).cast("double")))).alias("p"))


def tost(low: Column, high: Column, reference: Column, share: float = 0.05) -> Column:
    """Equivalent if the interval lies in the closed corridor of ``share`` of the reference."""
    margin = share * F.abs(reference)
    return (low >= -margin) & (high <= margin)


def holm(rows: DataFrame, by: list[str], p: str = "p", key: str = "key") -> DataFrame:
    """Step-down adjusted p-values; rows without p get none and don't count."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    has = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    step = has.withColumn("_f", F.col(p) * (F.count("*").over(w) - F.row_number().over(w.orderBy(p, key)) + 1))
    adjusted = step.withColumn("p_holm", F.least(F.lit(1.0), F.max("_f").over(w.orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0)))).drop("_f")
    return adjusted.unionByName(rows.where(F.col(p).isNull() | F.isnan(p)).withColumn("p_holm", F.lit(None).cast("double")))


def randomization_p(nulls: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    """(1 + nulls as far from their mean as the observed) / (1 + nulls)."""
    centre = nulls.where("value is not null").groupBy(*by).agg(F.avg("value").alias("c"))
    far = nulls.join(centre, by).join(observed.select(*by, F.col("value").alias("obs")), by)
    return far.groupBy(*by).agg(((1 + F.count_if(F.abs(F.col("value") - F.col("c")) >= F.abs(F.col("obs") - F.col("c")) - 1e-12)) / (1 + F.count("value"))).alias("p"))


def p_from_ci(point: float, low: float, high: float, level: float = 0.95, null: float = 0.0) -> float:
    """Two-sided normal p-value of an interval."""
    if not (math.isfinite(low) and math.isfinite(high)) or high <= low:
        return math.nan
    se = (high - low) / (2 * NormalDist().inv_cdf(0.5 + level / 2))
    return 2 * (1 - NormalDist().cdf(abs((point - null) / se)))


def t_quantile(q: float, df: int) -> float:
    """Student's t quantile by bisection on the integral of the density (few calls: one a summary)."""

    def cdf(x: float) -> float:
        n = 2000
        h = x / n
        f = lambda t: (1 + t * t / df) ** (-(df + 1) / 2)
        s = f(0) + f(x) + 4 * sum(f((2 * i - 1) * h) for i in range(1, n // 2 + 1)) + 2 * sum(f(2 * i * h) for i in range(1, n // 2))
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        return 0.5 + c * s * h / 3

    lo, hi = 0.0, 1e4 if df < 3 else 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return (lo + hi) / 2


def seed_summary(rows: DataFrame, by: list[str], seeds: int, level: float = 0.95) -> DataFrame:
    """Mean, sample deviation, range and t-interval of ``value`` over seeds."""
    t = t_quantile(0.5 + level / 2, seeds - 1) if seeds > 1 else 0.0
    out = rows.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))
    half = t * F.col("sd") / F.sqrt("n")
    return out.withColumn("t_low", F.col("mean") - half).withColumn("t_high", F.col("mean") + half)


def power_grid(cells: DataFrame, reps: int = 30, seed: int = 1) -> DataFrame:
    """Power of a paired AUC difference in the binormal model: replicates are independent, a task has its own cells.

    ``cells``: (cell, n_docs, n_clusters, auc, delta, icc, rho).
    """

    def run(batches):
        nd = NormalDist()
        for pdf in batches:
            out = []
            for c in pdf.itertuples():
                hits = 0
                for r in range(reps):
                    rng = np.random.default_rng([seed, int(c.cell), r])
                    cl = np.arange(int(c.n_docs)) % int(c.n_clusters)
                    y = cl % 2
                    u = rng.normal(size=(2, int(c.n_clusters)))
                    e = rng.normal(size=(2, len(cl)))
                    e[1] = c.rho * e[0] + math.sqrt(1 - c.rho**2) * e[1]
                    u[1] = c.rho * u[0] + math.sqrt(1 - c.rho**2) * u[1]
                    x = math.sqrt(c.icc) * u[:, cl] + math.sqrt(1 - c.icc) * e
                    shift = [math.sqrt(2) * nd.inv_cdf(min(0.9999, a)) for a in (c.auc, c.auc + c.delta)]
                    d = []
                    for b in range(60):
                        w = np.bincount(rng.integers(0, int(c.n_clusters), int(c.n_clusters)), minlength=int(c.n_clusters))[cl]
                        d.append(_weighted_auc(x[1] + shift[1] * y, y, w) - _weighted_auc(x[0] + shift[0] * y, y, w))
                    lo, hi = np.nanpercentile(d, [2.5, 97.5])
                    hits += int(lo > 0 or hi < 0)
                out.append((c.cell, hits / reps))
            yield pd.DataFrame(out, columns=["cell", "power"])

    return cells.mapInPandas(run, "cell long, power double")


def _weighted_auc(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    wp, wn = (w * (y == 1))[order], (w * (y == 0))[order]
    if not wp.sum() or not wn.sum():
        return math.nan
    return float((wp * (np.cumsum(wn) - wn / 2)).sum() / (wp.sum() * wn.sum()))
