"""Counts, validators and comparisons over corpora and evaluation tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_stats(rows: DataFrame, by: list[str], c: str = "text") -> DataFrame:
    n = F.length(c)
    return rows.groupBy(*by).agg(F.min(n).alias("min"), F.floor(F.percentile(n, 0.5)).cast("long").alias("median"), F.round(F.avg(n), 1).alias("mean"), F.max(n).alias("max"))


def top_values(rows: DataFrame, by: list[str], c: str, k: int = 6) -> DataFrame:
    counts = rows.groupBy(*by, c).count()
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), c))).where(F.col("rank") <= k)


def nested_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts of (outer, inner), of outer and of all, each with its share of its outer total."""
    out = rows.rollup(outer, inner).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    total = F.max(F.when(F.col("level") == 1, F.col("n"))).over(Window.partitionBy(outer))
    return out.withColumn("share", F.when(F.col("level") == 0, F.round(F.col("n") / total, 6)))


def chi2_terms(rows: DataFrame, key: str, text: str, label: str, k: int, least: int = 3) -> DataFrame:
    """Tokens that mark label 1, by the chi-squared of their document counts, ties in alphabetical order."""
    token = F.regexp_replace("token", r"^[^a-z0-9À-ɏ]+|[^a-z0-9À-ɏ]+$", "")
    seen = rows.select(key, label, F.explode(F.split(F.lower(text), r"\s+")).alias("token")).withColumn("token", token).where((F.length("token") >= least) & F.col("token").rlike("[a-zÀ-ɏ]")).distinct()
    n = rows.agg(F.sum(F.col(label).cast("double")).alias("n1"), F.sum((1 - F.col(label)).cast("double")).alias("n0"))
    c = seen.groupBy("token").agg(F.sum(F.col(label).cast("double")).alias("a"), F.sum((1 - F.col(label)).cast("double")).alias("b")).crossJoin(F.broadcast(n))
    c = c.where("a / n1 > b / n0").withColumn("c", F.col("n1") - F.col("a")).withColumn("d", F.col("n0") - F.col("b"))
    den = (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * F.col("n1") * F.col("n0")
    chi2 = F.when(den > 0, (F.col("n1") + F.col("n0")) * F.pow(F.col("a") * F.col("d") - F.col("b") * F.col("c"), F.lit(2)) / den).otherwise(0.0)
    return c.select("token", F.col("a").cast("long").alias("pos"), F.col("b").cast("long").alias("neg"), F.round(chi2, 6).alias("chi2")).orderBy(F.desc("chi2"), "token").limit(k)


def ngram_rank(rows: DataFrame, key: str, label: str, grams: Column, k: int) -> DataFrame:
    """Precision and recall of word n-grams by documents, the best k."""
    seen = rows.select(key, label, F.explode(F.array_distinct(grams)).alias("gram"))
    n1 = rows.agg(F.sum(F.col(label).cast("long")).alias("n1"))
    c = seen.groupBy("gram").agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("docs")).where("pos > 0").crossJoin(F.broadcast(n1))
    out = c.select("gram", "pos", "docs", F.round(F.col("pos") / F.col("docs"), 6).alias("precision"), F.round(F.col("pos") / F.col("n1"), 6).alias("recall"))
    return out.orderBy(F.desc("precision"), F.desc("recall"), "gram").limit(k)


def pattern_stats(rows: DataFrame, key: str, hits: Column, label: str, patterns: int) -> DataFrame:
    """Of each pattern: positives and negatives hit, and positives that only it hits."""
    found = rows.select(key, label, hits.alias("h")).withColumn("only", F.size("h") == 1).select(label, "only", F.explode("h").alias("pattern"))
    c = found.groupBy("pattern").agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"), F.sum(((F.col(label) == 1) & F.col("only")).cast("long")).alias("unique"))
    every = rows.sparkSession.range(patterns).select(F.col("id").cast("int").alias("pattern"))
    return every.join(c, "pattern", "left").fillna(0)


#: The constraints of a contract row: (problem, condition under which it holds).
def contract_problems() -> Column:
    c = F.col
    classes, matches = ("hijacked", "injection_ignored", "benign", "error"), ("full", "name_only", "unmatched")
    rules = [
        ("episode_id missing", c("episode_id").isNull() | (F.trim("episode_id") == "")),
        ("variant missing", c("variant").isNull() | (F.trim("variant") == "")),
        ("episode_class unknown", ~F.coalesce(c("episode_class").isin(*classes), F.lit(False))),
        ("match unknown", c("match").isNotNull() & ~c("match").isin(*matches)),
        ("match on a clean episode", (c("episode_class") == "benign") & c("match").isNotNull()),
        ("benign with injection_step", (c("episode_class") == "benign") & c("injection_step").isNotNull()),
        ("benign with first_harmful_step", (c("episode_class") == "benign") & c("first_harmful_step").isNotNull()),
        ("attacked without injection_step", c("episode_class").isin("hijacked", "injection_ignored") & c("injection_step").isNull()),
        ("unmatched with first_harmful_step", (c("match") == "unmatched") & c("first_harmful_step").isNotNull()),
        ("matched without first_harmful_step", c("match").isin("full", "name_only") & c("first_harmful_step").isNull()),
        ("ignored with first_harmful_step", (c("episode_class") == "injection_ignored") & c("first_harmful_step").isNotNull()),
        *((f"{s} negative", c(s) < 0) for s in ("injection_step", "first_harmful_step", "alarm_step", "n_steps")),
        *((f"{s} beyond n_steps", c(s) >= c("n_steps")) for s in ("injection_step", "first_harmful_step", "alarm_step")),
        ("score out of range", (c("score") < 0) | (c("score") > 1) | F.isnan("score")),
        ("threshold missing", c("alarm_step").isNotNull() & c("threshold").isNull()),
        ("alarm below threshold", c("alarm_step").isNotNull() & (c("score") < c("threshold"))),
        ("no alarm at threshold", c("alarm_step").isNull() & (c("score") >= c("threshold"))),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules)))


def validate_contract(rows: DataFrame) -> DataFrame:
    """(episode_id, variant, problem), one row a broken rule, repeated (variant, episode_id) among them."""
    n = F.count("*").over(Window.partitionBy("variant", "episode_id"))
    per = rows.withColumn("problems", contract_problems()).withColumn("problems", F.when(n > 1, F.array_append("problems", F.lit("repeated row"))).otherwise(F.col("problems")))
    return per.select("episode_id", "variant", F.explode("problems").alias("problem"))


def manifest_overlaps(manifest: DataFrame) -> DataFrame:
    """Ids that are in more than one list of (list, id)."""
    return manifest.groupBy("id").agg(F.count_distinct("list").alias("lists"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("names")).where("lists > 1")


def manifest_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def filter_cascade(checks: list[tuple[str, Column]]) -> Column:
    """The first reason that applies, null if none does."""
    out = F.lit(None).cast("string")
    for reason, bad in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(False)), reason).otherwise(out)
    return out


def paraphrase_stratum(kind: Column, jaccard: Column, banned: Column, deep: float = 0.3, low: float = 0.3, high: float = 0.5) -> Column:
    attack = kind != "benign"
    return F.when((jaccard <= deep) & ~(attack & banned), "deep").when(jaccard.between(low, high) | ((jaccard < low) & attack & banned), "shallow")


def acceptance(candidates: DataFrame, judgements: DataFrame, judges: int = 1) -> DataFrame:
    """unjudged, judge_refusal, disagree, rejected or accepted, and the mean confidence of the judges."""
    j = judgements.groupBy("cand_id").agg(F.count("*").alias("n"), F.count_if(F.col("accept").isNull()).alias("refused"), F.count_if(F.col("accept")).alias("yes"), F.round(F.avg("confidence"), 4).alias("confidence"))
    out = candidates.join(j, "cand_id", "left")
    state = F.when(F.coalesce("n", F.lit(0)) < judges, "unjudged").when(F.col("refused") > 0, "judge_refusal").when((F.col("yes") > 0) & (F.col("yes") < F.col("n")), "disagree").when(F.col("yes") == 0, "rejected").otherwise("accepted")
    return out.withColumn("outcome", state)


def usage_cost(hit: Column, miss: Column, out: Column, prices: tuple[float, float, float], peak: Column, factor: float = 2.0) -> Column:
    """Money for a call: prices per million tokens, doubled in peak hours."""
    return (hit * prices[0] + miss * prices[1] + out * prices[2]) / 1e6 * F.when(peak, factor).otherwise(1.0)


def is_peak(ts: Column, first: int = 1, last: int = 4) -> Column:
    return F.hour(ts).between(first, last - 1) & F.dayofweek(ts).between(2, 6)


def json_leaves(c: Column) -> Column:
    """(path, value) of the scalars of a JSON text, by a recursive walk in Arrow batches."""

    def walk(x, at=""):
        if isinstance(x, dict):
            return [y for k in sorted(x) for y in walk(x[k], f"{at}/{k}" if at else str(k))]
        if isinstance(x, list):
            return [y for i, v in enumerate(x) for y in walk(v, f"{at}/{i}" if at else str(i))]
        return [{"path": at, "value": None if x is None else json.dumps(x, ensure_ascii=False)}]

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else walk(json.loads(t)))

    return F.pandas_udf(run, "array<struct<path:string,value:string>>")(c)


def modal_status(rows: DataFrame, by: list[str], ranks: dict[str, int]) -> DataFrame:
    """The status that most seeds of a group have, ties to the least rank (-1 if it has none), then by name.

    ``rows``: (*by, seed, status), one row a seed.  representative: the middle seed with that status, the upper of two.
    """
    rank = F.lit(-1)
    for status, r in ranks.items():
        rank = F.when(F.col("status") == status, r).otherwise(rank)
    counts = rows.groupBy(*by, "status").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("seed")).alias("seeds"))
    best = F.min_by(F.struct("status", "n", "seeds"), F.struct(-F.col("n"), rank, "status"))
    top = counts.groupBy(*by).agg(best.alias("top"), F.sum("n").alias("n_seeds"))
    middle = F.element_at("top.seeds", F.floor(F.size("top.seeds") / 2).cast("int") + 1)
    return top.select(*by, "top.status", F.col("top.n").alias("n"), "n_seeds", middle.alias("representative"))
