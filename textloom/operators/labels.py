"""Labels of traces: reference calls, first harmful step, languages by cluster, contract splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arguments import call_match
from .splits import draw


def reference_calls(tasks: DataFrame, listed: DataFrame, measured: DataFrame) -> DataFrame:
    """``tasks`` (task, injection_task, ..) with ``calls`` and ``provenance``: the list's, else the measured ones, else none.

    ``listed``: (task, calls, source); ``measured``: (task, calls).  A task without injection has null calls.
    """
    both = tasks.join(listed.select("task", F.col("calls").alias("l"), F.coalesce("source", F.lit("unknown")).alias("s")), "task", "left").join(measured.select("task", F.col("calls").alias("m")), "task", "left")
    clean = F.col("injection_task").isNull()
    return both.select(
        *tasks.columns, F.when(~clean, F.coalesce("l", "m", F.lit("[]"))).alias("calls"),
        F.when(clean, "none").when(F.col("l").isNotNull(), F.concat(F.lit("yaml:"), "s")).when(F.col("m").isNotNull(), "meta").otherwise("missing").alias("provenance"),
    )


def first_harmful_call(steps: DataFrame, references: DataFrame) -> DataFrame:
    """(episode_id, first_harmful_step, match) of (episode_id, step, function, args) and (episode_id, calls): JSON texts.

    The first full match wins even over an earlier one by name; without any the episode is unmatched; an episode whose
    calls are null (a clean one) has neither.
    """
    pairs = steps.join(references, "episode_id").withColumn("m", call_match(F.col("function"), F.col("args"), F.col("calls")))
    per = pairs.groupBy("episode_id").agg(F.min(F.when(F.col("m") == "full", F.col("step"))).alias("full"), F.min(F.when(F.col("m") == "name_only", F.col("step"))).alias("name"))
    out = references.join(per, "episode_id", "left")
    state = F.when(F.col("full").isNotNull(), "full").when(F.col("name").isNotNull(), "name_only").otherwise("unmatched")
    return out.select("episode_id", F.coalesce("full", "name").alias("first_harmful_step"), F.when(F.col("calls").isNotNull(), state).alias("match"))


def inherited_language(docs: DataFrame, inherits: Column, clean: Column) -> DataFrame:
    """``docs`` whose rows that inherit take the language of their cluster's clean document, ``unk`` without one."""
    of = docs.where(clean).groupBy("cluster_id").agg(F.min_by("lang", "doc_id").alias("of_cluster"))
    return docs.join(of, "cluster_id", "left").withColumn("lang", F.when(inherits, F.coalesce("of_cluster", F.lit("unk"))).otherwise(F.col("lang"))).drop("of_cluster")


def source_key(source: Column, variant: Column) -> Column:
    """Extended variants are a source of their own."""
    return F.when(F.coalesce(variant == "e6", F.lit(False)), F.concat(source, F.lit("_e6"))).otherwise(source)


def is_defended(model: Column, suffixes: list[str], parts: list[str]) -> Column:
    """A model name with one of the defences' suffixes, or one of their names in it."""
    name = F.lower(model)
    hits = [F.endswith(name, F.lit(s.lower())) for s in suffixes] + [F.contains(name, F.lit(p.lower())) for p in parts]
    out = F.lit(False)
    for hit in hits:
        out = out | F.coalesce(hit, F.lit(False))
    return out


def validation_tasks(tasks: DataFrame, share: float, seed: str = "val") -> DataFrame:
    """(suite, task, chosen): of each suite's distinct tasks a share by ``draw``, one at least; suites have few tasks."""
    from pyspark.sql import Window

    w = Window.partitionBy("suite")
    units = tasks.select("suite", "task").distinct()
    quota = F.greatest(F.bround(share * F.count("*").over(w)), F.lit(1 if share > 0 else 0))
    return units.withColumn("chosen", F.row_number().over(w.orderBy(draw("task", seed), "task")) <= quota)


def contract_split(test: Column, validation: Column, attack: Column, held_out: str) -> Column:
    """test, val, train or excluded: the held-out attack only tests, other attacks never meet a test task."""
    clean, own = attack.isNull(), F.coalesce(attack == held_out, F.lit(False))
    return F.when(test, F.when(clean | own, "test").otherwise("excluded")).when(own, "excluded").when(F.coalesce(validation, F.lit(False)), "val").otherwise("train")
