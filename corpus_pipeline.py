"""A corpus pipeline of five of the training-data operators: see STAGES.

Each stage works on what its predecessor kept and returns the columns of documents; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import contamination, neardup, packing, templates, toxicity
from textloom.llm.common import new_path
from textloom.llm.tokens import vocabulary_path

TOXIC = 0.7  # a document of this score or more goes


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, trained on all labelled documents that are in ``docs``: documents it rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.keep_clean(docs, model, TOXIC)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: recurring lines go, and documents of which nothing else is left."""
    left = templates.drop_templates(docs)
    blank = (F.col("_dropped") > 0) & ~F.col("text").rlike(r"(?U)\S")
    return left.where(~F.coalesce(blank, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 on five words at 0.8: of each group of near copies the document with the smallest id stays."""
    return neardup.keep_one(docs, words=5, percent=80, each=2).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a confirmed passage of a test item go."""
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: what is left, in sequences of 2,048 ids."""
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_recurring_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: The stages train a model, hash and tokenize: SQL can't express them; test_pipeline in tests/llm/test_dedup.py checks them, near-dedup by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
