"""The queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, contamination, language, neardup, packing, pseudonyms, quality, templates, toxicity, transport
from .common import new_path, remainder
from .tokens import vocabulary_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "segments")
    binary.write_segments(binary.encode_documents(documents(spark, sf_dir), vocabulary_path()), path)
    return binary.read_segments(spark, path)


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), pseudonyms.key_of(spark))
    return out.select("doc_id", *(F.col(f"_found.{k}").alias(f"n_{k}") for k in pseudonyms.KINDS), "text")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return documents(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id")


def op3_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), remainder(4) == 2
    return language.identify(docs, language.train(docs.where(~held)), held)


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    transport.write_media(documents(spark, sf_dir), path)
    return transport.read_media(spark, path)


def op6_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(3) == 1
    return toxicity.score(documents(spark, sf_dir), toxicity.train(labelled(spark, sf_dir).where(~held)), held)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.drop_templates(documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.length(text).cast("long").alias("kept_chars"), F.crc32(text.cast("binary")).alias("kept_crc32"))


def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=3, percent=85, each=3)


def op10_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), remainder(5) == 0
    vectors = quality.word_vectors(docs)
    return quality.score(docs, vectors, quality.train(labelled(spark, sf_dir).where(~held), vectors), held)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_feistel_pseudonyms, op3_byte_cnn_language, op4_transport_streams, op5_simple8b_tokens, op6_wand_decontamination, op7_noisy_or_toxicity, op8_line_templates, op9_tensored_minhash, op10_random_indexing_quality)}
ORACLE_SQL: dict[str, str] = {}
