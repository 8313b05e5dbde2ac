"""Writers: typed Parquet, JSON lines, the contract CSV, append-only caches, keyed results, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTRACT = (
    "episode_id", "variant", "benchmark", "suite", "user_task", "injection_task", "attack", "model", "episode_class", "match",
    "injection_step", "first_harmful_step", "alarm_step", "score", "threshold", "n_steps",
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; missing ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def write_table(df: DataFrame, path: str, schema: T.StructType | None = None, by: list[str] | None = None) -> None:
    """zstd Parquet; Spark's commit makes the replacement whole or not at all."""
    w = (conform(df, schema) if schema else df).write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def meta_json(df: DataFrame, column: str = "meta") -> DataFrame:
    """A map column as JSON with sorted keys."""
    return df.withColumn(f"{column}_json", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))).drop(column)


def append_new(df: DataFrame, path: str, key: str, spark: SparkSession) -> int:
    """Rows whose key the cache lacks, the first of each key; an earlier value always stays."""
    from pyspark.errors import AnalysisException

    new = df.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = new.persist()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def write_contract(df: DataFrame, path: str) -> None:
    """One CSV with empty cells for missing values; the table is one row an episode of an evaluation."""
    conform(df, T.StructType([T.StructField(c, T.StringType()) for c in CONTRACT])).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("nullValue", "").csv(path)
    whole = {c: F.col(c).try_cast("double").cast("long") for c in ("injection_step", "first_harmful_step", "alarm_step", "n_steps")}
    return df.withColumns(whole | {c: F.col(c).try_cast("double") for c in ("score", "threshold")})


def write_results(df: DataFrame, path: str) -> None:
    """(experiment, seed, key, value, ...) partitioned by experiment and seed."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "seed").parquet(path)


def freeze(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_frozen(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """Files that changed, went or came."""
    j = frozen.select("path", F.col("sha256").alias("was")).join(now.select("path", "sha256"), "path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("sha256"), "changed")
    return j.withColumn("state", state).where("state is not null").select("path", "state")
