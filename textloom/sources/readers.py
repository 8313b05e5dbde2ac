"""Readers with explicit schemas.  Ids come from the data's own order columns or file positions, never from arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, null_token, pattern_lines

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<function:string,args:map<string,string>,id:string>>,tool_call_id:string,error:string>"
TRACE = f"suite_name string, pipeline_name string, user_task_id string, injection_task_id string, attack_type string, injections map<string,string>, messages array<{MESSAGE}>, error string, utility boolean, security boolean, duration double"


def file_order() -> list[Column]:
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def labelled_parquet(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """text and label only, the other columns are not read; ids number the rows of each file."""
    rows = spark.read.parquet(path).select("text", F.col("label").cast("tinyint").alias("label"), F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    return rows.select(F.concat_ws(":", F.lit(prefix), "i").alias("doc_id"), "text", "label")


def json_arrays(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Files that hold one JSON array each, by subset name."""
    frames = [spark.read.schema(schema).option("multiLine", True).json(p).withColumn("subset", F.lit(n)) for n, p in paths.items()]
    return reduce(DataFrame.unionByName, frames)


def strings_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """All columns as strings, empty cells as empty strings; a missing column is an error."""
    df = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.fillna("")


def contexts_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``context`` as text or as a list of lines, folded by its normalised text: first row, raw text and count."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).where(F.trim("value") != "")
    v = F.try_parse_json("value")
    lines = F.try_variant_get(v, "$.context", "array<string>")
    text = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.context", "variant")).startswith("ARRAY"), F.concat_ws("\n", lines)), F.try_variant_get(v, "$.context", "string"))
    rows = raw.select(text.alias("context"), "i").withColumn("norm", collapse(F.col("context")))
    return rows.groupBy("norm").agg(F.min("i").alias("first"), F.min_by("context", "i").alias("context"), F.count("*").alias("n"))


def attacks_json(spark: SparkSession, path: str) -> DataFrame:
    """An object of lists: (name, k, text)."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("name", "list")).select("name", F.posexplode("list").alias("k", "text"))


def traces(spark: SparkSession, root: str, depth: int = 4) -> DataFrame:
    """Log files at a fixed depth below ``root``, none of those under injection_task_* folders; 'none' is null."""
    df = spark.read.schema(TRACE).option("multiLine", True).option("recursiveFileLookup", True).json(root).withColumn("path", F.col("_metadata.file_path"))
    inside = F.split(F.regexp_replace("path", "^.*?" + root.rstrip("/").split("/")[-1] + "/", ""), "/")
    df = df.where((F.size(inside) == depth + 1) & ~F.col("path").rlike("/injection_task_[^/]*/"))
    missing = F.col("suite_name").isNull() | F.col("messages").isNull()
    checked = F.when(missing, F.raise_error(F.concat(F.lit("not a trace log: "), "path")).cast("string")).otherwise(F.col("suite_name"))
    return df.withColumn("suite_name", checked).withColumns({c: null_token(F.col(c)) for c in ("injection_task_id", "attack_type")}).withColumn("episode_id", F.concat_ws("/", "pipeline_name", "suite_name", "user_task_id", F.coalesce("attack_type", F.lit("none")), F.coalesce("injection_task_id", F.lit("none"))))


def merged_sources(rows: DataFrame) -> DataFrame:
    """Texts of several tagged sets, folded by normalised text with their tags and labels."""
    return rows.withColumn("norm", collapse(F.col("text"))).groupBy("norm").agg(F.array_sort(F.collect_set("source")).alias("tags"), F.max("label").alias("label"), F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pattern_file(spark: SparkSession, path: str) -> list[str]:
    """A short list of patterns: on the driver."""
    return pattern_lines([r["value"] for r in spark.read.text(path).collect()])


def content_text(content: Column) -> Column:
    """Message content as JSON text: a string, a list of blocks with text, or an object."""
    v = F.try_parse_json(content)
    blocks = F.transform(F.try_variant_get(v, "$", "array<struct<type:string,text:string,content:string>>"), lambda b: F.coalesce(b["text"], b["content"]))
    return F.coalesce(F.when(F.substring(F.ltrim(content), 1, 1) == "[", F.concat_ws("\n", blocks)), F.try_variant_get(v, "$.content", "string"), F.try_variant_get(v, "$.text", "string"), content)


def episode_parts(c: Column) -> Column:
    p = F.split(c, "/")
    return F.struct(*(F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("pipeline", "suite", "user_task", "attack", "injection_task"))))


def step_of(doc_id: Column) -> Column:
    """(episode, step) of an id that ends in #step."""
    return F.struct(F.regexp_extract(doc_id, r"^(.*)#\d+$", 1).alias("episode_id"), F.regexp_extract(doc_id, r"#(\d+)$", 1).cast("int").alias("step"))
