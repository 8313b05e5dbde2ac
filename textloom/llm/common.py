"""What the training-data operators share: the shared folder, bounded Arrow batches, null-safe input columns, bounded label samples."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (a test) gets a temporary folder, removed at exit; a cluster must name one.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _own:
        _own[spark.sparkContext.applicationId] = path = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _own[spark.sparkContext.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it: the lineage ends there, and no stage above runs twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["settled_at"] = path
    return out


def forget(*settled: DataFrame) -> None:
    """Deletes settled tables that no unsettled frame reads any more."""
    for df in settled:
        if path := df.__dict__.pop("settled_at", None):
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end at ``BATCH_BYTES`` (one row at least), however long the texts are.

    Spark has no such setting for one query; the value is the same for all operators, so that their order doesn't
    matter, and a session that has set a smaller one keeps it.
    """
    held = spark.conf.get(_BATCH_CONF).rstrip("bB")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker, which lives on for other tasks, gives freed memory back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return tidied


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(mod: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string")) % mod


def label_sample(rows: DataFrame, most: int, most_chars: int = 1 << 26) -> DataFrame:
    """About ``most`` of ``rows`` and ``most_chars`` of their texts, by hashes: every run and partitioning takes the same.

    A count fixes a limit on the id's hash, which Spark applies on both sides of a join by id, before any text moves;
    a second limit, on the hash of all columns, is for long texts and for many rows of one id.  Equal rows count once.
    """
    n = rows.count()
    limit = F.lit(1 << 30)
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), limit) < int(most / n * (1 << 30)))
    rows = settle(rows.dropDuplicates(), "sample")
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    share = min(1.0, 2 * most / max(1, n), most_chars / max(1, chars or 0))
    return rows if share == 1 else rows.where(F.pmod(F.xxhash64(*rows.columns), limit) < int(share * (1 << 30)))
