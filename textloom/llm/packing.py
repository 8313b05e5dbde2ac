"""Best-fit packing by minimum bin slack.

Lengths are whole numbers up to the capacity, so that all a plan needs of the corpus is one count per length: at
most ``capacity`` rows, whatever the input.  On these counts each bin is filled by a subset-sum dynamic programme
over a bitset; the fullest combination among those with the largest length left is taken off as often as the counts
allow in one step, so that the plan has a few thousand patterns.  The pieces are then numbered within their length (salted, so that no length meets in
one task) and a piece's number says which pattern, bin and place are its own.

Defined results: a null or empty text is one piece that holds the end id alone; a long text is cut whole into pieces;
repeated rows are packed once each; pieces of one length are numbered by salt, doc_id, piece, start and checksum, so
that only equal rows tie, and these may swap places; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, settle, texts, tidy
from .tokens import encoder

SLICE = 256  # texts that are encoded at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document (its ids and the end id); only longer documents are cut."""
    bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary) as enc:
            for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
                ids, limits = enc.column(batch.column(1))
                rows: list[tuple] = []
                for doc, a, b in zip(batch.column(0).to_pylist(), limits[:-1].tolist(), limits[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
                if rows:
                    cols = list(zip(*rows, strict=True))[: 6 if with_ids else 5]
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names[: len(cols)])

    return texts(docs).mapInArrow(tidy(cut), PIECES + (", ids binary" if with_ids else ""))


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths, the largest one among them, that leaves the least of a bin free."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    first = lengths[0]
    room, steps, reach = capacity - first, [], 1
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for n in lengths:
        if n > room or reach & goal:
            continue
        left, k = min(counts[n] - (n == first), room // n), 1
        while left > 0 and not reach & goal:  # 1, 2, 4, ... copies at a time reach every number of copies
            k = min(k, left)
            steps.append((reach, n, k))
            reach |= (reach << (n * k)) & mask
            left, k = left - k, 2 * k
    total, need = reach.bit_length() - 1, {first: 1}
    for before, n, k in reversed(steps):
        if not (before >> total) & 1:
            need[n] = need.get(n, 0) + k
            total -= n * k
    return need


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first number, end number, copies a bin, first bin, place in the bin) and the number of bins.

    Each step uses up what some length has for one more such bin, and a length can bind for each number of copies
    once: the steps are at most the sum of capacity/length, and a bin holds at most sqrt(2*capacity) different
    lengths, which bounds the plan (about 40 MB at 2048) however large the corpus.
    """
    left, used = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0)
    rows: list[tuple[int, ...]] = []
    bins = 0
    while left:
        need = fullest(left, capacity)
        times = min(left[n] // k for n, k in need.items())
        place = 0
        for n, k in sorted(need.items(), reverse=True):
            rows.append((n, used[n], used[n] + k * times, k, bins, place))
            used[n] += k * times
            place += n * k
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a column ``length`` of 1 to ``capacity``; ``pieces`` must be settled."""
    spark = pieces.sparkSession
    rows = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    plan, _ = plan_bins({r["length"]: r["count"] for r in rows}, capacity)
    shared = spark.sparkContext.broadcast(plan)
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "_salt").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)))
    numbered = ranked.join(before.drop("count"), ["length", "_salt"]).withColumn("_rank", F.coalesce("_before", F.lit(0)) + F.col("_nth") - 1)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        p = shared.value
        key = (p[:, 0] << 44) + p[:, 1]
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(key, (n << 44) + r, side="right") - 1
        of = r - p[at, 1]
        return pd.DataFrame({"sequence_id": p[at, 4] + of // p[at, 3], "offset": p[at, 5] + of % p[at, 3] * n})

    out = numbered.withColumn("_at", place("length", "_rank"))
    return out.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ``ids``: a group holds at most one capacity of ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    return pack(settle(cut_pieces(docs, vocabulary, capacity), "pieces"), capacity)
