"""Token ids in Simple-8b segments.

A segment is one self-contained blob: a header, a table of its documents, a table with the first word of each
block of 1,024 ids, then 64-bit words.  The top four bits of a word select how many ids it packs and at what
width; selector 0 is the escape, whose id of more than 60 bits fills the following word.  Blocks start at a word,
so that any of them is decoded alone, and whole segments are decoded selector by selector in numpy.

The blobs are rows of Parquet files that Spark's own committer writes, in ascending doc_id order: a lost executor
leaves no half file.  Defined results: a null or empty text is the end id alone; repeated rows are kept, ordered
by their ids; an empty table gives no file rows; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, texts, tidy
from .tokens import encoder

#: Simple-8b: ids a word, and bits an id, by selector (fixed values of the format; 0 is this file's escape).
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
NO_ID = -(1 << 63)  # stands for a null doc_id
MAGIC = b"TLS8"


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block).  All blocks advance together, a word a step."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = ids
    size = np.full(blocks, BLOCK)
    if blocks:
        size[-1] = n - (blocks - 1) * BLOCK
    limits = (np.uint64(1) << WIDTHS[1:].astype(np.uint64)) - np.uint64(1)
    kind = np.searchsorted(limits, padded, side="left").astype(np.int8) + 1  # 15: needs the escape
    wide = np.ones((blocks, BLOCK + 60), dtype=np.int8)  # what follows a block fits anywhere
    wide[:, :BLOCK] = kind.reshape(blocks, BLOCK) if blocks else 1
    at, taken = np.zeros(blocks, dtype=np.int64), []
    live = np.arange(blocks)
    while len(live):
        begin = at[live]
        most = wide[live, begin]
        choice = np.where(most > 14, 0, 14)
        held = 1
        for s in range(13, 0, -1):  # more ids a word at fewer bits, until no block has a run that fits
            for j in range(held, COUNTS[s]):
                most = np.maximum(most, wide[live, begin + j])
            held = COUNTS[s]
            fits = most <= s
            if not fits.any():
                break
            choice[fits] = s
        taken.append((live, begin, choice))
        at[live] += COUNTS[choice]
        live = live[at[live] < size[live]]
    if not taken:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    row, col, sel = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.lexsort((col, row))
    row, col, sel = row[order], col[order], sel[order]
    room = 1 + (sel == 0)
    first = np.cumsum(room) - room
    words = np.zeros(int(room.sum()), dtype=np.uint64)
    flat = np.concatenate([padded, np.zeros(64, np.uint64)])
    # ids beyond the block's own must not leak into its last word
    for s in range(15):
        m = np.flatnonzero(sel == s)
        if not len(m):
            continue
        pos = row[m] * BLOCK + col[m]
        if s == 0:
            words[first[m] + 1] = flat[pos]
            continue
        j = np.arange(COUNTS[s])
        got = flat[pos[:, None] + j]
        got[col[m][:, None] + j >= BLOCK] = 0
        words[first[m]] = np.bitwise_or.reduce(got << (j * WIDTHS[s]).astype(np.uint64), axis=1) | np.uint64(s << 60)
    starts = first[np.flatnonzero(np.r_[True, row[1:] != row[:-1]])]
    return words, starts.astype(np.uint32)


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of whole words, those that pad a last word among them."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == 0):  # a raw word may look like any selector; escapes are rare
        if not raw[i]:
            raw[i + 1] = True
    head = np.flatnonzero(~raw)
    s = sel[head]
    count = COUNTS[s]
    to = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for k in np.unique(s):
        m = np.flatnonzero(s == k)
        if k == 0:
            out[to[m]] = words[head[m] + 1]
            continue
        j = np.arange(COUNTS[k])
        mask = (np.uint64(1) << np.uint64(WIDTHS[k])) - np.uint64(1)
        out[to[m][:, None] + j] = (words[head[m]][:, None] >> (j * WIDTHS[k]).astype(np.uint64)) & mask
    return out


def decode_blocks(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` ids from consecutive blocks; only a block's last word may hold padding, which is cut off."""
    if not n:
        return np.zeros(0, np.uint64)
    every = decode_words(words)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[np.minimum(sel, 14)].copy()
    for i in np.flatnonzero(sel == 0):
        if count[i]:
            count[i], count[i + 1] = 1, 0
    begin = np.r_[0, np.cumsum(count)][starts.astype(np.int64)]
    size = np.full(len(starts), BLOCK)
    size[-1] = n - BLOCK * (len(starts) - 1)
    shift = np.repeat(begin - (np.cumsum(size) - size), size)
    return every[np.arange(n) + shift]


def write_segment(docs: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    words, starts = encode_blocks(ids)
    head = struct.pack("<4sIQQQ", MAGIC, len(docs), len(ids), len(starts), len(words))
    return head + np.array(docs, "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + starts.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def read_segment(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(doc ids, lengths, block starts, words, number of ids)."""
    magic, docs, n, blocks, words = struct.unpack_from("<4sIQQQ", blob)
    if magic != MAGIC:
        raise ValueError("not a segment")
    at = 32
    parts = []
    for kind, k in (("<i8", docs), ("<u8", docs), ("<u4", blocks), ("<u8", words)):
        parts.append(np.frombuffer(blob, kind, k, at))
        at += parts[-1].nbytes
    return (*parts, n)


def read_document(blob: bytes, nth: int) -> np.ndarray:
    """One document of a segment: only the blocks that hold it are decoded."""
    _, lengths, starts, words, n = read_segment(blob)
    begin = int(lengths[:nth].sum())
    end = begin + int(lengths[nth])
    if begin == end:
        return np.zeros(0, np.uint64)
    b0, b1 = begin // BLOCK, -(-end // BLOCK)
    w0, w1 = int(starts[b0]), int(starts[b1]) if b1 < len(starts) else len(words)
    got = decode_blocks(words[w0:w1], starts[b0:b1] - starts[b0], min(n, b1 * BLOCK) - b0 * BLOCK)
    return got[begin - b0 * BLOCK : end - b0 * BLOCK]


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """(doc_id, part, ids): the text's ids and the end id, a leading byte 2 or 4 telling the bytes an id takes.

    Parts are ranges of ascending ids.  Their limits come from one pass over the id column alone, so that no text is
    encoded twice, as a range exchange on the encoded rows, which samples them first, would do.
    """
    bound_batches(docs.sparkSession)
    rows = texts(docs)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limits = np.unique(np.array(rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts), dtype=np.float64)) if parts > 1 else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(vocabulary) as enc:
            for batch in batches:
                ids, bounds = enc.column(batch.column(1))
                out = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id))
                    out.append(b"\x02" + own.astype("<u2").tobytes() if own.max() < 65536 else b"\x04" + own.astype("<u4").tobytes())
                part = np.searchsorted(limits, batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), side="right")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part.astype(np.int32)), pa.array(out, pa.binary())], ["doc_id", "part", "ids"])

    return rows.mapInArrow(tidy(run), "doc_id long, part int, ids binary")


def write_segments(encoded: DataFrame, path: str, most_ids: int = 1 << 19, most_docs: int = 1 << 14) -> None:
    """Ascending doc_id order: part, segment, ids before it in its part, first document, documents, ids, blob."""
    spark = encoded.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = encoded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        held: list[np.ndarray] = []
        total = segment = before = part = 0

        def flush() -> pa.RecordBatch:
            blob = write_segment(docs, [len(x) for x in held], np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (segment, pa.int64()), (before, pa.int64()), (docs[0], pa.int64()), (len(docs), pa.int64()), (total, pa.int64()), (blob, pa.binary()))],
                ["part", "segment", "before", "first_doc", "n_docs", "n_ids", "blob"],
            )

        for batch in batches:
            for doc, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and at != part:
                    yield flush()
                    before = segment = total = 0
                    docs, held = [], []
                part = at
                row = np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1)
                if docs and (total + len(row) > most_ids or len(docs) >= most_docs):
                    yield flush()
                    before, segment = before + total, segment + 1
                    docs, held, total = [], [], 0
                docs.append(NO_ID if doc is None else doc)
                held.append(row)
                total += len(row)
        if docs:
            yield flush()

    ordered.select("doc_id", "ids", "part").mapInArrow(tidy(run), "part int, segment long, before long, first_doc long, n_docs long, n_ids long, blob binary").write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from the files alone."""
    stored = spark.read.schema("part int, segment long, before long, first_doc long, n_docs long, n_ids long, blob binary").parquet(path)
    # one row a part; a part is a task of the writer, so that this table is no larger than a job's task list
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, lengths, starts, words, n = read_segment(blob)
                ids = decode_blocks(words, starts, n).astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                begin = ends - lengths.astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == NO_ID), pa.array(np.full(len(docs), part, np.int32)), pa.array(begin + before), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"]
                )

    rows = stored.select("part", "before", "blob").mapInArrow(tidy(run), "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(parts.select("part", "base")), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
