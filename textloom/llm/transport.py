"""Media columns: MPEG transport streams.

``mux`` stores 8-bit samples losslessly as a transport stream: a program association table, a program map table,
then packetised elementary packets (PES) of up to ``FRAME`` samples with a presentation time stamp each; every
``POINT``-th of them is a random-access point with the indicator and a clock reference.  ``demux`` trusts nothing
of the writer: it checks sync bytes, parses both tables and their checksums, follows the program to its stream,
checks the continuity counters, reassembles the PES packets and returns samples, time stamps and access points.

Defined results: a null or empty text is 64 zero samples; equal texts give equal bytes; repeated rows are stored
once each; an empty table gives an empty one; further columns are not read.  A damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, texts, tidy

#: Fixed values of the container format and of this writer's program.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_DATA, PRIVATE_STREAM_1 = 0x06, 0xBD
CLOCK = 90_000

RATE = 9_000  # samples a second: a sample is ten ticks of the clock, so that times are exact
TICKS = CLOCK // RATE
FRAME, POINT = 8_192, 4


@lru_cache(maxsize=64)
def section_checksum(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table, 0xB0 | length >> 8, length & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + section_checksum(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
    pid = bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF])
    pmt = _section(0x02, PROGRAM, pid + b"\xf0\x00" + bytes([PRIVATE_DATA]) + pid + b"\xf0\x00")
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _stamp(t: int) -> bytes:
    """33 bits of a time stamp with its marker bits."""
    return bytes([0x21 | (t >> 30 & 7) << 1, t >> 22 & 0xFF, 1 | (t >> 15 & 0x7F) << 1, t >> 7 & 0xFF, 1 | (t & 0x7F) << 1])


def _clock(t: int) -> bytes:
    """A clock reference: 33 bits of 90 kHz, six reserved bits, nine bits of 27 MHz (0)."""
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def mux(samples: bytes) -> bytes:
    """The transport stream of one elementary stream of 8-bit samples."""
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(samples), FRAME)):
        part = samples[at : at + FRAME]
        time = at * TICKS % (1 << 33)
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (8 + len(part)).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(time) + part
        adapt = b"\x07\x50" + _clock(time) if k % POINT == 0 else b""
        first = PACKET - 4 - len(adapt)
        n = 1 + max(0, -(-(len(data) - first) // (PACKET - 4)))
        rows = np.full((n, PACKET), 0xFF, dtype=np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
        rows[0, 1] |= 0x40
        rows[:, 3] = 0x10 | (counter + np.arange(n)) & 0x0F
        counter += n
        flat = np.frombuffer(data, dtype=np.uint8)
        if n > 2:
            rows[1:-1, 4:] = flat[first : first + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
        if n > 1:
            rows[0, PACKET - first :] = flat[:first]
        if adapt:
            rows[0, 3] |= 0x20
            rows[0, 4 : 4 + len(adapt)] = np.frombuffer(adapt, dtype=np.uint8)
        begin = first + (n - 2) * (PACKET - 4) if n > 1 else 0
        tail = flat[begin:]
        free = (PACKET - 4 if n > 1 else first) - len(tail)
        if free:  # stuffing: bytes of 0xFF in the last packet's adaptation field
            held = len(adapt) if n == 1 else 0
            rows[-1, 3] |= 0x20
            rows[-1, 4] = held + free - 1
            if not held and free > 1:
                rows[-1, 5] = 0
        rows[-1, PACKET - len(tail) :] = tail
        out.append(rows.tobytes())
    return b"".join(out)


def _read_section(packet: bytes, table: int) -> bytes:
    at = 5 + packet[4]
    length = (packet[at + 1] & 0x0F) << 8 | packet[at + 2]
    section = packet[at : at + 3 + length]
    if section[0] != table or section_checksum(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("damaged table")
    return section


def demux(stream: bytes) -> dict:
    """Samples, time stamps and random-access points (packet number, time) of the first program's first stream."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole packets")
    rows = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]

    def table(pid: int, number: int) -> bytes:
        at = np.flatnonzero(pids == pid)
        if not len(at):
            raise ValueError("a table is missing")
        return _read_section(rows[at[0]].tobytes(), number)

    pat = table(PAT_PID, 0x00)
    programs = {int.from_bytes(pat[i : i + 2], "big"): (pat[i + 2] & 0x1F) << 8 | pat[i + 3] for i in range(8, len(pat) - 4, 4)}
    program = min(k for k in programs if k)
    pmt = table(programs[program], 0x02)
    streams, at = {}, 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    while at < len(pmt) - 4:
        streams[(pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]] = pmt[at]
        at += 5 + ((pmt[at + 3] & 0x0F) << 8 | pmt[at + 4])
    pid = next(iter(streams))
    mine = np.flatnonzero(pids == pid)
    own = rows[mine]
    flags = own[:, 3]
    loaded = (flags & 0x10) > 0
    counter = (flags & 0x0F).astype(np.int16)[loaded]
    if ((np.diff(counter) - 1) % 16).any():
        raise ValueError("a continuity counter jumps: packets are lost")
    adapted = (flags & 0x20) > 0
    skip = 4 + np.where(adapted, own[:, 4].astype(np.int16) + 1, 0)
    marked = adapted & (own[:, 4] > 0) & ((own[:, 5] & 0x40) > 0)
    keep = np.where(loaded, PACKET - skip, 0)
    data = own[np.arange(PACKET) >= np.where(loaded, skip, PACKET)[:, None]].tobytes()
    begins = np.cumsum(keep) - keep
    starts = np.flatnonzero((own[:, 1] & 0x40) > 0)
    parts, times, points = [], [], []
    for s, b, e in zip(starts.tolist(), begins[starts].tolist(), [*begins[starts][1:].tolist(), len(data)], strict=True):
        if data[b : b + 3] != b"\x00\x00\x01":
            raise ValueError("a packet without its start code")
        length, head = int.from_bytes(data[b + 4 : b + 6], "big"), 9 + data[b + 8]
        if e - b != 6 + length:
            raise ValueError("a packet of another length than stated")
        p = data[b + 9 : b + 14]
        times.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        if marked[s]:
            points.append((int(mine[s]), times[-1]))
        parts.append(data[b + head : e])
    return {"program": program, "pid": pid, "kind": streams[pid], "samples": b"".join(parts), "times": times, "points": points, "packets": len(rows)}


def seek(stream: bytes, time: int) -> int:
    """Number of the packet to start reading at for ``time``: the last access point that isn't after it."""
    return max((p for p, t in demux(stream)["points"] if t <= time), default=0)


def feature(got: dict) -> str:
    """What a catalogue keeps of a stream: layout, times, access points, and level, crossings and spread of the samples."""
    x = np.frombuffer(got["samples"], dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    mean = int((counts * np.arange(256)).sum()) * 1000 // len(x)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    places = "/".join(f"{p}@{t}" for p, t in got["points"])
    return f"program={got['program']};pid={got['pid']};kind={got['kind']};packets={got['packets']};pes={len(got['times'])};pts={got['times'][0]}-{got['times'][-1]};raps={places};mean={mean};peak={int(counts.argmax())};levels={int((counts > 0).sum())};crossings={crossings}"


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def write_media(docs: DataFrame, path: str) -> None:
    """A Parquet media table: doc_id, n_bytes, media (the transport stream), times and random-access points of each."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, streams, times, points = [], [], [], []
            for text in batch.column(1).to_pylist():
                samples = payload(text)
                sizes.append(len(text.encode()))
                streams.append(mux(samples))
                frames = range(0, len(samples), FRAME)
                times.append([at * TICKS % (1 << 33) for at in frames])
                points.append(times[-1][::POINT])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(streams, pa.binary()), pa.array(times, pa.list_(pa.int64())), pa.array(points, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "media", "times", "access_times"],
            )

    rows = texts(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary, times array<long>, access_times array<long>")
    rows.write.option("compression", "zstd").parquet(path)


def read_media(spark: SparkSession, path: str, with_samples: bool = False) -> DataFrame:
    """Parses the stored streams; digests and features are of what was read, and its times must be the table's."""
    bound_batches(spark)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points", "samples"]
    names = names if with_samples else names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, size, media, times, access in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = demux(media)
                if got["times"] != times or [t for _, t in got["points"]] != access:
                    raise ValueError("the stream's times are not the table's")
                x = got["samples"]
                out.append((doc, size, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(got), len(access), x))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                cols = list(zip(*out, strict=True))[: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_points long"
    stored = spark.read.schema("doc_id long, n_bytes long, media binary, times array<long>, access_times array<long>").parquet(path)
    return stored.mapInArrow(tidy(run), schema + (", samples binary" if with_samples else ""))
