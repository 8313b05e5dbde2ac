"""Operators 1, 4 and 5: exact against the library, brute force and round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import binary, packing, transport
from textloom.llm.tokens import encoder, vocabulary_path

PATH = vocabulary_path()


def library(text):
    with encoder(PATH) as enc:
        return np.array(enc.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def fast(texts):
    with encoder(PATH) as enc:
        ids, limits = enc.column(pa.array(texts, pa.string()))
    return [ids[a:b].astype("<u4").tobytes() for a, b in zip(limits[:-1], limits[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abzAZ'stdrevml09 .,!?\t\n\r\x1c\x85\xa0ßµª²½×÷éÉüñÇİΣσς漢😀é<|>endoftext")), max_size=40), max_size=5))
def test_encoder_is_the_library(texts):
    assert fast(texts) == [library(t) for t in texts]


def test_encoder_with_special_tokens():
    texts = ["", "a <|endoftext|> b", "x" * 5000, "<|startoftext|>", " ", "it's ΣΑΣ e\u0301 \u0301x don't"]
    assert fast(texts) == [library(t) for t in texts] and fast([]) == []


def test_encoder_on_real_texts(spark):
    rows = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert fast(rows) == [library(t) for t in rows]


def test_caches_go_with_the_task():
    with encoder(PATH) as enc:
        enc.column(pa.array(["some words here"]))
        assert enc.words and enc.pieces
    assert not enc.words and not enc.pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_plan_fills_each_bin_once(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows, bins = packing.plan_bins(counts, 64)
    held = [[] for _ in range(bins)]
    for n, first, end, copies, base, place in rows.tolist():
        assert (end - first) % copies == 0
        for r in range(end - first):
            held[base + r // copies].append((place + r % copies * n, n))
    assert sorted(n for b in held for _, n in b) == sorted(lengths)
    for b in held:
        at = 0
        for place, n in sorted(b):
            assert place == at
            at += n
        assert at <= 64
    assert bins <= -(-sum(lengths) // 64) * 1.5 + 1


def test_fullest_is_the_best_subset():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(50):
        items = rng.integers(1, 30, 7).tolist()
        got = packing.fullest({n: items.count(n) for n in items}, 40)
        best = max(sum(c) for k in range(8) for c in itertools.combinations(sorted(items, reverse=True), k) if sum(c) <= 40 and max(items) in c)
        assert sum(n * k for n, k in got.items()) == best


def test_packing(spark, odd, none):
    got = packing.pack_documents(odd, PATH).toPandas()
    want = []
    for r in odd.collect():
        ids = library(r["text"] or "") + bytes(4)
        want += [(r["doc_id"], k, a // 4, len(p) // 4, zlib.crc32(p)) for k, a in enumerate(range(0, len(ids), 8192)) for p in [ids[a : a + 8192]]]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    for _, b in got.sort_values("offset").groupby("sequence_id"):
        assert b["offset"].tolist() == np.r_[0, b["length"].cumsum()[:-1]].tolist() and b["length"].sum() <= 2048
    assert packing.pack_documents(none, PATH).count() == 0


def test_sequences_hold_the_ids(spark, odd):
    pieces = packing.cut_pieces(odd.where("doc_id <> 4"), PATH, with_ids=True)
    packed = packing.pack(spark.createDataFrame(pieces.collect(), pieces.schema))
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == sum(len(r["ids"]) for r in packed.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    x = np.array(ids, dtype=np.uint64)
    words, starts = binary.encode_blocks(x)
    assert (binary.decode_blocks(words, starts, len(x)) == x).all()
    if len(x) > 2:
        blob = binary.write_segment([1, 2, 3], [1, 0, len(x) - 1], x)
        assert (binary.read_document(blob, 0) == x[:1]).all() and not len(binary.read_document(blob, 1)) and (binary.read_document(blob, 2) == x[1:]).all()


def test_segments(spark, odd, none, tmp_path):
    for k, df in enumerate((odd, none)):
        path = str(tmp_path / str(k))
        binary.write_segments(binary.encode_documents(df, PATH), path, most_ids=5000, most_docs=3)
        got = [tuple(r) for r in binary.read_segments(spark, path).orderBy("start").collect()]
        want, at = [], 0
        for d, ids in sorted((r["doc_id"], library(r["text"] or "") + b"\1\0\0\0") for r in df.collect()):
            want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
            at += len(ids) // 4
        assert got == want


@pytest.mark.parametrize("n", [64, 128, *range(150, 200), 368, 8192, 8256, 8192 * 9 + 192])
def test_stream_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    got = transport.demux(transport.mux(data))
    assert got["samples"] == data and got["times"] == [k * 8192 * 10 for k in range(-(-n // 8192))]
    assert [t for _, t in got["points"]] == got["times"][::4]


def test_damage_is_noticed():
    s = bytearray(transport.mux(bytes(20_000)))
    for broken in (s[: 188 * 5] + s[188 * 6 :], s[:-1], s[188:]):
        with pytest.raises(ValueError):
            transport.demux(bytes(broken))
    s[188 * 3] = 0
    with pytest.raises(ValueError):
        transport.demux(bytes(s))


def test_seek_and_checksum():
    s = transport.mux(bytes(8192 * 9))
    points = transport.demux(s)["points"]
    assert transport.seek(s, points[1][1] + 5) == points[1][0]
    assert transport.section_checksum(b"123456789") == 0x0376E6E7


def test_media(spark, odd, none, tmp_path):
    transport.write_media(odd, str(tmp_path / "m"))
    got = transport.read_media(spark, str(tmp_path / "m"), with_samples=True).collect()
    assert sorted((r["doc_id"], bytes(r["samples"])) for r in got) == sorted((r["doc_id"], transport.payload(r["text"] or "")) for r in odd.collect())
    transport.write_media(none, str(tmp_path / "e"))
    assert transport.read_media(spark, str(tmp_path / "e")).count() == 0


def test_caches_of_the_encoder_are_small(monkeypatch):
    """A corpus of many different words leaves its Python worker small, and a full cache changes no id."""
    import sys

    import pyarrow as pa
    from textloom.llm import tokens

    enc = tokens.Encoder(tokens.vocabulary_path())
    words = [f"{chr(97 + i % 26)}{i * 7919 % 250_007:x}q{chr(97 + i % 23)}" for i in range(150_000)]
    for a in range(0, len(words), 10_000):
        enc.column(pa.array([" ".join(words[a : a + 10_000])]))
    held = sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (enc.words, enc.pieces))
    assert held < 20 << 20
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    monkeypatch.setattr(tokens, "MOST_PIECES", 5)
    text = " ".join(words[-50:]) + " the cat's 12 hats, déjà-vu"
    full = tokens.Encoder(tokens.vocabulary_path())
    assert [full.encode(text), enc.encode(text)] == [enc._library(text)] * 2
