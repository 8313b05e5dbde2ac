"""Hashed n-grams, windows, spans behind escapes, arguments and trace labels against plain versions."""

import hashlib
import json
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import arguments, hashing, spans
from textloom.functions import text as X
from textloom.operators import audit, features, labels, metrics, windows

TEXTS = ["Hello Wörld", "", "ab", "漢字漢字 test 😀😀x", "ÀÉ a", "abcabcabc" * 3]


@pytest.mark.parametrize(("hashed", "plain"), [(hashing.xxh64, lambda b: xxhash.xxh64_intdigest(b, seed=0)), (hashing.md5_head, lambda b: int(hashlib.md5(b).hexdigest()[:8], 16))])
def test_ngram_counts(hashed, plain):
    for t, (bins, counts) in zip(TEXTS, hashing.ngram_counts(TEXTS, (3, 4, 5), 977, hashed), strict=True):
        low = t.lower()
        want = Counter(plain(low[i : i + n].encode()) % 977 for n in (3, 4, 5) for i in range(len(low) - n + 1))
        assert dict(zip(bins.tolist(), counts.tolist(), strict=True)) == want


def test_hashed_ngrams_frame(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, "x" * 600_000, "yz " * 9])], "doc_id long, text string")
    got = features.hashed_ngrams(rows, "doc_id").groupBy("doc_id").agg(F.sum("cnt").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: sum(max(0, len(t) - n + 1) for n in (3, 4, 5)) for i, t in enumerate([*TEXTS, "", "x" * 600_000, "yz " * 9]) if len(t) > 2}


def test_windows_are_slices(spark):
    texts = ["", "a", *("é漢😀b"[i % 4] * 3 + "x" * n for i, n in enumerate((252, 253, 254, 445, 446, 997, 5000))), "\n".join("ab" * 300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["k"]): (r["start"], r["end"], r["text"]) for r in windows.build_windows(rows).collect()}
    want = {(i, k): (k * 192, min(k * 192 + 256, len(t)), t[k * 192 : k * 192 + 256]) for i, t in enumerate(texts) for k in range(max(0, -(-(len(t) - 256) // 192)) + 1)}
    assert got == want


def test_long_text_is_cut_in_one_pass(spark):
    rows = spark.range(1).selectExpr("id AS doc_id", "repeat('é', 2000000) AS text")
    assert windows.build_windows(rows).agg(F.count("*"), F.max("end")).first()[:] == (-(-(2_000_000 - 256) // 192) + 1, 2_000_000)


ALPHABET = st.sampled_from(list("ab ' \\nxu0041\n\t") + ["e\u0301", "\ufb01", "\u1112\u1161", "\u00bd", "\u0995\u09c7\u09be"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=30).map("".join))
def test_maps(text):
    out, at = spans.normal_with_map(text)
    assert out == spans.normal(text) and len(at) == len(out) and at == sorted(at)
    decoded, places = spans.decode_escapes(text)
    assert len(decoded) == len(places) and places == sorted(places)
    if "\\" not in text and "''" not in text:
        assert decoded == text and places == list(range(len(text)))


def test_escapes():
    got, at = spans.decode_escapes(r"a\nb\x41\u00e9\U0001F600\U00110000 it''s \q" + "\\\n   z")
    assert got == "a\nbAé😀" + r"\U00110000 it's \q" + "z" and at[3:6] == [4, 8, 14]


def test_spans(spark):
    rows = [("He said: Pay now. pay now", ["Pay  now", "gone"]), ("x: \"Pay\\n\\ now, don''t wait\"", ["Pay now", "don't wait"]), (None, ["a"]), ("aaa", ["aa", ""]), ("abc", None)]
    got = spark.createDataFrame(rows, "t string, n array<string>").select(spans.injection_spans(F.col("t"), F.col("n")).alias("s")).collect()
    assert [([tuple(x) for x in r["s"]["spans"]], r["s"]["mode"]) for r in got] == [([(9, 16)], "exact"), ([(4, 14), (16, 27)], "yaml_escaped"), ([], None), ([(0, 3)], "exact"), ([], None)]


def test_arguments(spark):
    assert arguments.normal_value(" HTTPS://www.Example.com// ") == "example.com" and arguments.normal_value("DE89 3704 0044 0532 0130 00") == "de89370400440532013000"
    assert arguments.items({"b": ["x", None, ["Y"]], "a": "['p', 'q']"}) == ['{"a": "[\'p\', \'q\']", "b": ["x", null, ["y"]]}', "x", "y", "p", "q"]
    assert arguments.items("[" * 500) == ["[" * 500] and arguments.items(None) == [] and arguments.items(True) == ["true"]
    deep = "v"
    for _ in range(60):
        deep = [deep]
    assert len(arguments.items(deep)) == 1
    df = spark.createDataFrame([(json.dumps(["A", "b"]),), (None,), ("{",)], "a string")
    assert [r[0] for r in df.select(arguments.argument_items(F.col("a"))).collect()] == [["a", "b"], [], []]


def test_first_harmful_call(spark):
    calls = json.dumps([{"function": "send", "alt_functions": ["mail"], "key": {"to|cc": ["a@b.com"]}, "contains": {"body": "secret"}}])
    steps = [("e", 0, "send", json.dumps({"to": "c@d.com"})), ("e", 1, "read", "{}"), ("e", 2, "Mail", json.dumps({"cc": "['A@b.com']", "body": "the Secret is"})), ("f", 0, "send", "{}"), ("g", 0, "read", "{}"), ("h", 0, "send", "{}")]
    tasks = spark.createDataFrame([(x, None if x == "h" else "i") for x in "efgh"], "task string, injection_task string")
    refs = labels.reference_calls(tasks, spark.createDataFrame([("e", calls, "own")], "task string, calls string, source string"), spark.createDataFrame([("e", "[]"), ("f", calls), ("h", calls)], "task string, calls string"))
    assert {r["task"]: r["provenance"] for r in refs.collect()} == {"e": "yaml:own", "f": "meta", "g": "missing", "h": "none"}
    got = labels.first_harmful_call(spark.createDataFrame(steps, "episode_id string, step int, function string, args string"), refs.select(F.col("task").alias("episode_id"), "calls"))
    assert {r["episode_id"]: (r["first_harmful_step"], r["match"]) for r in got.collect()} == {"e": (2, "full"), "f": (0, "name_only"), "g": (None, "unmatched"), "h": (None, None)}


def test_defended(spark):
    df = spark.createDataFrame([("gpt-x-Filter",), ("spotlight-y",), ("gpt",), (None,)], "m string")
    assert [r[0] for r in df.select(labels.is_defended(F.col("m"), ["-filter"], ["spotlight"])).collect()] == [True, True, False, False]


def test_stems_and_names(spark):
    words = ["forgetting", "bypass", "prints", "classes", "cakes", "does", "rated", "Policies", "ing", "uses"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(X.stemmed(F.col("w"))).collect()] == [X.stem(w) for w in words] == ["forgett", "bypass", "print", "class", "cake", "does", "rated", "polici", "ing", "uses"]
    assert set(X.inflected("policy")) >= {"policy", "policies", "policied", "policying"} and set(X.inflected("print")) >= {"printing", "printed", "prints", "printting"}
    assert X.inflected("the") == ["the"] and X.name_runs("Hi. Dear John Smith, (Mary Ann Lee) x.John Bo") == ["John Smith", "Mary Ann Lee", "John Bo"]


def test_modal_status_and_mean_curves(spark):
    seen = {"a": ["no", "yes", "yes", "no"], "b": ["odd", "yes"], "c": ["yes"] * 4 + ["no"]}
    ranks = {"no": 0, "yes": 2}
    rows = spark.createDataFrame([(h, 10 + i, s) for h, x in seen.items() for i, s in enumerate(x)], "h string, seed long, status string")
    got = {r["h"]: (r["status"], r["n"], r["n_seeds"], r["representative"]) for r in audit.modal_status(rows, ["h"], ranks).collect()}
    assert got == {"a": ("no", 2, 4, 13), "b": ("odd", 1, 2, 10), "c": ("yes", 4, 5, 12)}
    points = [("x", 0.1, 0.5), ("x", 0.1, 0.7), ("x", 0.1, float("nan")), ("x", 0.1 + 1e-12, 0.9), ("x", 0.2, None), ("x", float("inf"), 1.0), ("y", 0.2, 1.0)]
    curves = metrics.mean_curves(spark.createDataFrame(points, "d string, fpr double, tpr double"), ["d"])
    assert {(r["d"], r["fpr"]): (round(r["tpr"], 12), r["n"]) for r in curves.collect()} == {("x", 0.1): (0.7, 3), ("y", 0.2): (1.0, 1)}
