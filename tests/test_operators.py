"""Small fixtures against the definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import plans, settings
from textloom.functions import text as X
from textloom.operators import audit, dedup, features, graph, metrics, models, splits, stats, windows
from textloom.plans import evaluation
from textloom.sources import readers, writers
from textloom.streaming import streams


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def out(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_window_counts(spark):
    sizes = [0, 1, 255, 256, 257, 448, 449, 1000]
    got = out(col(spark, ["x" * n for n in sizes]), F.size(windows.window_bounds(F.col("c"))))
    assert got == [1, 1, 1, 1, 2, 2, 3, 5]


def test_window_label(spark):
    spans = [[(0, 20)], [(192, 256)], [(193, 256)], [(250, 400)], [(7, 7)], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "i int, s array<struct<start:int,end:int>>")
    got = out(df, windows.window_label(F.lit(9), F.col("s"), F.lit(0), F.lit(256)))
    assert got == [1, 1, 1, 0, 0, 9]  # a span shorter than 64 must be inside; 6 of 150 characters are too few
    assert out(df, windows.window_label(F.lit(9), F.col("s"), F.lit(192), F.lit(448)))[3] == 1


def test_shingles_and_sets(spark):
    df = col(spark, ["", "abc", "abcde", "abcdef", "aaaaaaa", "a😀bcdé"])
    assert [sorted(x) for x in out(df, X.shingles(F.col("c"), 5))] == [[], ["abc"], ["abcde"], ["abcde", "bcdef"], ["aaaaa"], ["a😀bcd", "😀bcdé"]]
    e = F.array().cast("array<string>")
    one = spark.range(1)
    assert one.select(X.jaccard(e, e), X.containment(e, F.array(F.lit("a"))), X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))).first()[:] == (0.0, 0.0, 0.5)


def test_text_functions(spark):
    df = col(spark, ["  a\t b\n", None, "ﬁ ①"])
    assert out(df, X.normalize(F.col("c"))) == ["a b", "", "fi 1"]
    assert out(col(spark, ["Hi. There! ok", "no end", "end. "]), X.sentence_starts(F.col("c"))) == [[0, 4, 11], [0], [0]]
    assert out(col(spark, ["banana", "", None]), X.occurrences(F.col("c"), "ana")) == [[1, 3], [], []]
    assert out(col(spark, ["A b--C!", "__x__"]), X.slug(F.col("c"))) == ["a_b_c", "x"]
    spans = spark.createDataFrame([(0, [(5, 6), (0, 2), (2, 4)])], "i int, c array<struct<start:int,end:int>>")
    assert [tuple(s) for s in out(spans, X.merge_spans(F.col("c")))[0]] == [(0, 4), (5, 6)]
    assert out(col(spark, ["http://www.A.b/", "DE89 3704 0044 0532 0130 00"]), X.normal_value(F.col("c"))) == ["a.b", "de89370400440532013000"]
    assert out(col(spark, ["none", "x", " NULL "]), X.null_token(F.col("c"))) == [None, "x", None]
    assert X.stem("forgetting") == "forgett" and X.stem("bypass") == "bypass" and X.stem("prints") == "print"
    hits = out(col(spark, ["two policies", "justice", "just so"]), F.col("c").rlike("(?iu)" + X.phrase_pattern("policy")))
    assert hits == [True, False, False]
    assert out(col(spark, ["Hello there. Dear John Smith came", "The John Smith Show"]), X.names(F.col("c"))) == [["John Smith"], ["John Smith Show"]]
    assert out(col(spark, ["mail a@b.co and a@b.co"]), X.entities(F.col("c"), "email")) == [["a@b.co"]]


def test_lsh_params():
    assert dedup.lsh_params(0.8, 128) == (25, 5)
    assert dedup.candidate_probability(0.8, 25, 5) == pytest.approx(0.999951, abs=1e-6)


def test_near_pairs_and_drops(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    q = spark.createDataFrame([("q1", 1, base), ("q2", 0, base), ("q3", 1, "something else entirely, nothing shared"), ("q4", 1, ""), ("q5", 1, "abc")], "id string, group int, text string")
    r = spark.createDataFrame([("r1", 1, base + "!"), ("r2", 1, base), ("r3", 1, "abc")], "id string, group int, text string")
    best = {x["query"]: x["reference"] for x in dedup.best_reference(dedup.near_pairs(q, r)).collect()}
    assert best == {"q1": "r2", "q5": "r3"}  # another label, and the empty text, never match
    w = spark.createDataFrame([("a", "c1", 1, True), ("a", "c1", 0, False), ("b", "c1", 0, False), ("d", "c2", 0, False)], "doc_id string, cluster_id string, label int, dedup_excluded boolean")
    assert {(x.doc_id, x.direct) for x in dedup.document_drops(w).collect()} == {("a", True), ("b", False)}


def test_greedy_is_ordered(spark):
    rows = spark.createDataFrame([(1, "g", "abcdefghij"), (2, "g", "abcdefghijk"), (3, "g", "zzzzzzzz"), (4, "h", "abcdefghij")], "id int, group string, text string")
    got = {r["id"]: (r["kept"], r["dup_of"]) for r in dedup.greedy(rows, "group", 0.8).collect()}
    assert got[1][0] and not got[2][0] and got[2][1] == 1 and got[3][0] and got[4][0]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(1, 2), (5, 2)], "a int, b int")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got[40] == 20 and got[5] == 1 and len(got) == 24


def brute_auc(s, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, u in zip(s, y) if u for b, v in zip(s, y) if not v]
    return sum(pairs) / len(pairs)


def test_auc_and_thresholds(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 6, 200) / 5, rng.integers(0, 2, 200)
    rows = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(s, y)] + [("one", 0.5, 1)], "g string, score double, label int")
    got = {r["g"]: r["auc"] for r in metrics.auc(rows, ["g"]).collect()}
    assert got["g"] == pytest.approx(brute_auc(s, y)) and got["one"] is None
    neg = sorted(a for a, b in zip(s, y) if not b)
    for f in (0.0, 0.1, 0.5, 1.0):
        ok = [t for t in set(neg) if sum(x >= t for x in neg) / len(neg) <= f]
        want = min(ok) if ok else np.nextafter(neg[-1], np.inf)
        assert metrics.tau_fpr(rows.where("g = 'g'"), ["g"], f).first()["tau"] == want


def test_contract_metrics(spark):
    rows = [("hijacked", "full", 1, 3, 2), ("hijacked", "full", 1, 3, 3), ("hijacked", "unmatched", 1, None, 0), ("benign", None, None, None, 4), ("benign", None, None, None, None), ("injection_ignored", None, 2, None, 1)]
    df = spark.createDataFrame(rows, "episode_class string, match string, injection_step int, first_harmful_step int, alarm_step int")
    m = metrics.contract_metrics(df, []).first()
    assert (m.n_hijacked, m.n_hijacked_eligible, m.n_stopped, m.stopped_before_harm) == (3, 2, 1, 0.5)
    assert (m.false_alarms_per_100_benign, m.n_early_alarms, m.n_early_alarms_ignored, m.detection_delay_mean) == (50.0, 1, 1, 1.5)


def test_contract_rules(spark):
    rows = [("e1", "v", "hijacked", "full", 1, 3, 2, 5, 0.9, 0.5), ("e1", "v", "benign", "full", 1, None, None, 5, 0.9, 0.5), ("", "v", "odd", None, None, None, 7, 5, 1.5, None)]
    df = spark.createDataFrame(rows, "episode_id string, variant string, episode_class string, match string, injection_step int, first_harmful_step int, alarm_step int, n_steps int, score double, threshold double")
    found = {(r.episode_id, r.problem) for r in audit.validate_contract(df).collect()}
    assert {("e1", "repeated row"), ("e1", "benign with injection_step"), ("e1", "no alarm at threshold"), ("", "episode_id missing"), ("", "score out of range"), ("", "threshold missing"), ("", "alarm_step beyond n_steps")} <= found


def test_statistics(spark):
    rows = spark.createDataFrame([("b", 0.04), ("a", 0.01), ("c", None), ("d", 0.03)], "key string, p double")
    got = {r["key"]: r["p_holm"] for r in stats.holm(rows, []).collect()}
    assert got["a"] == pytest.approx(0.03) and got["d"] == pytest.approx(0.06) and got["b"] == pytest.approx(0.06) and got["c"] is None
    assert stats.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-4)
    assert stats.p_from_ci(0.0, -1.0, 1.0) == pytest.approx(1.0) and math.isnan(stats.p_from_ci(0, 1, 1))
    one = spark.createDataFrame([("x", 1.0), ("x", 0.0)], "cluster string, v double")
    assert {r["stat"] for r in stats.bootstrap_rate(one, "v", "cluster", 5).collect()} == {0.5}


def test_codes_rank_all_cells(spark):
    x = spark.createDataFrame([(1, 0, 1.0)], "row int, bin int, value double")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "cell int, bin int")
    a = features.expand(x, edges, "row")
    assert [r["cell"] for r in features.winners(a, "row", "cell", 2).orderBy("cell").collect()] == [0, 1]  # cell 0 ties at 0 and is the lower
    assert features.k_for(10, 0.05) == 1 and features.k_for(50, 0.05) == 2


def test_bloom(spark):
    codes = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 2)], "row int, cell int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "row int, label int")
    f = models.bloom_fit(codes.where("row < 3"), labels, "row", "cell", 0.0)
    got = {r["row"]: r["score"] for r in models.bloom_score(codes, f, "row", "cell").collect()}
    assert got == {1: 0.75, 2: 0.5, 3: 0.5}  # an unseen cell stays 1 even at gamma 0


def test_splits(spark):
    rows = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in range(25)], "id int, s string")
    got = splits.stratified(rows, "id", "s", 0.25)
    assert {r["s"]: r["n"] for r in got.where("chosen").groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 4}  # 2.5 goes to 2
    assert splits._even(2.5) == 2 and splits._even(3.5) == 4


def test_tool_steps(spark):
    schema = f"episode_id string, messages array<{readers.MESSAGE}>"
    call = lambda f, i: {"function": f, "args": {"x": "1"}, "id": i}
    ms = [
        {"role": "assistant", "tool_calls": [call("f", "1"), call("g", None)]}, {"role": "tool", "content": "for g"}, {"role": "tool", "content": "for f", "tool_call_id": "1"},
        {"role": "assistant", "tool_calls": [call("never", None)]},
    ]
    full = [{k: m.get(k) for k in ("role", "content", "tool_calls", "tool_call_id", "error")} for m in ms]
    got = windows.tool_steps(spark.createDataFrame([("e", full)], schema)).orderBy("step").collect()
    assert [(r.step, r.content, r.function) for r in got] == [(0, "for g", "g"), (1, "for f", "f")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"context": ["a", "b"]}\n{"context": "a b"}\n{"context": "z"}\n')
    got = {r["norm"]: (r["n"], r["context"]) for r in readers.contexts_jsonl(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"a b": (2, "a\nb"), "z": (1, "z")}
    (tmp_path / "a.json").write_text('{"n1": ["x", "y"], "n2": ["z"]}')
    assert {tuple(r) for r in readers.attacks_json(spark, str(tmp_path / "a.json")).collect()} == {("n1", 0, "x"), ("n1", 1, "y"), ("n2", 0, "z")}
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "text_hash string, score double")
    assert writers.append_new(first, cache, "text_hash", spark) == 2
    assert writers.append_new(first.unionByName(spark.createDataFrame([("c", 3.0)], first.schema)), cache, "text_hash", spark) == 1
    rows = spark.createDataFrame([("e", "v", 1, None)], "episode_id string, variant string, alarm_step int, score double")
    writers.write_contract(rows, str(tmp_path / "contract"))
    back = writers.read_contract(spark, str(tmp_path / "contract")).first()
    assert back.alarm_step == 1 and back.score is None and back.suite is None
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "one.log").write_text("1")
    frozen = spark.createDataFrame(writers.freeze(spark, str(tmp_path / "logs")).collect())
    assert frozen.count() == 1
    (tmp_path / "logs" / "one.log").write_text("2")
    assert [r.state for r in writers.verify_frozen(writers.freeze(spark, str(tmp_path / "logs")), frozen).collect()] == ["changed"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    steps = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("a", 2, 0.95), ("b", 0, 0.2)], "episode_id string, step int, score double")
    steps.write.parquet(src)
    stream = spark.readStream.schema(steps.schema).parquet(src)
    got = streams.run_to_table(streams.first_alarms(stream, 0.8), "alarms", "update").collect()
    assert {(r.episode_id, r.alarm_step, r.n_steps) for r in got} == {("a", 1, 3), ("b", None, 1)}


def test_content_hash():
    assert settings.content_hash({"a": 1, "threads": 4}) == settings.content_hash({"threads": 9, "a": 1}) != settings.content_hash({"a": 2})


def test_catalogue_draws_are_the_references():
    assert evaluation.DRAWS == settings.BOOTSTRAPS == 1000
    for name in ("cluster_bootstrap_rate", "bootstrap_auc_ci", "macro_auc_ci", "paired_diff_p"):
        assert "range(1000)" in plans.ORACLE_SQL[name]


def test_knn_in_blocks(spark, monkeypatch):
    """Odd vectors against the definition, row by row; what meets are blocks of vectors, not rows."""
    nan, rng = float("nan"), np.random.default_rng(5)
    odd = [None, [0.0] * 3, [None, 1.0, 0.0], [nan, 1.0, 0.0], [float("inf"), 1.0, 0.0], [1.0, 2.0], [], [1e-30] * 3, [2.0, 2.0, 2.0], [-1.0, -1.0, -1.0]]
    drawn = [[float(x) for x in v] for v in rng.integers(-2, 3, (150, 3))] + [[float(x) for x in v] for v in rng.normal(size=(150, 3)).astype(np.float32)]
    vectors = [*odd, *drawn, *([[1.0, 2.0, 3.0]] * 40)]
    rows = [(f"é{i % 7}" if i % 50 == 3 else f"v{i * 7919 % 1000:03d}", v) for i, v in enumerate(vectors)]
    q = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows[::3] + rows[:10])], "q int, embedding array<float>")
    r = spark.createDataFrame(rows, "r string, embedding array<float>")

    def unit(df, key, name):
        v = F.transform("embedding", lambda e: e.cast("double"))
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + e * e))
        return df.select(key, F.when(norm > 0, F.transform(v, lambda e: e / norm)).otherwise(v).alias(name))

    sim = F.round(F.aggregate(F.zip_with("qv", "rv", lambda a, b: a * b), F.lit(0.0), lambda a, e: a + e), 9)
    found: dict = {}
    for x in unit(q, "q", "qv").crossJoin(unit(r, "r", "rv")).select("q", "r", sim.alias("sim")).collect():
        found.setdefault(x.q, []).append((x.sim is not None, x.sim, x.r))
    key = lambda t: (not t[0], 0.0 if t[1] is None else -math.inf if t[1] != t[1] else -t[1], t[2].encode())
    expected = {(i, n + 1, t[2], str(t[1])) for i, own in found.items() for n, t in enumerate(sorted(own, key=key)[:5])}
    for block in (64, 8192):
        monkeypatch.setattr(models, "BLOCK", block)
        got = models.knn(q, r, "q", "r", "embedding", 5)
        assert got.columns == ["q", "r", "sim", "rank"]
        assert {(x.q, x["rank"], x.r, str(x.sim)) for x in got.collect()} == expected
    assert models.knn(q.limit(0), r, "q", "r", "embedding", 5).count() == models.knn(q, r.limit(0), "q", "r", "embedding", 5).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("r"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    assert models._blocks(many, "r", "embedding").count() == 3


def test_closest_reference(spark):
    """Against all pairs; equal texts are one class, and no shuffle or table holds the shingles of a text."""
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("abcdeé😀 "), n)) for n in (1, 4, 5, 6, 60, 200, 256)]
    texts = ["", None, "abc", "xabcx"]
    for t in base:
        texts += [t, t, t + "!", t[: len(t) // 2] + "#" + t[len(t) // 2 :], t[: len(t) // 2] + "##########################" + t[len(t) // 2 :], t[::-1]]
    rows = [(f"{'q' if i % 3 == 0 else 'r'}{i}", g, t) for i, (g, t) in enumerate([(g, t) for g in (0, 1, None) for t in texts * 2])]
    q, r = ([x for x in rows if x[0][0] == side] for side in "qr")

    def grams(t):
        return {t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set()

    expected = set()
    for a, g, t in q:
        near = [(-len(grams(t) & grams(u)) / max(1, len(grams(t) | grams(u))), b) for b, h, u in r if g == h and g is not None]
        near = [x for x in near if x[0] <= -settings.NEAR]
        if near:
            expected.add((a, min(near)[1], -min(near)[0]))
    kind = "id string, group int, text string"
    got = dedup.closest(spark.createDataFrame(q, kind), spark.createDataFrame(r, kind))
    assert got.columns == ["query", "reference", "jaccard"] and {tuple(x) for x in got.collect()} == expected and len(expected) > 30
    one = spark.createDataFrame([(f"w{i}", 0, "some text that many windows have " + str(i % 2)) for i in range(300)], kind)
    keys = dedup._band_keys(dedup._classes(one, one.withColumn("id", F.concat(F.lit("x"), "id"))), settings.NEAR)
    assert keys.columns == ["n", "key"] and keys.count() == 2 * 25
