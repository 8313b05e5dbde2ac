"""Operators 3, 7 and 10: gradients, held-out accuracy, edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import language, quality, toxicity
from textloom.llm.common import BATCH_BYTES, bound_batches, remainder, tidy

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_cnn_gradients():
    net = language.Network(["a", "b"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grid = np.random.default_rng(0).integers(0, 256, (4, language.WINDOW), dtype=np.uint8)
    y = np.array([0, 1, 1, 0])
    _, g = net.step(grid, y)
    rng = np.random.default_rng(2)
    for name, p in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if name == "embed":
                at = (int(grid[0, rng.integers(0, 200)]), at[1])
            keep, eps = p[at], 1e-5
            p[at] = keep + eps
            up, _ = net.step(grid, y)
            p[at] = keep - eps
            down, _ = net.step(grid, y)
            p[at] = keep
            assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-4)


def test_tables_are_the_network():
    net = language.Network(["a", "b", "c"], seed=3)
    grid = np.random.default_rng(0).integers(0, 256, (20, language.WINDOW), dtype=np.uint8)
    x = net.p["embed"][grid]
    taps = np.concatenate([x[:, j : j + language._PLACES] for j in range(4)], axis=2)
    conv = taps @ (net.p["filters"] * net.mask).reshape(4 * language.EMBED, -1)
    z = np.maximum(conv.max(axis=1) + net.p["bias"], 0) @ net.p["out"] + net.p["out_bias"]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(language.Scorer(net).log_probabilities(grid), want, atol=1e-4)


def test_batches_are_bounded(spark):
    bound_batches(spark)
    rows = spark.range(64).selectExpr("id", "repeat('0123456789abcdef', 8192) AS text")  # 128 kB each

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    got = [r["n"] for r in rows.coalesce(1).mapInArrow(tidy(sizes), "n long").collect()]
    assert len(got) > 3 and max(got) <= BATCH_BYTES + (1 << 18)


def test_language(spark, docs, odd, none):
    held = remainder(4) == 2
    net = language.train(docs.select("doc_id", "text", "lang").where(~held))
    got = language.identify(docs, net, held).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.97
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd, net).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= rows and all(0 <= s <= 1 for _, _, s in rows) and language.identify(odd, net).count() == odd.count()
    assert language.identify(none, net).count() == 0
    assert {tuple(r) for r in language.identify(odd, language.train(none)).select("lang_pred", "score").collect()} == {("und", 0.0)}
    signs = spark.createDataFrame([(1, "² ½ Ⅷ ① 7"), (2, "²a")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language.identify(signs, net).orderBy("doc_id").collect()] == [True, False]


def test_toxicity(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = remainder(3) == 1
    model = toxicity.train(docs.where(~held).select("doc_id", "text", "toxic"))
    got = {r["toxic"]: r["p"] for r in toxicity.score(docs, model, held).where("held_out").join(docs.select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert got[1] > 0.85 and got[0] < 0.02  # some 2,600 documents to learn from; 6,000 give about 0.98
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert rows[1] == rows[2] == rows[3] == 0.0 and toxicity.score(odd, model).count() == odd.count() and toxicity.keep_clean(odd, model).columns == odd.columns
    spot = model.locate("All is well here. You are a stupid idiot and a moron. Good bye.")
    assert [i for i, _, _ in spot] == [1]
    assert toxicity.score(none, model).count() == 0
    for few in (none, odd):
        assert toxicity.score(odd, toxicity.train(few.select("doc_id", "text", F.lit(1).alias("toxic")))).where("score <> 0").count() == 0
    clean = [r["text"] for r in docs.where(held & (F.col("toxic") == 0)).collect()]
    assert all(model.score("\n".join([t] * 40)) == model.score(t) for t in clean[:200])  # what is repeated adds nothing
    text = [t for t in clean if len(t) < 3000]
    filler = "\n".join(f"{k} xq{k} zzv{k}." for k in range(400))
    assert all(abs(model.score(f"{t}\n{filler}") - model.score(t)) < 1e-9 for t in text[:50] if toxicity.sentences(t))  # nor does what is unknown


def test_noisy_or_is_plain():
    model = toxicity.Model({"a": 3.0, "b": 1.5, "c": 7.0}, -4.0)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for text in ("a b. c d.", "x. y.", "a. a. a b", "c a\nb b b"):
        left = 1 - sigmoid(model.leak)
        for s in set(toxicity.sentences(text)):
            z = toxicity.REST + sum(model.weights.get(w, 0) for w in {x.strip(".") for x in s.split()})
            left *= (1 - sigmoid(z)) / (1 - sigmoid(toxicity.REST))
        assert model.score(text) == pytest.approx(1 - left)


def test_noisy_or_gradient():
    rng = np.random.default_rng(5)
    w, leak = rng.random(12) * 4, -2.0
    count = np.array([1, 3, 2, 5])
    f, at = rng.integers(0, 12, 40), np.sort(rng.integers(0, 11, 40))
    y = np.array([0, 1, 1, 0])
    _, u, g, gleak = toxicity.gradient(w, leak, f, at, count, y)
    for k, i in enumerate(u):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert g[k] == pytest.approx((toxicity.gradient(up, leak, f, at, count, y)[0] - toxicity.gradient(down, leak, f, at, count, y)[0]) / 2e-6, abs=1e-4)
    assert gleak == pytest.approx((toxicity.gradient(w, leak + 1e-6, f, at, count, y)[0] - toxicity.gradient(w, leak - 1e-6, f, at, count, y)[0]) / 2e-6, abs=1e-4)


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.select("doc_id", "text").join(labels, "doc_id")
    held = remainder(5) == 0
    v = quality.word_vectors(docs)
    assert np.array_equal(v, quality.word_vectors(docs.repartition(7)))  # sums don't depend on the partitions
    net = quality.train(rows.where(~held).select("doc_id", "text", "quality"), v)
    assert 0.2 < net.temperature < 10
    got = {r["quality"]: r["p"] for r in quality.score(rows, v, net, held).join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("p")).collect()}
    assert got[1] - got[0] > 0.5
    assert quality.score(odd, v, net).count() == odd.count() and quality.score(none, v, net).count() == 0
    assert not quality.word_vectors(none).any()
    for few, share in ((none, 0.5), (odd, 1.0)):
        got = quality.score(odd, v, quality.train(few.select("doc_id", "text", F.lit(1).alias("quality")), v)).collect()
        assert all(r["score"] == pytest.approx(share, abs=1e-6) for r in got)


def test_word_vectors_are_plain_sums(spark):
    texts = ["the cat sat on the mat, the end", "A cat; a mat", "", None, "mat"]
    got = quality.word_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    places, signs = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        ids = quality.Words().ids(t or "").tolist()
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= quality.REACH:
                    np.add.at(want[a], places[b], signs)
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12), atol=1e-6)
