"""Operators 6, 8, 9 and the pipeline against brute force and planted cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from textloom.llm import contamination, neardup, shingles, templates

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_sets(rows, k):
    out = {}
    for d, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(rows, k, percent):
    sets = brute_sets(rows, k)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = defaultdict(list)
    for d, s in sets.items():
        shared = Counter(e for g in s for e in inverted[g])
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
        for g in s:
            inverted[g].append(d)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def family(rng, n, size, edits):
    """A hidden origin's copies, each with its own edits: many pairs lie on either side of the threshold."""
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "percent", "each"), [(3, 85, 3), (5, 80, 2)])
def test_components_are_brute_force(spark, odd, words, percent, each):
    rng = random.Random(words)
    texts = family(rng, 80, 120, 6) + family(rng, 60, 60, 9) + [" ".join(f"v{rng.randrange(10**5)}" for _ in range(40)) for _ in range(60)] + family(rng, 30, 6, 3) + ["same text here"] * 40 + ["", None, "A b", "a B"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent, each).collect()}
    comp, n = brute_components(rows, words, percent)
    assert {d: r["component_id"] for d, r in got.items()} == comp
    assert {d: r["n_shingles"] for d, r in got.items()} == n
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())


def test_neardup_edges(spark, odd, none):
    got = neardup.near_duplicates(odd, 3, 85, 3).collect()
    assert len(got) == odd.count() and {r["component_id"] for r in got if r["doc_id"] == 6} == {0}
    assert neardup.near_duplicates(none, 3, 85, 3).count() == 0
    kept = neardup.keep_one(odd, 3, 85, 3)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_blocks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) < 0.97], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for _ in range(30)]
    t = pa.table({"doc_id": list(range(30)), "component": list(range(30)), "hashes": pa.array([s.tobytes() for s in sets], pa.binary())})
    got = set(zip(*(c.to_pylist() for c in neardup.block_links(t.slice(0, 10), t, 90).columns)))
    want = {(i, j) for i in range(10) for j in range(30) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert got == want


def test_plan_and_shingles():
    assert neardup.plan(0.85, 3) == 10 and (1 - 0.85**3) ** 10 < 1e-4
    rng = random.Random(1)
    texts = ["", " ", "One", "one two", "A  b\tc\x0bd\n\re", "É É é x", "x" * 3000 + " y z", *(" ".join(rng.choices("abcde", k=50)) for _ in range(20))]
    got = [len(s) for s in shingles.shingle_sets(texts, 3)]
    assert got == [len(s) for s in brute_sets(list(enumerate(texts)), 3).values()]


def test_wand_is_exhaustive():
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randrange(3, 25)))) for i in range(300)]
    frequencies = Counter(t for _, x in items for t in set(contamination.terms(x)))
    index = contamination.Index(items, frequencies, 300, 12.0)
    for _ in range(200):
        q = set(rng.choices(list(index.docs), k=rng.randrange(1, 20)))
        scores = defaultdict(float)
        for t in q:
            for k, w in zip(index.docs[t], index.weights[t]):
                scores[k] += w
        for least in (0.2, 0.4, 0.7):
            assert sorted(k for k, _ in index.query(q, least)) == sorted(k for k, v in scores.items() if v >= least - 1e-9)


def test_contamination(spark, odd, none, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [(i, " ".join(word() for _ in range(30)) + "?\n" + " ".join(word() for _ in range(rng.choice((1, 2, 8))))) for i in range(20)]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{filler(rng.randrange(300))} {items[i % 20][1].upper() if i % 2 else items[i % 20][1]} {filler(rng.randrange(300))}") for i in range(40)]
    docs += [(100 + i, filler(500)) for i in range(20)] + [(200, items[0][1].split("?")[0]), (201, None), (202, "")]
    bench, frame = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(i, i % 20) for i in range(40)}
    assert {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(frame, bench).collect()} == want
    assert {r["doc_id"] for r in contamination.keep_clean(frame, bench).collect()} == {d for d, _ in docs} - set(range(40))
    monkeypatch.setattr(contamination, "MOST_BYTES", 1500)
    parts = list(contamination.indexes(bench, 1500))
    assert len(parts) > 1 and sum(len(p.items) for p in parts) == 20
    assert contamination.contaminated(odd, bench).count() == 0 and contamination.contaminated(none, bench).count() == 0 and contamination.contaminated(frame, bench.limit(0)).count() == 0


def test_templates(spark, odd, none):
    rng = random.Random(6)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(12))
    names = ["ann", "bob", "cyd", "dan", "eve", "fay"]
    docs = [(i, "\n".join([own(), f"Posted in May {i} by {names[i % 6] * (i + 1)} for the late evening edition", own(), "", own()])) for i in range(30)]
    copied = "\n".join(own() for _ in range(5))
    docs += [(100 + i, copied) for i in range(40)] + [(200, None), (201, "")]
    passage = " ".join(own() for _ in range(6))
    docs += [(300 + i, f"{own()}\n{passage}\n{own()}\n{own()}") for i in range(4)]
    before = dict(docs)
    got = {r["doc_id"]: r for r in templates.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d in range(30):
        assert "Posted in" not in got[d]["text"] and got[d]["_dropped"] == 1
    for d in range(300, 304):
        assert passage not in got[d]["text"] and got[d]["_dropped"] == 1
    assert all(got[d]["text"] == before[d] for d in [*range(100, 140), 200, 201])  # copies are one document
    out = templates.drop_templates(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == odd.count()
    assert templates.drop_templates(none).count() == 0


def test_long_items_are_found(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, f"{text(n)}?\n{text(8)}") for k, n in enumerate((292, 292, 89, 180, 900, 20))]
    docs = [(10 * k + i, f"{text(37 * i)} {t} {text(200)}") for k, t in items for i in range(4)]
    docs += [(100, f"{' '.join(items[0][1].split()[:60])} {text(1500)} {items[0][1].replace('a', 'A', 5)}"), (101, " ".join(items[0][1].split()[:60])), (102, text(700))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(10 * k + i, k) for k, _ in items for i in range(4)} | {(100, 0)}
    assert {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(frame, bench).collect()} == want
    assert {r["doc_id"] for r in contamination.keep_clean(frame, bench).collect()} == {101, 102}


def brute_drops(rows):
    """(doc_id, line) by the definition, with plain dicts: documents are brute-force components."""
    parsed = {(d, k): p for d, t in rows for k, x in enumerate((t or "").split("\n")) if (p := templates.parse(x))}
    need = lambda n: templates.LONG_DOCS if n >= templates.LONG else templates.MIN_DOCS
    masks, leaves, constant = defaultdict(set), Counter(), Counter()
    for (d, _), p in parsed.items():
        masks[p].add(d)
    for (n, leaf, _, masked), docs in masks.items():
        leaves[leaf] += len(docs)
        for place in enumerate(masked.split()):
            constant[leaf, place] += len(docs)
    keys = {}
    for p in masks:
        n, leaf, _, masked = p
        own = []
        halves = [leaves[leaf] / 2**k for k in range(30)]
        for least in {need(n), *(x for x in halves if x >= need(n))}:
            fixed = [x for x in enumerate(masked.split()) if constant[leaf, x] >= least]
            if sum(t != templates.ANY for _, t in fixed) >= templates.SHARE * n:
                own.append((leaf, tuple(fixed)))
        keys[p] = set(own)
    held = defaultdict(set)
    for (d, _), p in parsed.items():
        for key in keys[p]:
            held[key, need(p[0])].add(d)
    whole = dict(rows)
    likely = {k: docs for k, docs in held.items() if len({whole[d] for d in docs}) >= k[1]}
    among = set().union(*likely.values()) if likely else set()
    comp, _ = brute_components([(d, t) for d, t in rows if d in among], 5, 80)
    gone = {k[0] for k, docs in likely.items() if len({comp[d] for d in docs}) >= k[1]}
    return {at for at, p in parsed.items() if keys[p] & gone}


def test_templates_are_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    drops, _ = templates.find_templates(docs)
    want = brute_drops([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert want and {(r["doc_id"], r["line"]) for r in drops.collect()} == want


def test_examples_and_leaves_of_one_line(spark):
    """A line that never varies is alone in its leaf: it has all its tokens constant, but those with a digit."""
    header, few = "all of this is constant but 17 here", "only 1 2 3 4 constant"
    docs = [(i, f"{header}\n{few}\nown text of w{i}x and v{i}y stays {'abcdefghij'[i]} {'klmnopqrst'[i]}") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    drops, found = templates.find_templates(df)
    assert {(r["doc_id"], r["line"]) for r in drops.collect()} == {(i, 0) for i in range(10)}
    (row,) = templates.examples(df, found).collect()
    assert (row["n"], row["constants"], row["docs"], row["kinds"], row["example"], tuple(row["at"])) == (8, 7, 10, 10, header, (0, 0))


def test_templates_of_copies_and_blocks(spark):
    rng = random.Random(7)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(12))
    head, foot, hot = "All of this page was made by the press office", "Write to the press office for more of this", "\n".join(own() for _ in range(4))
    line = "This line is in many quite unlike documents here"
    docs = [(i, f"{head}\n{own()}\n{own()}\n{foot}") for i in range(12)]
    docs += [(100 + i, f"{own()}\n{line}\n{own()}") for i in range(9)] + [(200 + i, f"{hot}\n{line}") for i in range(60)]
    near = [own() for _ in range(12)]
    docs += [(300 + i, "\n".join([*near[: i % 12], f"{own().split()[0]} {near[i % 12].split(' ', 1)[1]}", *near[i % 12 + 1 :]])) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in templates.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not any(x in t for t in got.values() for x in (head, foot, line))
    assert all(got[200 + i] == hot for i in range(60))
    assert all(got[d] == t for d, t in docs if d >= 300)  # near copies are one document


def test_frequent_field_values_stay_variable(spark):
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(12))
    docs = [(i, f"{own()}\nPosted in May by name{'abcdefghijklmnop'[i % 16]} for the city{'abcdefghijklmnop'[i // 16]} edition\n{own()}") for i in range(256)]
    docs += [(300 + i, f"{own()}\nPosted in May but kept there by the same rare crew\n{own()}") for i in range(6)]  # a small template of the same leaf
    got = templates.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 262 and all(r["_dropped"] == 1 and "Posted" not in r["text"] for r in got)


def test_passage_of_two_documents(spark):
    rng = random.Random(10)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    passage, copied = own(60), f"{own(70)}\n{own(12)}"
    docs = [(0, f"{own(30)}\n{passage}"), (1, f"{passage}\n{own(40)}"), (2, copied), (3, copied), (4, f"{copied} more")]
    got = {r["doc_id"]: r["text"] for r in templates.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert passage not in got[0] + got[1] and got[0] and got[1]
    assert all(got[d] == t for d, t in docs[2:])  # copies are one document


def test_line_dedup_keeps_own_text(spark):
    rng = random.Random(8)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    passage, bodies = own(60), [own(20) for _ in range(8)]
    rows = [(i, f"{passage}\n{b}") for i, b in enumerate(bodies)] + [(20, passage), (21, f" \n{passage}"), (22, " "), (23, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_recurring_lines(spark, docs, "").collect()}
    assert got == {**dict(enumerate(bodies)), 22: " ", 23: None}


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        before = docs
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == before.columns and {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
        if name == "MinHash near-dedup":
            comp, _ = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == set(comp.values())
        if name == "benchmark decontamination":
            assert not any(b in r["text"] for r in docs.collect() for b in benchmark)
    packed = docs.toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048 and set(packed["doc_id"]) == {r["doc_id"] for r in before.collect()}
