"""MinHash near-duplicates with tensored banding, every link confirmed on full shingle sets.

Two small collections of sketches are made of each set, a sketch being a few minhashes together.  A table key is a
pair of one sketch from each collection: n + n sketches give n * n tables, so that the minhashes to compute are about
the square root of what as many independent tables need.  A pair of sets is missed only if it agrees in no sketch of
one of the collections; ``plan`` takes the least n that keeps this below ``miss`` at the threshold itself.

A key can only be shared if both of its halves are, so that sketches without a partner are dropped before keys are
formed.  Equal sets are folded first.  The hub of a key is its member with the most company over all of its keys,
which for a family of copies is their origin, and every document is compared with the weightiest hub it meets.
Keys whose members are then in different components are taken up by hub: the members outside the hub's largest
component are compared with all members, in blocks of bounded size that count intersections in place and return
links only.  So every candidate pair is in one component or compared, no pair is written out, and no group is one task.

Defined results: a null or empty text, and one without words, has an empty set and is linked with nothing; texts
shorter than a shingle are one shingle; long texts are taken whole; repeated rows (equal doc_id) are returned as often
as they come, in one component, and if their texts differ one of these stands for the document, the same in every run;
a tie at the threshold is a link; rows without doc_id are linked with nothing and come back with a null component; an
empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from .common import bound_batches, forget, settle, texts, tidy
from .graph import components
from .shingles import mix, shingle_sets

MISS = 2e-4  # of the pairs at the threshold itself
CHUNK = 1 << 18  # bytes of text hashed at a time


def plan(threshold: float, each: int = 3, miss: float = MISS) -> int:
    """Sketches a collection, of ``each`` minhashes a sketch."""
    return math.ceil(math.log(miss / 2) / math.log(1 - threshold**each))


def tables(threshold: float, each: int, miss: float) -> int:
    """Independent tables, keyed by one sketch of ``each`` minhashes, without tensoring."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**each))


def _chunks(rows: list[str]) -> Iterator[slice]:
    begin = size = 0
    for i, t in enumerate(rows):
        size += len(t)
        if size >= CHUNK:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(rows):
        yield slice(begin, len(rows))


def sketches(sets: list[np.ndarray], number: int, each: int, seed: int = 41) -> np.ndarray:
    """(sets, 2 * number) sketches; rows of empty sets are 0."""
    out = np.zeros((len(sets), 2 * number), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    size = np.array([len(sets[i]) for i in full])
    begin = np.cumsum(size) - size
    odd = np.random.default_rng(seed).integers(1, 1 << 63, 2 * number * each, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(2 * number):
        held = np.full(len(full), k + 1, dtype=np.uint64)
        for j in range(each):
            held = mix(held ^ np.minimum.reduceat(flat * odd[k * each + j], begin))
        out[full, k] = held
    return out


def describe(docs: DataFrame, words: int, number: int, each: int, among: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, s1, s2, sketches): the size of each set, two sums over it that stand for it, and its sketches."""
    spark = docs.sparkSession
    shared = None if among is None else spark.sparkContext.broadcast(sieve.build(among.select("doc_id"), among.count()))  # 4 MB at most
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                batch = batch.filter(pa.array(shared.value.passes(batch.column(0).to_numpy(zero_copy_only=False)), pa.bool_()))
            rows = batch.column(1).to_pylist()
            for part in _chunks(rows):
                sets = shingle_sets(rows[part], words)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                s2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                sk = sketches(sets, number, each).view(np.int64)
                flat = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * sk.shape[1], pa.array(sk.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), flat], ["doc_id", "n", "s1", "s2", "sketches"])

    kind = "doc_id long, n long, s1 long, s2 long, sketches array<long>"
    if among is None:
        return texts(docs).mapInArrow(tidy(run), kind)
    return texts(docs).where("doc_id is not null").mapInArrow(tidy(run), kind).join(among.select("doc_id"), "doc_id", "left_semi")


def full_sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(doc_id, hashes) of the wanted documents; the sieve spares the others before their sets are built."""
    n = wanted.count()
    shared = docs.sparkSession.sparkContext.broadcast(sieve.build(wanted.select("doc_id"), n))  # 4 MB at most
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(shared.value.passes(ids))
            rows = batch.column(1).take(pa.array(keep)).to_pylist()
            for part in _chunks(rows):
                out = [s.tobytes() for s in shingle_sets(rows[part], words)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep[part]]), pa.array(out, pa.binary())], ["doc_id", "hashes"])

    rows = texts(docs).where("doc_id is not null").mapInArrow(tidy(run), "doc_id long, hashes binary")
    return rows.join(wanted.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("hashes").alias("hashes"))


def _linked(same: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return (same > 0) & (100 * same >= percent * (x + y - same))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    bound_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.frombuffer(x + y, np.uint64), kind="stable")
                same = np.count_nonzero(both[1:] == both[:-1])
                keep.append(bool(_linked(np.int64(same), len(x) // 8, len(y) // 8, percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(tidy(run), "a long, b long")


def block_links(minor: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """(a, b): of each minor document one linked member of every other component, from exact intersections."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not minor.num_rows or not members.num_rows:
        return none
    sides = [[np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()] for t in (minor, members)]
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in sides]
    docs = [t.column("doc_id").to_numpy() for t in (minor, members)]
    comps = [t.column("component").to_numpy() for t in (minor, members)]
    flat = [np.concatenate(side) for side in sides]
    words = np.unique(flat[0])
    at = np.searchsorted(words, flat[1])
    known = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == flat[1])
    column = np.where(known, at, len(words))  # the last column stays empty
    begin = np.cumsum(sizes[1]) - sizes[1]
    own = np.searchsorted(words, flat[0])
    first = np.cumsum(sizes[0]) - sizes[0]
    a, b = [], []
    step = 16
    for k in range(0, len(sides[0]), step):
        rows = range(k, min(k + step, len(sides[0])))
        has = np.zeros((len(rows), len(words) + 1), dtype=np.uint8)
        for i, r in enumerate(rows):
            has[i, own[first[r] : first[r] + sizes[0][r]]] = 1
        for i, r in enumerate(rows):
            same = np.add.reduceat(has[i][column], begin, dtype=np.int64)
            hit = np.flatnonzero(_linked(same, sizes[0][r], sizes[1], percent) & (comps[1] != comps[0][r]))
            for j in hit[np.unique(comps[1][hit], return_index=True)[1]].tolist():
                a.append(docs[0][r])
                b.append(docs[1][j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


BLOCK = 1024  # documents a side


def links_by_hub(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components among the members of a hub; ``opened``: (hub, doc_id, component, is_minor)."""
    count = opened.groupBy("hub").agg(F.count("*").alias("all"), F.sum(F.col("is_minor").cast("long")).alias("few"))
    count = settle(count.select("hub", F.ceil(F.col("all") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("few") / BLOCK).cast("int").alias("mb")), "blocks")
    full = settle(opened.join(count, "hub").join(sets, "doc_id"), "opened")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int")
    members = full.select("hub", "doc_id", "component", "hashes", mine.alias("j"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"))
    minor = full.where("is_minor").select("hub", "doc_id", "component", "hashes", F.pmod(F.xxhash64("doc_id"), F.col("mb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_links(left, right, percent)

    return minor.groupBy("hub", "i", "j").cogroup(members.groupBy("hub", "i", "j")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, each: int = 2, among: DataFrame | None = None, miss: float = MISS, tensored: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; with ``among`` (doc_id), of the rows of these documents alone.

    Not ``tensored``: a key is one sketch, which takes more minhashes and fewer rows for the same ``miss``.
    """
    number = plan(percent / 100, each, miss) if tensored else -(-tables(percent / 100, each, miss) // 2)
    described = settle(describe(docs, words, number, each, among), "sets")
    same = ["n", "s1", "s2"]
    classes = settle(described.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("class")), "classes")
    heads = settle(described.join(classes.withColumnRenamed("class", "doc_id"), [*same, "doc_id"]).groupBy("doc_id").agg(F.max(F.struct("n", "sketches")).alias("x")).select("doc_id", "x.*"), "heads")

    halves = heads.select("doc_id", "n", F.posexplode("sketches").alias("k", "sketch"))
    if tensored:
        shared = settle(halves.groupBy("k", "sketch").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k", "sketch"), "halves")
        own = halves.join(shared, ["k", "sketch"]).groupBy("doc_id", "n").agg(F.collect_list(F.struct("k", "sketch")).alias("own"))
        keys = own.select("doc_id", "n", F.explode(F.filter("own", lambda x: x.k < number)).alias("x"), "own").select("doc_id", "n", "x", F.explode(F.filter("own", lambda y: y.k >= number)).alias("y"))
        keys = settle(keys.select(F.xxhash64("x.k", "x.sketch", "y.k", "y.sketch").alias("key"), "doc_id", "n"), "keys")
        forget(heads, shared)
    else:
        keys = settle(halves.select(F.xxhash64("k", "sketch").alias("key"), "doc_id", "n"), "keys")
        forget(heads)
    full = settle(keys.groupBy("key").count().where("count > 1"), "full")
    met = settle(keys.join(full, "key"), "met")
    forget(keys, full)
    weight = settle(met.groupBy("doc_id").agg(F.sum("count").alias("weight")), "weight")
    weighed = settle(met.drop("count").join(weight, "doc_id"), "weighed")
    forget(met)
    rank = F.struct(F.col("weight"), (-F.col("doc_id")).alias("least"), F.col("n"))
    hubs = settle(weighed.groupBy("key").agg(F.max(rank).alias("hub")), "hubs")
    members = settle(weighed.select("key", "doc_id", "n").join(hubs, "key"), "members")
    forget(weighed, hubs)

    # each document against the weightiest hub among its keys; sizes beyond the threshold can't be linked
    best = members.groupBy("doc_id", "n").agg(F.max("hub").alias("hub")).select((-F.col("hub.least")).alias("a"), F.col("doc_id").alias("b"), "n", F.col("hub.n").alias("hub_n"))
    stars = settle(best.where("a <> b").where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select("a", "b"), "pairs")
    sets = settle(full_sets(docs, words, weight.select("doc_id")), "full")
    links = settle(confirm(stars, sets, percent), "links")
    labels = components(links)

    placed = members.select("key", (-F.col("hub.least")).alias("hub"), "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = settle(placed, "placed")
    forget(members, stars)
    mixed = settle(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "mixed")
    opened = settle(placed.join(mixed, "key").select("hub", "doc_id", "component").distinct(), "opened")
    forget(placed, mixed)
    major = settle(opened.groupBy("hub", "component").count().groupBy("hub").agg(F.max(F.struct("count", "component")).alias("most")).select("hub", F.col("most.component").alias("major")), "major")
    split = settle(opened.join(major, "hub").select("hub", "doc_id", "component", (F.col("component") != F.col("major")).alias("is_minor")), "split")
    more = settle(links_by_hub(split, sets, percent), "links")
    forget(opened, major, split, sets, weight)
    if more.limit(1).count():
        forget(labels)
        labels = components(links.union(more))

    lowest = classes.join(labels, classes["class"] == labels.node, "left").select(*same, F.coalesce("component", "class").alias("component_id"))
    out = described.drop("sketches").join(settle(lowest, "lowest"), same, "left")
    forget(classes, labels, links, more)
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, each: int = 2) -> DataFrame:
    """The rows of ``docs`` but for those that a component keeps another document of; rows of equal doc_id and text stay one."""
    found = near_duplicates(docs, words, percent, each).where("not kept").select("doc_id").distinct()
    left = docs.join(found.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))  # copies may be most of a corpus: never a broadcast side
    repeated = settle(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return left
    again = left.join(repeated.hint("merge"), "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    return left.join(repeated.hint("merge"), "doc_id", "left_anti").select(*left.columns).unionByName(again.dropDuplicates(["doc_id", "text"]))
