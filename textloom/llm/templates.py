"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: the number of its tokens, then its first ``DEPTH`` tokens, in which tokens
with a digit are variable from the start.  In a leaf, a token at a place is constant if lines of enough documents
have it there; all other places are variable fields.  Enough are the leaf's documents, their half, quarter, and so on
down to the fixed least number: the tree's next levels, so that a field's value stays variable on some level however
often it comes, and a rare template of a large leaf is found on a deeper one.  Lines of a leaf with the same constants
on a level are a template, if these are at least ``SHARE`` of the tokens.  A template that recurs in enough documents
is dropped from all of them.

Copies of one document share all of its lines, which makes none of them a template: copies are for near-duplicate
removal, which must still find them alike.  So a near-duplicate component (``COPIES``, among the documents that have a
line of a template in question) counts as one document.  Shared boilerplate joins unlike documents only where it is
nearly all of their text.  A template in enough components goes from all documents, however many copies some have.

A leaf is never gathered: constants are counted by (leaf, place, token), templates by their hash, so that the order of
lines doesn't matter and a leaf with a third of all lines is summed like any other.  Leaves that too few documents
reach are left out before any text is moved, and a leaf of one line has all of it constant: only leaves of several
lines are counted by place.

Defined results: null and empty texts, and blank lines, have no template and stay; a line is what stands between
newlines, however long; repeated rows (equal doc_id) count as one document and lose the same lines; a token that
exactly the least number of documents have is constant, a template of exactly the least number of components recurs;
rows without doc_id are not counted and stay as they are; an empty table gives an empty one; other columns are kept,
whatever their names, but that _lines and _dropped are this operator's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import neardup, sieve
from .common import bound_batches, forget, settle, texts, tidy

DEPTH = 3
SHARE = 0.6
MIN_DOCS = 5
LONG, LONG_DOCS = 50, 2  # a line of so many tokens is a passage, and recurs from two unlike documents on
ANY = "<*>"
COPIES = {"words": 5, "percent": 80, "each": 5, "miss": 5e-3, "tensored": False}  # what counts as copies, as in the pipeline's near-dedup; at 0.8 itself 1 link in 200 is missed

_DIGIT = re.compile(r"\d")


def parse(line: str) -> tuple[int, int, int, str] | None:
    """(number of tokens, leaf, hash of the masked line, masked line), hashes unsigned; None for a blank line.

    The leaf: the number of tokens and the first ``DEPTH``; tokens with a digit are variable.
    """
    tokens = line.split()
    if not tokens:
        return None
    if _DIGIT.search(line):
        tokens = [ANY if _DIGIT.search(t) else t for t in tokens]
    masked = " ".join(tokens)
    return len(tokens), _hash(f"{len(tokens)} {' '.join(tokens[:DEPTH])}"), _hash(masked), masked


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def _longs(hashes: list[int]) -> np.ndarray:
    return np.array(hashes, dtype=np.uint64).view(np.int64)


def need(n: str | Column = "n") -> Column:
    return F.when(F.col(n) >= LONG, LONG_DOCS).otherwise(MIN_DOCS) if isinstance(n, str) else F.when(n >= LONG, LONG_DOCS).otherwise(MIN_DOCS)


def parsed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, n, literals, leaf, mask, fresh, whole) of all lines that are not blank.

    literals: tokens without a digit; fresh: the first such line of its row; whole: a hash of the row's text.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, whole = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                seen = set()
                whole.append(_hash(text))
                for k, line in enumerate(text.split("\n")):
                    if got := parse(line):
                        n, leaf, mask, masked = got
                        at.append(i)
                        rows.append((k, n, n - masked.split(" ").count(ANY) if ANY in masked else n, leaf, mask, mask not in seen))
                        seen.add(mask)
            if rows:
                line_of, n, literals, leaf, mask, fresh = zip(*rows, strict=True)
                own = pa.array(at)
                columns = [batch.column(0).take(own), pa.array(line_of, pa.int32()), pa.array(n, pa.int32()), pa.array(literals, pa.int32()), pa.array(_longs(leaf)), pa.array(_longs(mask)), pa.array(fresh, pa.bool_()), pa.array(_longs(whole)).take(own)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "n", "literals", "leaf", "mask", "fresh", "whole"])

    return texts(docs).where("doc_id is not null").mapInArrow(tidy(run), "doc_id long, line int, n int, literals int, leaf long, mask long, fresh boolean, whole long")


def masked_lines(docs: DataFrame, leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (leaf, mask, holder, ...) with masked, the line itself, read from a document that holds it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((sieve.build(leaves.select("leaf"), leaves.count()), sieve.build(wanted.select("holder"), wanted.count())))  # 4 MB each at most
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_leaf, of_doc = shared.value
        for batch in batches:
            held = batch.column(1).take(pa.array(np.flatnonzero(of_doc.passes(batch.column(0).to_numpy(zero_copy_only=False)))))
            lines = [got for text in held.to_pylist() for line in text.split("\n") if (got := parse(line))]
            if not lines:
                continue
            _, leaf, mask, masked = zip(*lines, strict=True)
            keep = np.unique(_longs(mask), return_index=True)[1]
            keep = pa.array(keep[of_leaf.passes(_longs(leaf)[keep])])
            yield pa.RecordBatch.from_arrays([pa.array(_longs(leaf)).take(keep), pa.array(_longs(mask)).take(keep), pa.array(masked, pa.string()).take(keep)], ["leaf", "mask", "masked"])

    rows = texts(docs).where("doc_id is not null").mapInArrow(tidy(run), "leaf long, mask long, masked string")
    return rows.join(wanted, ["leaf", "mask"]).dropDuplicates(["leaf", "mask"])


def levels(size: str) -> Column:
    """Documents that make a token constant, by level: all of the leaf's, half of them, ..., and ``need`` at last."""
    halvings = F.floor(F.log2(F.col(size) / need())).cast("int")
    return F.array_append(F.transform(F.sequence(F.lit(0), halvings), lambda k: F.col(size) / F.pow(F.lit(2.0), k)), need().cast("double"))


def find_templates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line) of the lines to drop, and (template, n, docs, constants, kinds, at) of the recurring templates; at: (doc_id, line) of one such line."""
    lines = settle(parsed_lines(docs), "lines")
    groups = settle(lines.groupBy("leaf", "mask", "n").agg(F.sum(F.col("fresh").cast("long")).alias("docs"), F.min("doc_id").alias("holder"), F.max("literals").alias("literals")), "groups")
    # a leaf of one line (masks = 1) has all of it constant on the first level: nothing to count by place
    reached = settle(groups.groupBy("leaf", "n").agg(F.sum("docs").alias("size"), F.count("*").alias("masks")).where(F.col("size") >= need()), "reached")
    alone = groups.join(reached.where("masks = 1").select("leaf"), "leaf", "left_semi").where(F.col("literals") >= SHARE * F.col("n"))
    alone = settle(alone.select("leaf", "mask", "n", F.col("literals").cast("long").alias("constants"), F.xxhash64("leaf", "literals", "mask").alias("template")), "alone")
    leaves = settle(reached.where("masks > 1").drop("masks").withColumn("levels", levels("size")), "leaves")
    wanted = settle(groups.drop("literals").join(leaves.select("leaf"), "leaf", "left_semi"), "wanted")
    held = settle(masked_lines(docs, leaves, wanted).drop("holder"), "masked")
    forget(groups, reached, wanted)

    places = held.select("leaf", "mask", "n", "docs", F.posexplode(F.split("masked", " ")).alias("place", "token")).withColumn("literal", F.col("token") != ANY).withColumn("token", F.xxhash64("token"))
    constant = places.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("times"), F.max("n").alias("n")).where(F.col("times") >= need())
    constant = constant.join(leaves.drop("n"), "leaf").withColumn("times", F.col("times").cast("double"))
    constant = settle(constant.select("leaf", "place", "token", F.size(F.filter("levels", lambda least: least > F.col("times"))).alias("level")), "constants")
    # what each level adds to the constants of a line, then the sums from the first level on: a place is in one sum only
    added = places.drop("docs").join(constant, ["leaf", "place", "token"]).groupBy("leaf", "mask", "n", "level").agg(F.sum(F.col("literal").cast("long")).alias("constants"), F.bit_xor(F.xxhash64("place", "token")).alias("places"))
    so_far = Window.partitionBy("leaf", "mask").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = added.select("leaf", "mask", "n", F.sum("constants").over(so_far).alias("constants"), F.bit_xor("places").over(so_far).alias("places"))
    named = named.where(F.col("constants") >= SHARE * F.col("n")).select("leaf", "mask", "n", "constants", F.xxhash64("leaf", "constants", "places").alias("template"))
    named = settle(named.union(alone), "named")
    forget(constant, leaves, alone, held)
    found = settle(lines.select("doc_id", "line", "leaf", "mask", "whole").join(named, ["leaf", "mask"]).select("doc_id", "line", "template", "n", "constants", "whole"), "found")
    forget(lines, named)
    # different texts are at least as many as components: templates with too few need none
    likely = settle(found.groupBy("template", "n").agg(F.count_distinct("whole").alias("texts")).where(F.col("texts") >= need()).select("template"), "likely")
    held_by = settle(found.join(likely, "template").select("doc_id", "line", "template", "n", "constants"), "held")
    forget(found, likely)
    among = settle(held_by.select("doc_id").distinct(), "among")
    copies = neardup.near_duplicates(docs, **COPIES, among=among).groupBy("doc_id").agg(F.min("component_id").alias("component"))
    across = held_by.join(settle(copies, "copies"), "doc_id").groupBy("template", "n").agg(
        F.count_distinct("doc_id").alias("docs"), F.count_distinct("component").alias("kinds"), F.max("constants").alias("constants"), F.min(F.struct("doc_id", "line")).alias("at")
    )
    recurring = settle(across.where(F.col("kinds") >= need()), "recurring")
    drops = held_by.join(recurring.select("template"), "template").select("doc_id", "line").distinct()
    return drops, recurring


def examples(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """``templates`` of ``find_templates`` with example, a line of each as it stands in ``docs``; of rows with one id, the least such line."""
    lines = templates.select("template", "at.*").join(texts(docs), "doc_id").groupBy("template").agg(F.min(F.get(F.split("text", "\n"), F.col("line"))).alias("example"))
    return templates.join(lines, "template")


def _without(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    out = []
    for t, d in zip(text, drops, strict=True):
        if t is None:
            out.append((None, 0, 0))
            continue
        rows = t.split("\n")
        if d is None:
            out.append((t, len(rows), 0))
            continue
        gone = set(d.tolist())
        kept = [x for i, x in enumerate(rows) if i not in gone]
        out.append(("\n".join(kept), len(rows), len(rows) - len(kept)))
    return pd.DataFrame(out, columns=["text", "lines", "dropped"])


def drop_templates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` without the recurring lines, and with _lines and _dropped."""
    drops, _ = find_templates(docs)
    of = settle(drops.groupBy("doc_id").agg(F.collect_list("line").alias("gone")), "drops")
    bound_batches(docs.sparkSession)
    without = F.pandas_udf(_without, "struct<text: string, lines: int, dropped: int>")
    # the row travels as one struct, so that no column of it can clash with the join's own; as many documents may lose
    # lines as there are: never a broadcast side, however few they are in one corpus
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    joined = rows.join(of.hint("merge"), "doc_id", "left").withColumn("got", without("row.text", "gone"))
    kept = [F.col("got.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("_lines", "_dropped")]
    return joined.select(*kept, F.col("got.lines").alias("_lines"), F.col("got.dropped").alias("_dropped"))
