"""Text, window, dedup, split and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.spans import injection_spans
from ..operators import audit, dedup, labels, splits, windows
from .registry import Tables, query

NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
#: A pattern bank for the driver's own corpus.
PATTERNS = [r"\blicen[sc]ed?\b", r"[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9.-]+", r"\+\d+ \(\d+\)", r"\b\d{13,16}\b", r"\b(idiot|stupid|moron|loser|trash)\b", r"[#&%$*]{3}", r" \| .* \| "]


@query(f"SELECT doc_id, md5({NORM}) AS norm_md5, length({NORM}) AS norm_length FROM documents")
def normalize_ws(t: Tables) -> DataFrame:
    n = X.collapse(F.col("text"))
    return t.documents.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("norm_length"))


@query()
def normalize_nfkc(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.normalize(F.col("text"))).alias("norm_md5"), X.text_hash(F.col("text")).alias("text_hash"))


@query("SELECT lang, CASE WHEN lang = 'en' THEN 'en' ELSE 'non-en' END AS stratum, count(*) AS n, sum(n_chars) AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY 1, 2")
def lang_stratum_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", X.lang_stratum(F.col("lang")).alias("stratum")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@query("SELECT lang, min(length(text)) AS min, CAST(floor(quantile_cont(length(text), 0.5)) AS BIGINT) AS median, round(avg(length(text)), 1) AS mean, max(length(text)) AS max FROM documents GROUP BY lang")
def length_stats(t: Tables) -> DataFrame:
    return audit.length_stats(t.documents, ["lang"]).select("lang", F.col("min").cast("long"), "median", "mean", F.col("max").cast("long"))


@query("SELECT lang, source, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)) WHERE rank <= 6")
def top_values(t: Tables) -> DataFrame:
    return audit.top_values(t.documents, ["lang"], "source").withColumnRenamed("count", "n").withColumn("rank", F.col("rank").cast("long"))


WINDOW_SQL = """SELECT doc_id, k, k * 192 AS start, least(k * 192 + 256, length(text)) AS stop, substring(text, k * 192 + 1, 256) AS part, text
FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 256) / 192.0), 0) AS BIGINT) + 1)) AS k FROM documents)"""


@query(f"SELECT doc_id, k, start, stop, md5(part) AS part_md5 FROM ({WINDOW_SQL})")
def doc_windows(t: Tables) -> DataFrame:
    w = windows.build_windows(t.documents.select("doc_id", "text"))
    return w.select("doc_id", F.col("k").cast("long").alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.md5("text").alias("part_md5"))


@query(f"SELECT lang, count(*) AS windows, sum(stop - start) AS chars, sum(CASE WHEN stop - start < 256 THEN 1 ELSE 0 END) AS clipped FROM ({WINDOW_SQL}) JOIN documents USING (doc_id) GROUP BY lang")
def window_stats(t: Tables) -> DataFrame:
    w = windows.build_windows(t.documents.select("doc_id", "lang", "text"))
    n = F.col("end") - F.col("start")
    return w.groupBy("lang").agg(F.count("*").alias("windows"), F.sum(n).alias("chars"), F.sum((n < 256).cast("long")).alias("clipped"))


def chars_sql(key: str, text: str, table: str) -> str:
    """(key, i, c): the characters of a text in rows; lead() makes n-grams of them in linear time."""
    return f"(SELECT {key}, unnest(regexp_extract_all({text}, '(?s).')) AS c, unnest(range(length({text}))) AS i FROM {table})"


def grams_sql(key: str, text: str, table: str, n: int) -> str:
    leads = " || ".join(["c", *(f"lead(c, {k}) OVER w" for k in range(1, n))])
    return f"(SELECT {key}, i, g FROM (SELECT {key}, i, {leads} AS g FROM {chars_sql(key, text, table)} WINDOW w AS (PARTITION BY {key} ORDER BY i)) WHERE g IS NOT NULL)"


@query(f"""WITH w AS ({WINDOW_SQL}), m AS (SELECT doc_id, i AS s0, i + 4 AS s1 FROM {grams_sql("doc_id", "text", "documents", 4)} WHERE g = 'tion'), h AS (SELECT DISTINCT doc_id FROM m)
SELECT w.doc_id, w.k, CAST(max(CASE WHEN m.s0 IS NOT NULL AND least(m.s1, w.stop) - greatest(m.s0, w.start) >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS label
FROM w LEFT JOIN m ON m.doc_id = w.doc_id AND m.s0 < w.stop AND m.s1 > w.start GROUP BY ALL""")
def span_window_labels(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", F.transform(X.occurrences(F.col("text"), "tion"), lambda i: F.struct(i.cast("int").alias("start"), (i + 4).cast("int").alias("end"))).alias("spans"))
    w = windows.build_windows(docs)
    return w.select("doc_id", F.col("k").cast("long").alias("k"), F.coalesce(windows.window_label(F.lit(0), F.col("spans"), F.col("start"), F.col("end")), F.lit(0)).cast("long").alias("label"))


@query(f"""WITH o AS (SELECT doc_id, i AS s, i + 3 AS e FROM {grams_sql("doc_id", "text", "documents", 3)} WHERE g = 'ana'),
g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS grp FROM g)
SELECT doc_id, count(*) AS spans, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT doc_id, grp, max(e) - min(s) AS n FROM h GROUP BY doc_id, grp) GROUP BY doc_id""")
def merged_spans(t: Tables) -> DataFrame:
    spans = F.transform(X.occurrences(F.col("text"), "ana"), lambda i: F.struct(i.cast("int").alias("start"), (i + 3).cast("int").alias("end")))
    m = t.documents.select("doc_id", X.merge_spans(spans).alias("m")).where(F.size("m") > 0)
    return m.select("doc_id", F.size("m").cast("long").alias("spans"), F.aggregate("m", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("chars"))


@query("""WITH p AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '(?s).*?[.!?]+["''”’)\\]]*\\s+') AS parts FROM documents),
e AS (SELECT doc_id, n, unnest(list_transform(range(1, len(parts) + 1), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))))) AS e FROM p WHERE len(parts) > 0)
SELECT d.doc_id, 1 + count(e.e) AS starts, CAST(coalesce(sum(e.e), 0) AS BIGINT) AS total FROM documents d LEFT JOIN (SELECT doc_id, e FROM e WHERE e < n) e USING (doc_id) GROUP BY d.doc_id""".replace("\\\\", "\\"))
def sentence_starts(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", X.sentence_starts(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("starts"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query(f"SELECT norm_md5, min(doc_id) AS doc_id, count(*) AS n, md5(arg_min(text, doc_id)) AS raw_md5 FROM (SELECT doc_id, text, md5({NORM}) AS norm_md5 FROM documents) GROUP BY norm_md5")
def exact_dups(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.md5(X.collapse(F.col("text"))).alias("norm_md5"), "text")
    return dedup.exact_groups(rows, "norm_md5", "doc_id").select("norm_md5", "doc_id", "n", F.md5("text").alias("raw_md5"))


@query()
def near_dup_windows(t: Tables) -> DataFrame:
    """Windows of every fifth source as tests against those of the others, within the label: the closest reference of each."""
    docs = t.documents.join(t.labels, "doc_id").select("doc_id", "source", F.col("toxic").alias("group"), "text")
    w = windows.build_windows(docs).select(F.col("window_id").alias("id"), "group", "text", "source")
    test = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 5 == 0
    return dedup.closest(w.where(test), w.where(~test))


@query()
def dup_components(t: Tables) -> DataFrame:
    """Near-duplicate components of the conversations' turns."""
    rows = t.conversations.select(F.concat_ws("#", "conv_id", "turn").alias("id"), F.lit(0).alias("group"), "text").where(F.col("text").isNotNull())
    return dedup.clusters(rows)


@query("""WITH RECURSIVE l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 250),
h AS (SELECT line, min(doc_id) AS hub FROM l GROUP BY line HAVING count(*) > 1),
e AS (SELECT DISTINCT hub AS a, doc_id AS b FROM l JOIN h USING (line) WHERE doc_id <> hub), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def shared_line_components(t: Tables) -> DataFrame:
    """Documents that share a long line, transitively."""
    from ..operators.graph import connected_components

    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 250).select("doc_id", F.md5("line").alias("line")).distinct()
    hubs = lines.groupBy("line").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return connected_components(lines.join(hubs, "line").where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())


@query(f"""WITH d AS (SELECT doc_id, {NORM} AS s FROM documents), b AS (SELECT item_id, {NORM} AS s FROM benchmark),
dg AS (SELECT DISTINCT doc_id, g FROM {grams_sql("doc_id", "s", "d", 5)} UNION SELECT doc_id, s FROM d WHERE length(s) BETWEEN 1 AND 4),
bg AS (SELECT DISTINCT item_id, g FROM {grams_sql("item_id", "s", "b", 5)} UNION SELECT item_id, s FROM b WHERE length(s) BETWEEN 1 AND 4),
dn AS (SELECT doc_id, count(*) AS n FROM dg GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS c FROM dg JOIN bg USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, round(c / CAST(bn.n AS DOUBLE), 6) AS in_doc, round(c / CAST(dn.n AS DOUBLE), 6) AS in_item FROM c JOIN dn USING (doc_id) JOIN bn USING (item_id) WHERE greatest(c / CAST(bn.n AS DOUBLE), c / CAST(dn.n AS DOUBLE)) >= 0.9""")
def containment_benchmark(t: Tables) -> DataFrame:
    c = dedup.contained(t.documents, t.benchmark, 0.9)
    return c.select("doc_id", "item_id", F.round("in_doc", 6).alias("in_doc"), F.round("in_item", 6).alias("in_item"))


@query("""WITH s AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(a.w || b.w)) AS DOUBLE) END, 6) AS jaccard,
round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(a.w)) AS DOUBLE), 6) AS contained
FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def turn_overlap(t: Tables) -> DataFrame:
    """Word Jaccard and containment of neighbouring turns."""
    s = t.conversations.select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    j = s.join(s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])
    return j.select("conv_id", "turn", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"), F.round(X.containment(F.col("w"), F.col("v")), 6).alias("contained"))


_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN {k} ELSE -1 END" for k, p in enumerate(PATTERNS)) + "], lambda x: x >= 0)"


@query(f"SELECT doc_id, CASE WHEN len(h) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, array_to_string(h, ',') AS hits FROM (SELECT doc_id, {_HITS} AS h FROM documents)")
def regex_hits(t: Tables) -> DataFrame:
    """Each pattern is tried once: the score is whether the list of hits has any."""
    found = t.documents.select("doc_id", F.array_join(X.match_list(F.col("text"), PATTERNS).cast("array<string>"), ",").alias("hits"))
    return found.select("doc_id", (F.col("hits") != "").cast("double").alias("score"), "hits")


@query(f"""WITH h AS (SELECT doc_id, toxic, {_HITS} AS h FROM documents JOIN labels USING (doc_id)), x AS (SELECT toxic, len(h) = 1 AS alone, unnest(h) AS pattern FROM h)
SELECT CAST(p.pattern AS INTEGER) AS pattern, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg, count(*) FILTER (toxic = 1 AND alone) AS "unique"
FROM range({len(PATTERNS)}) p(pattern) LEFT JOIN x ON x.pattern = p.pattern GROUP BY 1""")
def regex_pattern_stats(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id")
    return audit.pattern_stats(rows, "doc_id", X.match_list(F.col("text"), PATTERNS), "toxic", len(PATTERNS))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+'))) AS emails, len(list_distinct(list_transform(regexp_extract_all(text, '\$[A-Za-z_]\w*'), lambda x: trim(x)))) AS placeholders FROM documents""")
def entity_counts(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.size(X.entities(c, "email")).cast("long").alias("emails"), F.size(X.entities(c, "placeholder")).cast("long").alias("placeholders"))


@query()
def entity_missing(t: Tables) -> DataFrame:
    """Entities of a turn that the next turn of its conversation lacks, by class, and names."""
    s = t.conversations
    j = s.join(s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])
    gone = F.concat(*(X.missing_entities(F.col("text"), F.col("next"), k) for k, _ in X.ENTITIES))
    return j.select("conv_id", "turn", F.array_join(gone, ",").alias("missing"), F.size(X.names(F.col("text"))).alias("names"))


_TOK = r"regexp_replace(tok, '^[^a-z0-9À-ɏ]+|[^a-z0-9À-ɏ]+$', '', 'g')"


@query(rf"""WITH r AS (SELECT doc_id, toxic AS y, text FROM documents JOIN labels USING (doc_id)), x AS (SELECT DISTINCT doc_id, y, {_TOK} AS token FROM (SELECT doc_id, y, unnest(regexp_split_to_array(lower(text), '\s+')) AS tok FROM r)),
s AS (SELECT * FROM x WHERE length(token) >= 3 AND regexp_matches(token, '[a-zÀ-ɏ]')), n AS (SELECT sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM r),
c AS (SELECT token, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM s GROUP BY token)
SELECT token, a::BIGINT AS pos, b::BIGINT AS neg, round((n1 + n0) * pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n1 - a + n0 - b) * n1 * n0), 6) AS chi2 FROM c, n WHERE a / n1 > b / n0 ORDER BY chi2 DESC, token LIMIT 50""")
def chi2_terms(t: Tables) -> DataFrame:
    return audit.chi2_terms(t.documents.join(t.labels, "doc_id"), "doc_id", "text", "toxic", 50)


@query(r"""WITH r AS (SELECT doc_id, toxic AS y, regexp_extract_all(lower(text), '[a-z0-9_À-ɏ]+') AS w FROM documents JOIN labels USING (doc_id)),
x AS (SELECT DISTINCT doc_id, y, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, y, w, unnest(range(1, len(w))) AS i FROM r WHERE len(w) >= 2)), n AS (SELECT sum(y) AS n1 FROM r)
SELECT gram, sum(y)::BIGINT AS pos, count(*) AS docs, round(sum(y) / count(*)::DOUBLE, 6) AS "precision", round(sum(y) / any_value(n1)::DOUBLE, 6) AS recall FROM x, n GROUP BY gram HAVING sum(y) > 0 ORDER BY "precision" DESC, recall DESC, gram LIMIT 100""")
def ngram_rank(t: Tables) -> DataFrame:
    return audit.ngram_rank(t.documents.join(t.labels, "doc_id"), "doc_id", "toxic", X.word_ngrams(F.col("text"), 2), 100)


@query("""SELECT doc_id, toxic, (row_number() OVER (PARTITION BY toxic ORDER BY md5('val:' || doc_id), doc_id)) <= round_even(0.2 * count(*) OVER (PARTITION BY toxic), 0) AS chosen FROM labels""")
def stratified_split(t: Tables) -> DataFrame:
    return splits.stratified(t.labels, "doc_id", "toxic").select("doc_id", "toxic", "chosen")


@query("""WITH u AS (SELECT source, row_number() OVER (ORDER BY md5('val:' || source), source) <= round_even(0.2 * count(*) OVER (), 0) AS chosen FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, source, chosen FROM documents JOIN u USING (source)""")
def cluster_split(t: Tables) -> DataFrame:
    return splits.by_cluster(t.documents.select("doc_id", "source"), "source")


@query("""WITH z AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), q AS (SELECT lang, greatest(1, round_even(300 * sum(n) / (SELECT count(*) FROM documents)::DOUBLE, 0)) AS quota FROM z GROUP BY lang),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z) SELECT lang, source, n FROM b JOIN q USING (lang) WHERE before < quota""")
def proportional_head(t: Tables) -> DataFrame:
    return splits.proportional_head(t.documents, "lang", "source", 300).withColumnRenamed("count", "n")


@query("SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('balance:' || doc_id), doc_id) AS r FROM labels) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))")
def balanced_classes(t: Tables) -> DataFrame:
    return splits.balanced(t.labels.select("doc_id", "toxic"), "doc_id", "toxic")


@query("SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('few:' || doc_id), doc_id) AS r FROM labels) WHERE r <= 16")
def few_shot(t: Tables) -> DataFrame:
    return splits.few_shot(t.labels.select("doc_id", "toxic"), "doc_id", "toxic", 16)


@query("SELECT lang, source, doc_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source, doc_id) AS nth FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents)) WHERE nth <= 40")
def round_robin(t: Tables) -> DataFrame:
    return splits.round_robin(t.documents.select("lang", "source", "doc_id"), "lang", "source", "doc_id", 40).select("lang", "source", "doc_id", F.col("nth").cast("long").alias("nth"))


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 4 AS shard FROM events")
def interleaved_shards(t: Tables) -> DataFrame:
    e = splits.shard(splits.interleave(t.events.select("event_type", "event_id"), "event_type", "event_id"), "event_type", "event_id", 4)
    return e.select("event_type", "event_id", F.col("turn").cast("long").alias("turn"), F.col("shard").cast("long").alias("shard"))


@query("""WITH r AS (SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)), f AS (SELECT DISTINCT lang AS fold FROM r),
x AS (SELECT fold, CASE WHEN lang = fold THEN 'test' ELSE 'train' END AS role, toxic FROM r, f),
c AS (SELECT fold, count(*) FILTER (role = 'train' AND toxic = 0) AS train_0, count(*) FILTER (role = 'train' AND toxic = 1) AS train_1, count(*) FILTER (role = 'test' AND toxic = 0) AS test_0, count(*) FILTER (role = 'test' AND toxic = 1) AS test_1 FROM x GROUP BY fold)
SELECT *, least(train_0, train_1, test_0, test_1) >= 5 AS usable FROM c""")
def fold_counts(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return splits.fold_usable(splits.folds(rows, "lang"), "toxic", 5)


@query()
def hash_bucket_split(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", splits.hash_bucket("c_custkey", 5, 0).alias("held"), splits.hash_bucket("c_custkey", 3, 2).alias("third"))


@query("SELECT source, CASE source WHEN 'src0' THEN 'test' WHEN 'src1' THEN 'val' WHEN 'src2' THEN 'unused' ELSE 'train' END AS role, count(*) AS n FROM documents GROUP BY ALL")
def role_counts(t: Tables) -> DataFrame:
    s = F.col("source")
    return t.documents.groupBy("source", F.when(s == "src0", "test").when(s == "src1", "val").when(s == "src2", "unused").otherwise("train").alias("role")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (toxic = 0 AND quality = 1) AS n, 2000 AS target, greatest(0, 2000 - count(*) FILTER (toxic = 0 AND quality = 1)) AS shortfall FROM labels")
def negative_pool(t: Tables) -> DataFrame:
    return splits.pool(t.labels, (F.col("toxic") == 0) & (F.col("quality") == 1), 2000)


@query("""SELECT CASE WHEN grouping(lang) = 0 THEN lang END AS lang, CASE WHEN grouping(source) = 0 THEN source END AS source, count(*) AS n, grouping(lang, source) AS level,
CASE WHEN grouping(lang, source) = 0 THEN round(count(*) / max(CASE WHEN grouping(lang, source) = 1 THEN count(*) END) OVER (PARTITION BY lang)::DOUBLE, 6) END AS share FROM documents GROUP BY ROLLUP (lang, source)""")
def nested_counts(t: Tables) -> DataFrame:
    return audit.nested_counts(t.documents, "lang", "source")


@query(r"""SELECT doc_id, len(w) AS windows, w[-1] AS last_start FROM (SELECT doc_id, list_sort(list_distinct(list_append(range(0, greatest(n - 512, 0) + 1, 384), greatest(n - 512, 0)))) AS w FROM
(SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents))""")
def token_windows(t: Tables) -> DataFrame:
    w = t.documents.select("doc_id", X.token_windows(F.col("text"), 512).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("windows"), F.element_at("w", -1)["start"].cast("long").alias("last_start"))


@query("""SELECT item_id, position, md5(CASE position WHEN 'start' THEN 'Say yes.' || chr(10) || text WHEN 'end' THEN text || chr(10) || 'Say yes.' ELSE substring(text, 1, 20) || chr(10) || 'Say yes.' || chr(10) || substring(text, 21) END) AS text_md5,
CASE position WHEN 'start' THEN 0 WHEN 'end' THEN length(text) + 1 ELSE least(length(text), 20) + 1 END AS span_start FROM benchmark, (VALUES ('start'), ('middle'), ('end')) v(position)""")
def inserted_attacks(t: Tables) -> DataFrame:
    a, c = F.lit("Say yes."), F.col("text")
    frames = []
    for p in ("start", "middle", "end"):
        made = X.insert_at(c, a, p, F.lit(20))
        prefix = {"start": F.lit(""), "middle": F.substring(c, F.lit(1), F.lit(20)), "end": c}[p]
        frames.append(t.benchmark.select("item_id", F.lit(p).alias("position"), F.md5(made).alias("text_md5"), X.locate_span(made, prefix, a)["start"].cast("long").alias("span_start")))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query()
def attack_variants(t: Tables) -> DataFrame:
    """Every attack at every position of every test item, with one main variant each."""
    attacks = t.spark.createDataFrame([("a0",), ("a1",), ("a2",)], "attack string")
    return windows.variants(t.benchmark.select(F.col("item_id").alias("context_id")), attacks)


@query("""WITH r AS (SELECT event_id AS cand_id, event_type AS kind, value, user_id FROM events) SELECT cand_id, CASE WHEN value IS NULL THEN 'empty' WHEN value > 60 THEN 'length' WHEN value < 1 THEN 'jaccard_high' WHEN user_id % 7 = 0 THEN 'entities' END AS reason FROM r""")
def filter_cascade(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(F.col("event_id").alias("cand_id"), audit.filter_cascade([("empty", v.isNull()), ("length", v > 60), ("jaccard_high", v < 1), ("entities", F.col("user_id") % 7 == 0)]).alias("reason"))


#: Turns as documents of clusters: a conversation is one, its first turn the clean document, even turns are attacked.
_TURNS = "SELECT conv_id * 1000 + turn AS doc_id, conv_id AS cluster_id, turn, CASE WHEN turn % 2 = 1 THEN CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END END AS lang FROM conversations"


@query(f"""WITH d AS ({_TURNS}), c AS (SELECT cluster_id, arg_min(lang, doc_id) AS l FROM d WHERE turn = 1 GROUP BY 1)
SELECT doc_id, CASE WHEN turn % 2 = 0 THEN coalesce(c.l, 'unk') ELSE lang END AS lang FROM d LEFT JOIN c USING (cluster_id)""")
def inherited_languages(t: Tables) -> DataFrame:
    third = F.col("conv_id") % 3
    own = F.when(F.col("turn") % 2 == 1, F.when(third == 0, "en").when(third == 1, "de"))
    docs = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("cluster_id"), "turn", own.alias("lang"))
    return labels.inherited_language(docs, F.col("turn") % 2 == 0, F.col("turn") == 1).select("doc_id", "lang")


@query("""WITH u AS (SELECT DISTINCT o_orderpriority AS suite, CAST(o_custkey % 40 AS VARCHAR) AS task FROM orders)
SELECT suite, task, row_number() OVER (PARTITION BY suite ORDER BY md5('val:' || task), task) <= greatest(round_even(0.2 * count(*) OVER (PARTITION BY suite), 0), 1) AS chosen FROM u""")
def validation_tasks(t: Tables) -> DataFrame:
    return labels.validation_tasks(t.orders.select(F.col("o_orderpriority").alias("suite"), (F.col("o_custkey") % 40).cast("string").alias("task")), 0.2)


@query("""SELECT event_id, CASE WHEN user_id % 3 = 2 THEN CASE WHEN event_type = 'view' OR value > 20 THEN 'test' ELSE 'excluded' END WHEN value > 20 THEN 'excluded' WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS split,
CASE WHEN event_type = 'view' THEN event_type || '_e6' ELSE event_type END AS source_key FROM (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS value FROM events)""")
def contract_splits(t: Tables) -> DataFrame:
    """Views are clean runs; a value above 20 stands for the held-out attack."""
    view = F.col("event_type") == "view"
    attack = F.when(~view, F.when(F.col("value") > 20, "held").otherwise("other"))
    split = labels.contract_split(F.col("user_id") % 3 == 2, F.col("user_id") % 5 == 0, attack, "held")
    return t.events.select("event_id", split.alias("split"), labels.source_key(F.col("event_type"), F.when(view, "e6")).alias("source_key"))


@query()
def injected_spans(t: Tables) -> DataFrame:
    """Words of the test items as needles in the turns, found as they are or behind YAML escapes."""
    turns = t.conversations.select("conv_id", "turn", F.replace(F.col("text"), F.lit("'"), F.lit("''")).alias("text"))
    needles = F.array(*(F.lit(x) for x in ("the ", "don't", "is not")))
    got = turns.select("conv_id", "turn", injection_spans(F.col("text"), needles).alias("s"))
    return got.select("conv_id", "turn", F.size("s.spans").alias("n"), F.col("s.mode").alias("mode"))
