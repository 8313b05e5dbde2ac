"""Feature, model, relational and event-time queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import audit, features, models
from ..streaming import streams
from .corpus import grams_sql
from .registry import Tables, query

GRAMS = f"""g AS (SELECT doc_id, g FROM {grams_sql("doc_id", "lower(text)", "documents", 3)} UNION ALL SELECT doc_id, g FROM {grams_sql("doc_id", "lower(text)", "documents", 4)} UNION ALL SELECT doc_id, g FROM {grams_sql("doc_id", "lower(text)", "documents", 5)}),
e AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL), c AS (SELECT doc_id, CAST((('0x' || substring(md5(g), 1, 8))::BIGINT) % 51 AS INTEGER) AS bin, sum(n)::BIGINT AS cnt FROM e GROUP BY ALL)"""


def md5_counts(t: Tables) -> DataFrame:
    return features.hashed_ngrams(t.documents, "doc_id", 51, md5_bins=True)


@query(f"WITH {GRAMS} SELECT doc_id, bin, cnt FROM c")
def hashed_ngrams(t: Tables) -> DataFrame:
    return md5_counts(t)


@query()
def hashed_ngrams_xx(t: Tables) -> DataFrame:
    return features.hashed_ngrams(t.documents, "doc_id")


@query(f"WITH {GRAMS} SELECT doc_id, bin, round(ln(1 + cnt) / sum(ln(1 + cnt)) OVER (PARTITION BY doc_id), 9) AS value FROM c")
def log_unit_sum(t: Tables) -> DataFrame:
    return features.log_unit_sum(md5_counts(t), "doc_id").withColumn("value", F.round("value", 9))


@query(f"WITH {GRAMS}, f AS (SELECT doc_id, bin, cnt / sum(cnt) OVER (PARTITION BY doc_id) AS v FROM c) SELECT bin, round(sum(v) / (SELECT count(*) FROM documents), 9) AS mean FROM f GROUP BY bin")
def bin_means(t: Tables) -> DataFrame:
    n = t.documents.count()
    return features.centred(features.fractions(md5_counts(t), "doc_id"), n).withColumn("mean", F.round("mean", 9))


@query(f"""WITH {GRAMS}, i AS (SELECT bin, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT doc_id))) + 1 AS idf FROM c GROUP BY bin), x AS (SELECT doc_id, bin, cnt * idf AS v FROM c JOIN i USING (bin))
SELECT doc_id, bin, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS value FROM x""")
def tfidf(t: Tables) -> DataFrame:
    return features.tfidf(md5_counts(t), "doc_id", t.documents.count()).withColumn("value", F.round("value", 9))


VEC = "v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS bin, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def long_vectors(t: Tables) -> DataFrame:
    return features.dense_to_long(t.embeddings, "vec_id", "embedding")


@query(f"WITH {VEC} SELECT vec_id, bin, round(value / sqrt(sum(value * value) OVER (PARTITION BY vec_id)), 9) AS value FROM v")
def unit_vectors(t: Tables) -> DataFrame:
    x = features.unit_rows(long_vectors(t), "vec_id")
    return x.select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("value", 9).alias("value"))


EDGES = "ed AS (SELECT cell, bin FROM (SELECT c.cell, b.bin, row_number() OVER (PARTITION BY c.cell ORDER BY md5('edges:' || c.cell || ':' || b.bin), b.bin) AS r FROM range(256) c(cell), range(64) b(bin)) WHERE r <= 6)"
CODES = f"""{VEC}, {EDGES}, m AS (SELECT bin, sum(value) / (SELECT count(*) FROM embeddings) AS mean FROM v GROUP BY bin), o AS (SELECT cell, sum(mean) AS off FROM ed JOIN m USING (bin) GROUP BY cell),
a AS (SELECT vec_id, any_value(label) AS label, cell, round(sum(value) - any_value(off), 9) AS value FROM v JOIN ed USING (bin) JOIN o USING (cell) GROUP BY vec_id, cell),
k AS (SELECT vec_id, label, cell FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, cell) AS r FROM a) WHERE r <= 13)"""


def codes(t: Tables) -> DataFrame:
    x = long_vectors(t)
    edges = features.random_edges(256, 64, 6, t.spark)
    a = features.expand(x, edges, "vec_id", features.centred(x, t.embeddings.count())).withColumn("value", F.round("value", 9))
    return features.winners(a, "vec_id", "cell", features.k_for(256, 0.05))


@query(f"WITH {CODES} SELECT vec_id, cell FROM k")
def kwta_codes(t: Tables) -> DataFrame:
    return codes(t).select("vec_id", F.col("cell").cast("long").alias("cell"))


@query(f"""WITH {CODES}, t AS (SELECT vec_id, cell, (label >= 5)::INT AS y FROM k), n AS (SELECT y, cell, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT t.vec_id, 1 - avg(coalesce(pow(0.9, n1.n), 1.0)) AS p1, 1 - avg(coalesce(pow(0.9, n0.n), 1.0)) AS p0 FROM t LEFT JOIN n n1 ON n1.cell = t.cell AND n1.y = 1 LEFT JOIN n n0 ON n0.cell = t.cell AND n0.y = 0 GROUP BY 1)
SELECT vec_id, round((p1 - p0 + 1) / 2, 7) AS score FROM p""")
def bloom_score(t: Tables) -> DataFrame:
    k = codes(t)
    labels = t.embeddings.select("vec_id", (F.col("label") >= 5).cast("int").alias("label"))
    return models.bloom_score(k, models.bloom_fit(k, labels, "vec_id", "cell", 0.9), "vec_id", "cell").withColumn("score", F.round("score", 7))


@query(f"""WITH {VEC}, u AS (SELECT vec_id, (label >= 5)::INT AS y, bin, value / sqrt(sum(value * value) OVER (PARTITION BY vec_id)) AS value FROM v), m AS (SELECT y, bin, avg(value) AS value FROM u GROUP BY ALL),
c AS (SELECT y, bin, value / sqrt(sum(value * value) OVER (PARTITION BY y)) AS value FROM m), d AS (SELECT bin, sum(CASE WHEN y = 1 THEN value ELSE -value END) AS d FROM c GROUP BY bin)
SELECT vec_id, round((sum(value * d) + 1) / 2, 7) AS score FROM u JOIN d USING (bin) GROUP BY vec_id""")
def centroid_score(t: Tables) -> DataFrame:
    x = long_vectors(t)
    labels = t.embeddings.select("vec_id", (F.col("label") >= 5).cast("int").alias("label"))
    return models.centroid_score(x, labels, x, "vec_id").withColumn("score", F.round("score", 7))


@query()
def knn_cosine(t: Tables) -> DataFrame:
    """The five nearest of every fifth label's vectors among the others."""
    e = t.embeddings
    n = models.knn(e.where("label % 5 = 0").select(F.col("vec_id").alias("q"), "embedding"), e.where("label % 5 <> 0").select(F.col("vec_id").alias("r"), "embedding"), "q", "r", "embedding", 5)
    return n


@query()
def logistic_scores(t: Tables) -> DataFrame:
    """Training scores of a balanced logistic regression on the embeddings."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = t.embeddings.select("vec_id", (F.col("label") >= 5).cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    m = models.logistic(rows, "features", "label", 1.0)
    return m.transform(rows.select("vec_id", "features")).select("vec_id", F.round(vector_to_array("probability")[1], 6).alias("score"))


@query()
def svd_components(t: Tables) -> DataFrame:
    v, s = features.gram_svd(long_vectors(t), 64, 8, "vec_id")
    return t.spark.createDataFrame([(int(k), int(i), float(v[i, k]), float(s[k])) for k in range(v.shape[1]) for i in range(v.shape[0])], "component int, bin int, weight double, singular double")


@query(f"WITH {EDGES}, d AS (SELECT cell, count(*) AS n FROM ed GROUP BY cell) SELECT count(*) AS cells, sum(n)::BIGINT AS edges, avg(n) AS mean, stddev_pop(n) AS sd, min(n) AS min, max(n) AS max FROM d")
def indegree(t: Tables) -> DataFrame:
    return features.indegree_stats(features.random_edges(256, 64, 6, t.spark))


@query()
def curveball_nulls(t: Tables) -> DataFrame:
    """Three degree-preserving shuffles of a fixed graph."""
    edges = features.random_edges(64, 32, 4, t.spark).toPandas()[["cell", "bin"]].to_numpy()
    return features.curveball_chains(edges, t.spark.createDataFrame([(1,), (2,), (3,)], "chain long"))


# joins, sets, groupings

@query("SELECT n_name, count(*) AS customers, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def inner_join(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["orders"])


@query("SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, l.toxic, d.lang FROM labels l FULL JOIN (SELECT * FROM documents WHERE lang <> 'en') d ON l.doc_id = d.doc_id")
def full_join(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", "toxic").join(t.documents.where("lang <> 'en'").select("doc_id", "lang"), "doc_id", "full_outer")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("SELECT n_name, r_name FROM nation, region")
def cross_join(t: Tables) -> DataFrame:
    return t.nation.select("n_name").crossJoin(t.region.select("r_name"))


@query("SELECT a.s_suppkey AS a, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal GROUP BY 1")
def theta_join(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("a"), "s_nationkey", F.col("s_acctbal").alias("x"))
    b = t.supplier.select("s_nationkey", F.col("s_acctbal").alias("y"))
    return a.join(b, (a.s_nationkey == b.s_nationkey) & (F.col("x") < F.col("y"))).groupBy("a").agg(F.count("*").alias("richer"))


@query("SELECT lang FROM documents UNION SELECT role FROM conversations UNION SELECT event_type FROM events")
def set_union(t: Tables) -> DataFrame:
    return t.documents.select("lang").union(t.conversations.select("role")).union(t.events.select("event_type")).distinct()


@query("SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def set_intersect(t: Tables) -> DataFrame:
    return t.labels.where("toxic = 1").select("doc_id").intersect(t.documents.where("lang = 'en'").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY 1")
def corpus_pivot(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().fillna(0)


@query("SELECT user_id, event_type, CASE WHEN grouping(user_id) = 1 AND grouping(event_type) = 1 THEN 'all' ELSE 'part' END AS level, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((user_id), (event_type), (user_id, event_type), ())")
def spend_rollup(t: Tables) -> DataFrame:
    g = t.events.groupingSets([["user_id"], ["event_type"], ["user_id", "event_type"], []], "user_id", "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.when(F.grouping_id() == 3, "all").otherwise("part").alias("level"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def spend_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 20) AS hits, round(count(*) FILTER (value > 20) / count(*)::DOUBLE, 4) AS rate, bool_or(value > 80) AS any_high, bool_and(value > 0) AS all_positive FROM events GROUP BY 1")
def usage_rates(t: Tables) -> DataFrame:
    hit = F.col("value") > 20
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 4).alias("rate"), F.bool_or(F.col("value") > 80).alias("any_high"), F.bool_and(F.col("value") > 0).alias("all_positive"))


@query("SELECT user_id, round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) * CASE WHEN hour(ts) BETWEEN 1 AND 3 AND isodow(ts) <= 5 THEN 2.0 ELSE 1.0 END / 1e6), 9) AS cost FROM events GROUP BY 1")
def usage_cost(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("user_id").agg(F.round(F.sum(audit.usage_cost(F.lit(0), F.lit(0), k, (0.0, 0.0, 1.0), audit.is_peak(F.col("ts")))), 9).alias("cost"))


@query("SELECT event_id, user_id, running, first_type FROM (SELECT event_id, user_id, row_number() OVER w AS running, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def running_counters(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", F.row_number().over(w).cast("long").alias("running"), F.first("event_type").over(w).alias("first_type"))


@query("SELECT source, min(n) AS low, max(n) AS high, avg(n) AS mean, arg_max(lang, (n, lang)) AS modal FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def envelopes(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source", "lang").count()
    return n.groupBy("source").agg(F.min("count").alias("low"), F.max("count").alias("high"), F.avg("count").alias("mean"), F.max_by("lang", F.struct("count", "lang")).alias("modal"))


@query("""SELECT regexp_extract(lower(url), '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS n FROM pages WHERE regexp_extract(lower(url), '^[a-z]+://([^/:]+)', 1) NOT IN ('localhost') GROUP BY 1""")
def host_audit(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("localhost",)], "host string")
    return t.pages.select(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:]+)", 1).alias("host")).join(allowed, "host", "left_anti").groupBy("host").agg(F.count("*").alias("n"))


@query()
def json_numbers(t: Tables) -> DataFrame:
    """Leaves of the events' JSON as (path, value) rows, counted."""
    return t.events.select(F.explode(audit.json_leaves(F.col("props"))).alias("x")).groupBy("x.path").agg(F.count("*").alias("n"), F.count_distinct("x.value").alias("values"))


# event time

@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    return streams.tumbling(t.events, "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


@query("""SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL '30 minutes', ts) - unnest([INTERVAL '0 minutes', INTERVAL '30 minutes']) AS s FROM events) GROUP BY ALL""")
def stream_sliding(t: Tables) -> DataFrame:
    return streams.sliding(t.events, "1 hour", "30 minutes", ["event_type"]).withColumn("total", F.round("total", 4))


@query("""WITH l AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '10 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '10 minutes' AS "end", count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, grp""")
def stream_session(t: Tables) -> DataFrame:
    return streams.sessions(t.events, "10 minutes", ["user_id"]).withColumn("total", F.round("total", 4))
