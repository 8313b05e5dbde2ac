"""Rank metrics, thresholds, bootstrap, tests, episodes and the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..operators import audit, metrics, stats, windows
from .registry import Tables, query

#: A deterministic score with ties, the same in both engines: two hex digits of md5, moved up for label 1.
SCORE_SQL = "(instr('0123456789abcdef', substring(md5('s:' || doc_id), 1, 1)) - 1 + 3 * toxic) / 20.0::DOUBLE"
SCORED = f"SELECT doc_id, source, lang, toxic AS label, {SCORE_SQL} AS score FROM documents JOIN labels USING (doc_id)"


def scored(t: Tables) -> DataFrame:
    digit = F.conv(F.substring(F.md5(F.concat(F.lit("s:"), F.col("doc_id").cast("string"))), 1, 1), 16, 10).cast("int")
    return t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id").select("doc_id", "source", "lang", F.col("toxic").alias("label"), ((digit + 3 * F.col("toxic")) / 20.0).cast("double").alias("score"))


AUC_SQL = """(SELECT {by}, sum(p) AS n_pos, sum(n) AS n_neg, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) END AS auc FROM
(SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {by}, score, sum(label) AS p, sum(1 - label) AS n FROM ({rows}) GROUP BY {by}, score)) GROUP BY {by})"""


@query("""SELECT doc_id, max(k_score) AS score, any_value(lang) AS lang FROM (SELECT doc_id, lang, (length(part) - length(replace(part, 'e', ''))) / greatest(length(part), 1)::DOUBLE AS k_score FROM
(SELECT doc_id, lang, substring(text, k * 192 + 1, 256) AS part FROM (SELECT doc_id, lang, text, unnest(range(0, CAST(greatest(ceil((length(text) - 256) / 192.0), 0) AS BIGINT) + 1)) AS k FROM documents))) GROUP BY doc_id""")
def doc_max_score(t: Tables) -> DataFrame:
    """The score is a function of the window's own text: it is computed where the window is cut, and nothing is joined."""
    return metrics.pooled_scores(letter_share(windows.build_windows(t.documents.select("doc_id", "lang", "text"))).withColumn("dedup_excluded", F.lit(False)), ["lang"])


def letter_share(w: DataFrame) -> DataFrame:
    n = F.length("text")
    return w.withColumn("score", (n - F.length(F.replace(F.col("text"), F.lit("e"), F.lit("")))) / F.greatest(n, F.lit(1)))


@query("""SELECT conv_id * 1000 + turn AS doc_id, max(k_score) AS score FROM (SELECT conv_id, turn, (length(part) - length(replace(part, 'e', ''))) / greatest(length(part), 1)::DOUBLE AS k_score FROM
(SELECT conv_id, turn, substring(text, k * 192 + 1, 256) AS part FROM (SELECT conv_id, turn, text, unnest(range(0, CAST(greatest(ceil((length(text) - 256) / 192.0), 0) AS BIGINT) + 1)) AS k FROM conversations))) GROUP BY 1""")
def turn_max_score(t: Tables) -> DataFrame:
    """The same with the scores in a table of their own, as detectors store them."""
    w = windows.build_windows(t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")).withColumn("dedup_excluded", F.lit(False))
    return metrics.doc_scores(w.drop("text"), letter_share(w).select("window_id", "score"), [])


@query("SELECT lang, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc, 9) AS auc FROM " + AUC_SQL.format(by="lang", rows=SCORED))
def auc_by_group(t: Tables) -> DataFrame:
    return metrics.auc(scored(t), ["lang"]).withColumn("auc", F.round("auc", 9))


@query("SELECT round(avg(auc), 9) AS macro_auc, count(auc) AS n_sources FROM " + AUC_SQL.format(by="source", rows=SCORED))
def macro_auc(t: Tables) -> DataFrame:
    return metrics.macro_auc(metrics.auc(scored(t), ["source"]), []).withColumn("macro_auc", F.round("macro_auc", 9))


ROC_SQL = f"""(SELECT lang, score, tp / np::DOUBLE AS tpr, fp / nn::DOUBLE AS fpr FROM (SELECT lang, score, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY lang) AS np, sum(n) OVER (PARTITION BY lang) AS nn
FROM (SELECT lang, score, sum(label) AS p, sum(1 - label) AS n FROM ({SCORED}) GROUP BY ALL) WINDOW d AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) WHERE np > 0 AND nn > 0)"""


@query(f"SELECT lang, score, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM {ROC_SQL}")
def roc_curve(t: Tables) -> DataFrame:
    return metrics.roc_vertices(scored(t), ["lang"]).select("lang", "score", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(f"""WITH v AS (SELECT lang, fpr, min(tpr) AS low, max(tpr) AS tpr FROM (SELECT lang, fpr, tpr FROM {ROC_SQL} UNION ALL SELECT DISTINCT lang, 0.0, 0.0 FROM {ROC_SQL}) GROUP BY ALL),
s AS (SELECT *, coalesce(lead(fpr) OVER w, 2.0) AS nx, coalesce(lead(low) OVER w, 1.0) AS ny FROM v WINDOW w AS (PARTITION BY lang ORDER BY fpr)), g AS (SELECT unnest([0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0])::DOUBLE AS g)
SELECT lang, g AS fpr, round(least(1.0, CASE WHEN abs(fpr - g) <= 1e-12 OR nx > 1.5 THEN tpr ELSE tpr + (g - fpr) / (nx - fpr) * (ny - tpr) END), 9) AS tpr FROM s JOIN g ON g >= fpr - 1e-12 AND g < nx - 1e-12""")
def roc_grid(t: Tables) -> DataFrame:
    return metrics.roc_grid(scored(t), ["lang"], [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0]).withColumn("tpr", F.round("tpr", 9))


# where no score is admissible the threshold is the next double above all: a hair more than the largest, in SQL
TAU_SQL = f"""(SELECT lang, coalesce(min(score) FILTER (ge / al::DOUBLE <= 0.1), max(score) + 1e-12) AS tau FROM (SELECT lang, score, sum(c) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ge, sum(c) OVER (PARTITION BY lang) AS al FROM
(SELECT lang, score, count(*) AS c FROM ({SCORED}) WHERE label = 0 GROUP BY ALL)) GROUP BY lang)"""


@query(f"SELECT lang, round(tau, 9) AS tau, (SELECT count(*) FROM ({SCORED}) x WHERE x.lang = q.lang AND label = 0) AS n FROM {TAU_SQL} q")
def tau_fpr(t: Tables) -> DataFrame:
    return metrics.tau_fpr(scored(t), ["lang"], 0.1).select("lang", F.round("tau", 9).alias("tau"), "n")


@query(f"""SELECT lang, max(score) FILTER (ge / al::DOUBLE >= 0.9) AS tau, max(al)::BIGINT AS n FROM (SELECT lang, score, sum(c) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ge, sum(c) OVER (PARTITION BY lang) AS al FROM
(SELECT lang, score, count(*) AS c FROM ({SCORED}) WHERE label = 1 GROUP BY ALL)) GROUP BY lang""")
def tau_tpr(t: Tables) -> DataFrame:
    return metrics.tau_tpr(scored(t), ["lang"], 0.9)


@query(f"SELECT lang, round(max(tau), 9) AS tau, round(avg(CASE WHEN label = 1 THEN (score >= tau)::INT::DOUBLE END), 9) AS tpr, round(avg(CASE WHEN label = 0 THEN (score >= tau)::INT::DOUBLE END), 9) AS fpr FROM ({SCORED}) JOIN {TAU_SQL} USING (lang) GROUP BY lang")
def tpr_at_fpr(t: Tables) -> DataFrame:
    r = metrics.rates_at(scored(t), metrics.tau_fpr(scored(t), ["lang"], 0.1), ["lang"])
    return r.select("lang", F.round("tau", 9).alias("tau"), F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("SELECT source, n, CASE WHEN n >= 40 THEN 0.01::DOUBLE WHEN n >= 15 THEN 0.05::DOUBLE END AS fpr FROM (SELECT source, count(*) FILTER (toxic = 0) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def pool_levels(t: Tables) -> DataFrame:
    n = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(F.col("toxic") == 0).alias("n"))
    return n.select("source", "n", metrics.pool_level(F.col("n"), 40, 15).cast("double").alias("fpr"))


DRAWS = settings.BOOTSTRAPS
WEIGHTS_SQL = f"""w AS (SELECT s.lang, s.source, x.draw, count(*) AS w FROM (SELECT lang, slot, draw, (('0x' || substring(md5('boot:' || lang || ':' || draw || ':' || slot), 1, 8))::BIGINT) % k AS no FROM
(SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS k FROM (SELECT DISTINCT lang, source FROM r)), range({DRAWS}) d(draw)) x
JOIN (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS no FROM (SELECT DISTINCT lang, source FROM r)) s ON s.lang = x.lang AND s.no = x.no GROUP BY ALL)"""


@query(f"""WITH r AS ({SCORED}), {WEIGHTS_SQL}, c AS (SELECT lang, source, sum(label)::DOUBLE AS s, count(label) AS n FROM r GROUP BY ALL),
d AS (SELECT lang, draw, sum(w * s) / sum(w * n) AS stat FROM c JOIN w USING (lang, source) GROUP BY ALL)
SELECT lang, round(quantile_cont(stat, 0.025), 9) AS low, round(quantile_cont(stat, 0.975), 9) AS high, count(stat) AS n_valid, count(*) AS n_boot FROM d GROUP BY lang""")
def cluster_bootstrap_rate(t: Tables) -> DataFrame:
    ci = stats.percentile_ci(stats.bootstrap_rate(scored(t), "label", "source", DRAWS, ["lang"]), ["lang"])
    return ci.withColumn("low", F.round("low", 9)).withColumn("high", F.round("high", 9))


BOOT_AUC_SQL = f"""WITH r AS ({SCORED}), {WEIGHTS_SQL}, c AS (SELECT lang, draw, score, sum(w * label) AS p, sum(w * (1 - label)) AS n FROM r JOIN w USING (lang, source) GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang, draw ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
d AS (SELECT lang, draw, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) END AS stat FROM b GROUP BY ALL) """


@query(BOOT_AUC_SQL + "SELECT lang, round(quantile_cont(stat, 0.025), 9) AS low, round(quantile_cont(stat, 0.975), 9) AS high, count(stat) AS n_valid, count(*) AS n_boot FROM d GROUP BY lang")
def bootstrap_auc_ci(t: Tables) -> DataFrame:
    ci = stats.percentile_ci(stats.bootstrap_auc(scored(t), "source", DRAWS, ["lang"]), ["lang"])
    return ci.withColumn("low", F.round("low", 9)).withColumn("high", F.round("high", 9))


@query(BOOT_AUC_SQL + ", m AS (SELECT draw, CASE WHEN count(stat) = count(*) THEN avg(stat) END AS stat FROM d GROUP BY draw) SELECT round(quantile_cont(stat, 0.025), 9) AS low, round(quantile_cont(stat, 0.975), 9) AS high, count(stat) AS n_valid, count(*) AS n_boot FROM m")
def macro_auc_ci(t: Tables) -> DataFrame:
    ci = stats.percentile_ci(stats.macro_draws(stats.bootstrap_auc(scored(t), "source", DRAWS, ["lang"])), [])
    return ci.withColumn("low", F.round("low", 9)).withColumn("high", F.round("high", 9))


@query(BOOT_AUC_SQL + """, e AS (SELECT lang, draw, stat - 0.55 AS x FROM d WHERE stat IS NOT NULL) SELECT lang, round(least(1.0, 2 * least(avg((x <= 0)::INT), avg((x >= 0)::INT))), 9) AS p FROM e GROUP BY lang""")
def paired_diff_p(t: Tables) -> DataFrame:
    """Bootstrap p of the difference to a constant detector of AUC 0.55 on the same draws."""
    a = stats.bootstrap_auc(scored(t), "source", DRAWS, ["lang"])
    return stats.bootstrap_p(stats.paired_diff(a, a.withColumn("stat", F.lit(0.55)), ["lang"]), ["lang"]).withColumn("p", F.round("p", 9))


P_SQL = "SELECT p_brand, p_partkey AS key, (p_retailprice - 899) / 5000 AS p FROM part"


@query(f"""SELECT p_brand, key, round(p, 9) AS p, round(least(1.0, max(f) OVER (PARTITION BY p_brand ORDER BY p, key ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM
(SELECT *, p * (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY p, key) + 1) AS f FROM ({P_SQL}))""")
def holm(t: Tables) -> DataFrame:
    p = t.part.select("p_brand", F.col("p_partkey").alias("key"), ((F.col("p_retailprice") - 899) / 5000).alias("p"))
    return stats.holm(p, ["p_brand"]).select("p_brand", "key", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query("""WITH n AS (SELECT event_type, avg(value) AS c FROM events GROUP BY 1), o AS (SELECT event_type, max(value) / 2 AS obs FROM events GROUP BY 1)
SELECT event_type, round((1 + count(*) FILTER (abs(value - c) >= abs(obs - c) - 1e-12)) / (1 + count(value))::DOUBLE, 9) AS p FROM events JOIN n USING (event_type) JOIN o USING (event_type) GROUP BY 1""")
def randomization_p(t: Tables) -> DataFrame:
    nulls = t.events.select("event_type", "value")
    observed = t.events.groupBy("event_type").agg((F.max("value") / 2).alias("value"))
    return stats.randomization_p(nulls, observed, ["event_type"]).withColumn("p", F.round("p", 9))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max, count(*) AS n FROM orders GROUP BY 1")
def seed_summary(t: Tables) -> DataFrame:
    s = stats.seed_summary(t.orders.select("o_orderpriority", F.col("o_totalprice").alias("value")), ["o_orderpriority"], 5)
    return s.select("o_orderpriority", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "min", "max", "n")


@query("SELECT l_returnflag, avg(l_discount) - 0.002 >= -0.05 * avg(l_tax) AND avg(l_discount) - 0.05 <= 0.05 * avg(l_tax) AS equivalent FROM lineitem GROUP BY 1")
def tost_decisions(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return m.select("l_returnflag", stats.tost(F.col("d") - 0.002, F.col("d") - 0.05, F.col("t")).alias("equivalent"))


@query()
def power_table(t: Tables) -> DataFrame:
    """Power of a paired AUC difference for each language's own size and number of sources."""
    cells = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_clusters"))
    cells = cells.select(F.crc32("lang").alias("cell"), "n_docs", "n_clusters", F.lit(0.8).alias("auc"), F.lit(0.05).alias("delta"), F.lit(0.2).alias("icc"), F.lit(0.5).alias("rho"))
    return stats.power_grid(cells, reps=5)


#: Episodes: a conversation is one; a turn's score is a hash digit, classes and steps are taken from its id.
STEPS_SQL = "SELECT conv_id AS episode_id, turn AS step, (instr('0123456789abcdef', substring(md5('t:' || conv_id || ':' || turn), 1, 1)) - 1) / 15.0::DOUBLE AS score FROM conversations"
EPISODES_SQL = f"""(SELECT e.*, s.alarm_step, coalesce(s.score, 0.0) AS score, coalesce(s.n_steps, 0) AS n_steps FROM (SELECT DISTINCT conv_id AS episode_id, ['hijacked', 'injection_ignored', 'benign'][CAST(conv_id % 3 AS INT) + 1] AS episode_class,
CASE WHEN conv_id % 3 = 0 THEN ['full', 'name_only', 'unmatched'][CAST((conv_id // 3) % 3 AS INT) + 1] END AS match, CASE WHEN conv_id % 3 < 2 THEN 1 END AS injection_step, CASE WHEN conv_id % 3 = 0 AND (conv_id // 3) % 3 < 2 THEN 3 END AS first_harmful_step FROM conversations) e
LEFT JOIN (SELECT episode_id, max(score) AS score, min(step) FILTER (score >= 0.8) AS alarm_step, count(*) AS n_steps FROM ({STEPS_SQL}) GROUP BY 1) s USING (episode_id))"""


def episodes(t: Tables) -> tuple[DataFrame, DataFrame]:
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("t"), "conv_id", "turn")), 1, 1), 16, 10).cast("int")
    steps = t.conversations.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("step"), (digit / 15.0).cast("double").alias("score"))
    c, third = F.col("conv_id") % 3, F.floor(F.col("conv_id") / 3) % 3
    e = t.conversations.select("conv_id").distinct().select(
        F.col("conv_id").alias("episode_id"), F.when(c == 0, "hijacked").when(c == 1, "injection_ignored").otherwise("benign").alias("episode_class"),
        F.when(c == 0, F.when(third == 0, "full").when(third == 1, "name_only").otherwise("unmatched")).alias("match"), F.when(c < 2, 1).alias("injection_step"), F.when((c == 0) & (third < 2), 3).alias("first_harmful_step"),
    )
    return e, steps


@query(f"SELECT episode_id, alarm_step, score, n_steps FROM {EPISODES_SQL}")
def episode_alarms(t: Tables) -> DataFrame:
    return metrics.episode_alarms(*episodes(t), 0.8).select("episode_id", "alarm_step", "score", "n_steps")


@query(f"""WITH r AS (SELECT *, alarm_step - injection_step AS delay, episode_class = 'hijacked' AND match <> 'unmatched' AND first_harmful_step IS NOT NULL AS eligible FROM {EPISODES_SQL})
SELECT episode_id % 2 AS part, count(*) FILTER (episode_class = 'hijacked') AS n_hijacked, count(*) FILTER (eligible) AS n_hijacked_eligible, count(*) FILTER (eligible AND injection_step <= alarm_step AND alarm_step < first_harmful_step) AS n_stopped,
round(100.0 * count(*) FILTER (episode_class = 'benign' AND alarm_step IS NOT NULL) / nullif(count(*) FILTER (episode_class = 'benign'), 0), 9) AS false_alarms_per_100_benign,
round(avg(delay) FILTER (episode_class = 'hijacked' AND delay >= 0), 9) AS detection_delay_mean, quantile_cont(delay, 0.5) FILTER (episode_class = 'hijacked' AND delay >= 0) AS detection_delay_median,
count(*) FILTER (episode_class = 'hijacked' AND delay < 0) AS n_early_alarms, count(*) FILTER (episode_class = 'injection_ignored' AND alarm_step IS NOT NULL) AS alarms_on_injection_ignored FROM r GROUP BY 1""")
def contract_metrics(t: Tables) -> DataFrame:
    m = metrics.contract_metrics(metrics.episode_alarms(*episodes(t), 0.8).withColumn("part", F.col("episode_id") % 2), ["part"])
    return m.select("part", "n_hijacked", "n_hijacked_eligible", "n_stopped", F.round("false_alarms_per_100_benign", 9).alias("false_alarms_per_100_benign"), F.round("detection_delay_mean", 9).alias("detection_delay_mean"), "detection_delay_median", "n_early_alarms", "alarms_on_injection_ignored")


@query()
def contract_validate(t: Tables) -> DataFrame:
    """Broken rules of contract rows made from the episodes, every seventh of which is given twice."""
    e = metrics.episode_alarms(*episodes(t), 0.8).withColumn("variant", F.lit("v")).withColumn("threshold", F.lit(0.9)).withColumn("episode_id", F.col("episode_id").cast("string"))
    return audit.validate_contract(e.unionByName(e.where(F.col("episode_id") % 7 == 0)))


@query("""WITH m AS (SELECT 'test' AS list, doc_id AS id FROM labels WHERE toxic = 1 UNION ALL SELECT 'train', doc_id FROM labels WHERE quality = 1) SELECT id, count(DISTINCT list) AS lists, string_agg(DISTINCT list, ',' ORDER BY list) AS names FROM m GROUP BY id HAVING count(DISTINCT list) > 1""")
def manifest_disjoint(t: Tables) -> DataFrame:
    a, b = (t.labels.where(F.col(c) == 1).select(F.lit(n).alias("list"), F.col("doc_id").alias("id")) for n, c in (("test", "toxic"), ("train", "quality")))
    return audit.manifest_overlaps(a.unionByName(b))


@query("""WITH a AS (SELECT doc_id FROM labels WHERE toxic = 1), b AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT doc_id, 'only_a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT doc_id, 'only_b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def manifest_difference(t: Tables) -> DataFrame:
    return audit.manifest_difference(t.labels.where("toxic = 1").select("doc_id"), t.labels.where("quality = 0").select("doc_id"))


@query("""WITH s AS (SELECT conv_id, min(turn) FILTER (role = 'assistant' AND contains(text, 'th')) AS f, min(turn) FILTER (role = 'assistant') AS n FROM conversations GROUP BY 1)
SELECT conv_id AS episode_id, coalesce(f, n) AS first_harmful_step, CASE WHEN f IS NOT NULL THEN 'full' WHEN n IS NOT NULL THEN 'name_only' ELSE 'unmatched' END AS match FROM s""")
def first_match_step(t: Tables) -> DataFrame:
    """A turn is a call whose function is its role and whose argument is its text; the reference is an assistant call whose text has 'th'."""
    steps = t.conversations.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("step"), F.col("role").alias("function"), F.create_map(F.lit("text"), "text").alias("args"))
    refs = steps.select("episode_id").distinct().select("episode_id", F.lit("assistant").alias("function"), F.create_map(F.lit("text"), F.lit("th")).alias("args"))
    case = steps.withColumn("args", F.create_map(F.lit("text"), F.replace(F.col("args")["text"], F.lit("T"), F.lit("~"))))
    return metrics.first_harmful_step(case, refs)


@query()
def trace_steps(t: Tables) -> DataFrame:
    """Conversations as traces: user turns are tool answers to the assistant calls before them, without ids."""
    m = t.conversations.select("conv_id", "turn", F.struct(
        F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("reply").alias("function"), F.create_map(F.lit("n"), F.col("turn").cast("string")).alias("args"), F.lit(None).cast("string").alias("id")))).alias("tool_calls"),
        F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("error")).alias("m"))
    trace = m.groupBy(F.col("conv_id").alias("episode_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m")), lambda a, b: (a["turn"] - b["turn"]).cast("int")), lambda x: x["m"]).alias("messages"))
    s = windows.tool_steps(trace)
    return s.select("episode_id", "step", F.md5("content").alias("content_md5"), "function", F.col("args")["n"].alias("n"))
