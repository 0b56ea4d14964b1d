"""Queries over reviews, decisions, results of judges and runs, and evidence for events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import datasets, metrics, reviews, runs, story, traces
from plumbline.operators.story import Config
from plumbline.plans.base import registry, table
from plumbline.plans.ranking import BM25

QUERIES, ORACLES, query = registry()


@query("""
WITH c AS (SELECT l_orderkey AS s, l_linenumber AS i, l_discount, l_tax, l_linestatus, l_returnflag FROM lineitem),
d AS (SELECT s, CAST(i AS BIGINT) AS i, l_discount < 0.05 AS keep FROM c WHERE l_linestatus = 'F' UNION ALL SELECT s, i, FALSE FROM c WHERE l_tax > 0.07 UNION ALL SELECT s, i + 100, TRUE FROM c WHERE l_returnflag = 'R' AND l_tax < 0.005),
g AS (SELECT s, i, count(*) AS n, bool_and(keep) AS keep FROM d GROUP BY s, i)
SELECT c.s AS story_id, CAST(c.i AS BIGINT) AS id, 'state' AS kind, CASE WHEN coalesce(n, 0) <> 1 THEN 'pending' WHEN keep THEN 'kept' ELSE 'discarded' END AS told FROM c LEFT JOIN g ON g.s = c.s AND g.i = c.i
UNION ALL SELECT coalesce(c.s, g.s), coalesce(CAST(c.i AS BIGINT), g.i), 'issue', CASE WHEN c.s IS NULL THEN 'unknown candidate' WHEN n IS NULL THEN 'no decision' ELSE 'repeated decision' END FROM c FULL JOIN g ON g.s = c.s AND g.i = c.i WHERE c.s IS NULL OR n IS NULL OR n > 1
""")
def importance_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as candidates: which are kept, discarded or open by the decisions on them, and which decisions don't fit."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").cast("long").alias("id"), "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    d = c.where("l_linestatus = 'F'").select("story_id", "id", (F.col("l_discount") < 0.05).alias("keep"))
    d = d.unionByName(c.where("l_tax > 0.07").select("story_id", "id", F.lit(False).alias("keep"))).unionByName(c.where("l_returnflag = 'R' AND l_tax < 0.005").select("story_id", (F.col("id") + 100).alias("id"), F.lit(True).alias("keep")))
    states, issues = reviews.importance_review(c, d)
    return states.select("story_id", "id", F.lit("state").alias("kind"), F.col("state").alias("told")).unionByName(issues.select("story_id", "id", F.lit("issue").alias("kind"), F.col("issue").alias("told")))


@query("""
WITH gold AS (SELECT o_custkey AS c, min(o_orderkey) AS g FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o_custkey AS case_id, o_orderkey AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'hallucinated' WHEN g IS NULL THEN 'overselected' ELSE 'valid_checkable' END AS label,
  CASE WHEN o_orderstatus <> 'F' AND g IS NOT NULL THEN CAST(g AS VARCHAR) ELSE '' END AS gold_ids, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS note
FROM orders LEFT JOIN gold ON c = o_custkey
""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger whose pending rows are decided: open orders point to the customer's first closed one, if there is one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("event_id"), "o_orderstatus", "o_orderpriority")
    gold = o.where("o_orderstatus = 'F'").select("case_id", F.col("event_id").alias("gold_id"))
    none = F.array().cast("array<long>")
    ledger = o.select("case_id", "event_id", F.when(F.col("o_orderstatus") == "F", "hallucinated").otherwise(reviews.PENDING).alias("label"), none.alias("gold_ids"))
    first = gold.groupBy("case_id").agg(F.min("gold_id").alias("g"))
    d = o.where("o_orderstatus <> 'F'").join(first, "case_id", "left")
    d = d.select("case_id", "event_id", F.when(F.col("g").isNull(), "overselected").otherwise("valid_checkable").alias("label"), F.when(F.col("g").isNull(), none).otherwise(F.array("g")).alias("gold_ids"), F.col("o_orderpriority").alias("note"))
    return reviews.decided(ledger, d, gold).select("case_id", "event_id", "label", F.array_join("gold_ids", ",").alias("gold_ids"), "note")


@query("""
WITH r AS (SELECT event_type AS e, CASE WHEN value > 30 THEN event_type ELSE 'view' END AS p, value <= 90 AS ok, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS a FROM events)
SELECT count(*) AS facts, count(*) FILTER (ok AND e = p) AS correct, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (a > 1) AS retried,
  round(count(*) FILTER (ok AND e = p) / count(*), 6) AS accuracy, round(count(*) FILTER (NOT ok) / count(*), 6) AS parse_failure_rate, round(count(*) FILTER (a > 1) / count(*), 6) AS retry_rate FROM r
""")
def judge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, failures and retries of guesses about events."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("expected"), F.when(F.col("value") > 30, F.col("event_type")).otherwise("view").alias("predicted"), F.when(F.col("value") <= 90, "ok").otherwise("error").alias("status"), F.when(F.col("user_id") % 3 == 0, 2).otherwise(1).alias("attempts"))
    return metrics.judge_results(rows)


@query("""
WITH s AS (SELECT user_id, sum(value) AS seconds FROM events GROUP BY user_id)
SELECT round((SELECT median(value / 10) FROM events), 6) AS ttft_median, round((SELECT sum(event_id % 97) / sum(value) FROM events), 6) AS decode_rate, count(*) AS stories, round(median(seconds), 6) AS latency_median,
  round(quantile_disc(seconds, 0.95), 6) AS latency_p95, round(count(*) / 3600.0, 6) AS stories_per_second FROM s
""")
def performance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies and rates: events as calls, users as stories."""
    e = table(spark, sf_dir, "events")
    calls = e.select((F.col("value") / 10).alias("ttft"), (F.col("event_id") % 97).alias("output_tokens"), F.col("value").alias("decode"))
    return metrics.performance(calls, e.groupBy("user_id").agg(F.sum("value").alias("seconds")).select("seconds"), 3600.0)


@query("SELECT day(ts) AS run, round(sum(value), 6) AS total, max(value) AS peak, count(*) AS n FROM events WHERE day(ts) > 3 GROUP BY day(ts)")
def measured_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and peaks by day, without three days of warming up."""
    e = table(spark, sf_dir, "events").select(F.dayofmonth("ts").cast("long").alias("run"), "value")
    return traces.measured_runs(e, "run", 3, "value")


@query("""
SELECT event_type, count(*) AS steps, CAST(sum(1 + length(props) % 4) AS BIGINT) AS tokens, count(*) FILTER (length(props) % 4 > 0) AS multi_token_steps, round(sum(1 + length(props) % 4) / count(*), 6) AS tokens_per_step FROM events GROUP BY event_type
""")
def step_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that decoding steps commit, by kind of event."""
    e = table(spark, sf_dir, "events").select("event_type", (1 + F.length("props") % 4).alias("committed"))
    return traces.commit_steps(e, "event_type")


@query("""
WITH r AS (SELECT 'short' AS retrieval, doc_id, lang, n_chars FROM documents WHERE n_chars < 1000 UNION ALL SELECT 'all', doc_id, lang, n_chars FROM documents)
SELECT retrieval, 'length' AS judge, doc_id, n_chars > 500 AS verdict FROM r UNION ALL SELECT retrieval, 'language', doc_id, lang = 'en' FROM r
""")
def paired_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of two selections of documents with each of two judges."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    find = {"short": lambda x: x.where("n_chars < 1000"), "all": lambda x: x}
    decide = {"length": lambda x: x.select("doc_id", (F.col("n_chars") > 500).alias("verdict")), "language": lambda x: x.select("doc_id", (F.col("lang") == "en").alias("verdict"))}
    return runs.paired(d, find, decide)


@query("""
WITH m AS (SELECT md5(coalesce(text, '')) AS h, lang, coalesce(source, 'none') AS s, n_chars FROM documents),
i AS (SELECT lang || '-' || h AS fixture_id, CASE lang WHEN 'en' THEN '一致' WHEN 'fr' THEN '矛盾' ELSE '不确定' END AS expected, [s, substr(h, 1, 1), substr(h, 2, 1)] AS lore, CASE WHEN n_chars > 3000 THEN [] WHEN substr(h, 3, 1) = '0' THEN ['other'] ELSE [s] END AS canonical,
  count(*) OVER (PARTITION BY lang || '-' || h) AS n FROM m)
SELECT fixture_id, 'id' AS rule FROM i WHERE n > 1 UNION ALL SELECT fixture_id, 'lore' FROM i WHERE lore[2] = lore[3] UNION ALL SELECT fixture_id, 'canonical' FROM i WHERE len(canonical) = 1 AND canonical[1] = 'other'
UNION ALL SELECT fixture_id, 'evidence' FROM i WHERE expected <> '不确定' AND len(canonical) = 0
UNION ALL SELECT NULL, 'balance of ' || expected FROM i GROUP BY expected HAVING count(*) <> 300
""")
def fixture_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with items made from documents: repeats, evidence twice or missing, labels out of balance."""
    h, s = F.md5(F.coalesce("text", F.lit(""))), F.coalesce("source", F.lit("none"))
    d = table(spark, sf_dir, "documents").select(h.alias("h"), "lang", s.alias("s"), "n_chars")
    items = d.select(
        F.concat_ws("-", "lang", "h").alias("fixture_id"),
        F.when(F.col("lang") == "en", "一致").when(F.col("lang") == "fr", "矛盾").otherwise("不确定").alias("expected"),
        F.array("s", F.substring("h", 1, 1), F.substring("h", 2, 1)).alias("lore"),
        F.when(F.col("n_chars") > 3000, F.array().cast("array<string>")).when(F.substring("h", 3, 1) == "0", F.array(F.lit("other"))).otherwise(F.array("s")).alias("canonical"),
    )
    return datasets.fixture_problems(items, 300, 3)


@query("""
WITH sets AS (SELECT l_orderkey AS k, array_to_string(list_sort(list_distinct(list('P' || l_partkey))), ',') AS lore FROM lineitem GROUP BY l_orderkey)
SELECT 'OR-' || o_custkey || '-' || o_orderkey AS fixture_id, o_custkey AS case_id, o_orderkey AS gold_id, CASE WHEN o_orderstatus = 'F' THEN '一致' WHEN o_orderstatus = 'P' THEN '矛盾' WHEN o_totalprice > 200000 THEN '矛盾' ELSE '不确定' END AS expected,
  CASE WHEN o_orderstatus = 'O' THEN 'C' || o_custkey ELSE lore END AS lore, CASE WHEN o_orderstatus <> 'O' THEN 'minimum_evidence_set' WHEN o_totalprice > 200000 THEN 'manual_label_override' ELSE 'manual_curation' END AS source
FROM orders JOIN sets ON k = o_orderkey
""")
def oracle_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge should get for each order: the parts of decided ones, what a curator chose for open ones."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    sets = line.groupBy(F.col("l_orderkey").alias("gold_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("P"), "l_partkey"))).alias("lore"))
    base = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("gold_id"), F.md5(F.col("o_orderkey").cast("string")).alias("normalized_fact"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    said = F.when(F.col("o_orderstatus") == "F", "一致").when(F.col("o_orderstatus") == "P", "矛盾").otherwise("不确定")
    facts = base.join(sets, "gold_id").select("case_id", "gold_id", "normalized_fact", said.alias("expected"), F.array("lore").alias("sets"))
    open_ = base.where("o_orderstatus = 'O'")
    curated = open_.select("normalized_fact", F.array(F.concat(F.lit("C"), "case_id")).alias("lore"), F.col("o_orderpriority").alias("rationale"))
    overrides = open_.where("o_totalprice > 200000").select("normalized_fact", F.lit("矛盾").alias("verdict"), F.lit("costly").alias("rationale"))
    chunks = line.select(F.concat(F.lit("P"), "l_partkey").alias("chunk_id")).union(o.select(F.concat(F.lit("C"), "o_custkey"))).distinct()
    return datasets.oracle_items(facts, curated, overrides, chunks).withColumn("lore", F.array_join("lore", ","))


_ASKED = "(SELECT item_id, 'ann bob mechanism observed ' || text || ' calm' AS text FROM benchmark)"
FOUND_SQL = BM25.replace("FROM benchmark),\nsc", f"FROM {_ASKED}),\nsc")


@query(f"WITH {FOUND_SQL} SELECT query_id AS event_id, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY rank) AS chunks FROM ranked WHERE rank <= 3 GROUP BY query_id")
def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by BM25 for events that are made from benchmark items, out of all documents."""
    none = F.array().cast("array<string>")
    event = F.struct(
        F.array(F.lit("ann"), F.lit("bob")).alias("actors"), F.col("text").alias("event"), F.lit("calm").alias("mental_state"), F.lit("observed").alias("modality"), none.alias("conditions"),
        none.alias("source_ids"), none.alias("context_ids"), F.lit("mechanism").alias("check_reason"),
    )
    spans = F.array().cast("array<struct<id: string, text: string>>")
    events = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("event_id"), event.alias("event"), spans.alias("spans"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("chunk_id"), "text")
    found = story.find_evidence(events, chunks, Config("bm25", k=3))
    return found.select("event_id", F.array_join(F.transform("evidence", lambda e: e.chunk_id), ",").alias("chunks"))
