"""Queries for classification, detection, funnels, cost profiles and other metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import callable
from plumbline.functions import judging, rules
from plumbline.functions.stats import linear, nearest_rank, strict_sum
from plumbline.operators import checks, metrics
from plumbline.plans.base import registry, table

QUERIES, ORACLES, query = registry()

GUESS = """
g AS (SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS gold,
  CASE WHEN text IS NULL OR doc_id % 17 = 0 THEN NULL WHEN contains(text, '!!') OR contains(text, '|') THEN 'bad' ELSE 'good' END AS predicted
  FROM labels LEFT JOIN documents USING (doc_id)),
c AS (SELECT gold, coalesce(predicted, 'missing') AS predicted, count(*) AS n FROM g GROUP BY 1, 2),
s AS (SELECT label, CAST(coalesce(sum(n) FILTER (gold = label), 0) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (gold = label AND predicted = label), 0) AS BIGINT) AS tp,
  CAST(coalesce(sum(n) FILTER (gold <> label AND predicted = label), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (gold = label AND predicted <> label), 0) AS BIGINT) AS fn
  FROM c, (SELECT unnest(['good', 'bad', 'other']) AS label) GROUP BY label),
scores AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s)"""
LABELS = ("good", "bad", "other")


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left")
    bad = rules.any_of(F.col("text"), ("!!", "|"))
    predicted = F.when(F.col("text").isNull() | (F.col("doc_id") % 17 == 0), F.lit(None)).when(bad, "bad").otherwise("good")
    return d.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"), predicted.alias("predicted"))


@query(f"WITH {GUESS} SELECT * FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_guesses(spark, sf_dir), "gold", "predicted")


@query(f"WITH {GUESS} SELECT * FROM scores")
def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_scores(metrics.confusion(_guesses(spark, sf_dir), "gold", "predicted"), LABELS)


@query(f"""WITH {GUESS}
SELECT 'supported' AS classes, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(coalesce(f1, 0)), 6) AS macro_f1 FROM scores WHERE support > 0
UNION ALL SELECT 'all', round(sum(tp) / sum(support), 6), round(avg(coalesce(f1, 0)), 6) FROM scores""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both averages that are in use: over supported classes, and over all with zeros."""
    s = metrics.class_scores(metrics.confusion(_guesses(spark, sf_dir), "gold", "predicted"), LABELS)
    of = lambda name, flag: metrics.macro_f1(s, flag).select(F.lit(name).alias("classes"), "*")
    return of("supported", True).unionByName(of("all", False))


CASES = """
gold AS (SELECT o_custkey AS case_id, o_orderkey AS gold_id, o_orderstatus = 'F' AS conflict FROM orders),
alarms AS (SELECT o_custkey AS case_id, l_orderkey * 10 + l_linenumber AS alarm_id, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_orderkey END AS gold_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
m AS (SELECT a.*, coalesce(conflict, FALSE) AS right_one, conflict FROM alarms a LEFT JOIN gold g ON a.case_id = g.case_id AND a.gold_id = g.gold_id),
hit AS (SELECT DISTINCT gold_id FROM m WHERE right_one),
base AS (SELECT count(*) FILTER (h.gold_id IS NOT NULL) AS found, count(*) FILTER (h.gold_id IS NULL) AS fn FROM gold g LEFT JOIN hit h USING (gold_id) WHERE conflict),
f AS (SELECT count(*) FILTER (NOT right_one) AS false_n, count(*) FILTER (right_one) AS right_n, count(*) AS all_n, count(DISTINCT gold_id) FILTER (conflict = FALSE) AS per_gold FROM m),
x AS (SELECT {tp} AS tp, {fp} AS fp, fn FROM base, f)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM x"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("gold_id"), (F.col("o_orderstatus") == "F").alias("conflict"))
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(o.select("case_id", "gold_id"), F.col("l_orderkey") == F.col("gold_id"))
    mapped = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_orderkey"))
    return o, line.select("case_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("alarm_id"), mapped.alias("gold_id"))


def _detection(how: str, tp: str, fp: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.detection(*_cases(spark, sf_dir), how)

    query("WITH " + CASES.replace("{tp}", tp).replace("{fp}", fp), f"conflict_prf_{how}")(run)


_detection("cover", "found", "false_n")
_detection("finding", "right_n", "false_n")
_detection("per_gold", "found", "per_gold")
_detection("one_to_one", "found", "all_n - found")


GREEDY = """
, lists AS (SELECT case_id, CAST(alarm_id // 20 AS BIGINT) AS alarm_id, list_sort(list(DISTINCT CAST(gold_id AS VARCHAR))) AS may FROM alarms WHERE gold_id IS NOT NULL GROUP BY ALL),
queue AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY alarm_id) AS place FROM lists),
turn AS (SELECT case_id, alarm_id, place, may[1] AS matched, may[1:1] AS gone FROM queue WHERE place = 1
  UNION ALL SELECT q.case_id, q.alarm_id, q.place, list_filter(q.may, lambda g: NOT list_contains(t.gone, g))[1], list_concat(t.gone, list_filter(q.may, lambda g: NOT list_contains(t.gone, g))[1:1])
  FROM turn t JOIN queue q ON q.case_id = t.case_id AND q.place = t.place + 1)
SELECT case_id, CAST(alarm_id AS VARCHAR) AS alarm_id, matched FROM turn"""


@query("WITH RECURSIVE " + CASES[: CASES.index("m AS (")].rstrip().rstrip(",") + GREEDY)
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms with several possible conflicts, each taking the smallest that is free."""
    o, a = _cases(spark, sf_dir)
    lists = a.where("gold_id IS NOT NULL").groupBy("case_id", F.floor(F.col("alarm_id") / 20).alias("alarm_id")).agg(F.collect_set(F.col("gold_id").cast("string")).alias("gold_ids"))
    return metrics.greedy_matches(lists)


@query("WITH RECURSIVE " + CASES[: CASES.index("m AS (")].rstrip().rstrip(",") + GREEDY)
def sql_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """greedy_matching() in SQL text, by a grouped aggregate."""
    callable.register(spark)
    _cases(spark, sf_dir)[1].createOrReplaceTempView("sql_matches_alarms")
    return spark.sql("""
        WITH lists AS (SELECT case_id, floor(alarm_id / 20) AS alarm_id, collect_set(CAST(gold_id AS STRING)) AS may FROM sql_matches_alarms WHERE gold_id IS NOT NULL GROUP BY 1, 2),
        taken AS (SELECT case_id, explode(matched_in_turn(alarm_id, may)) AS x FROM lists GROUP BY case_id)
        SELECT case_id, CAST(x.alarm AS STRING) AS alarm_id, x.matched FROM taken
    """)


FUNNEL = """
o AS (SELECT o_orderkey, o_orderpriority, o_totalprice > 100000 AS large, bool_or(l_returnflag = 'R') AS back, count(l_orderkey) > 0 AS has_lines, o_orderstatus = 'F' AS done
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("back"))
    o = table(spark, sf_dir, "orders").join(line, "o_orderkey", "left")
    return o, [("lines", F.col("back").isNotNull()), ("large", F.col("o_totalprice") > 100000), ("returned", F.col("back")), ("closed", F.col("o_orderstatus") == "F")]


@query(f"""WITH {FUNNEL},
c AS (SELECT count(*) AS a, count(*) FILTER (has_lines) AS b, count(*) FILTER (has_lines AND large) AS c, count(*) FILTER (has_lines AND large AND back) AS d, count(*) FILTER (has_lines AND large AND back AND done) AS e FROM o),
r AS (SELECT unnest([0, 1, 2, 3]) AS stage_no, unnest(['lines', 'large', 'returned', 'closed']) AS stage, unnest([a, b, c, d]) AS eligible, unnest([b, c, d, e]) AS passed FROM c)
SELECT CAST(stage_no AS INTEGER) AS stage_no, stage, eligible, passed, round(passed / nullif(eligible, 0), 6) AS rate FROM r""")
def stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.funnel(*_orders(spark, sf_dir))


@query(f"""WITH {FUNNEL}
SELECT o_orderpriority, CASE WHEN NOT has_lines THEN 'lines' WHEN NOT large THEN 'large' WHEN NOT back THEN 'returned' WHEN NOT done THEN 'closed' ELSE 'none' END AS failed, count(*) AS n
FROM o GROUP BY ALL""")
def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, stages = _orders(spark, sf_dir)
    return o.groupBy("o_orderpriority", metrics.first_failure(stages).alias("failed")).agg(F.count("*").alias("n"))


@query("""
SELECT format('AT-{:04d}', row_number() OVER (ORDER BY l_orderkey, l_linenumber)) AS error_id, l_orderkey, l_linenumber
FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09
""")
def error_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.09").select("l_orderkey", "l_linenumber")
    return metrics.error_ids(e, ["l_orderkey", "l_linenumber"])


CALLS = """
calls AS (SELECT event_id, event_type AS component, event_id % 5 = 0 AS is_retry, user_id AS input_tokens, event_id % 8 AS padded_tokens, event_id % 100 AS output_tokens,
  value / 4 AS prefill, value * 3 / 4 AS decode, value AS total, value * 250 AS ttft FROM events)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("component"), (i % 5 == 0).alias("is_retry"), F.col("user_id").alias("input_tokens"), (i % 8).alias("padded_tokens"), (i % 100).alias("output_tokens"),
        (v / 4).alias("prefill"), (v * 3 / 4).alias("decode"), v.alias("total"), (v * 250).alias("ttft"),
    )


@query(f"""WITH {CALLS}
SELECT component, count(*) AS calls, count(*) FILTER (is_retry) AS retry_calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(padded_tokens) AS BIGINT) AS padded_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(total), 4) AS total_seconds, round(sum(input_tokens) / sum(prefill), 6) AS prefill_rate,
  round(sum(output_tokens) / sum(decode), 6) AS decode_rate, round(median(ttft), 6) AS ttft_p50, round(quantile_disc(ttft, 0.95), 6) AS ttft_p95, round(max(ttft), 6) AS ttft_max,
  round(sum(total) / sum(sum(total)) OVER (), 6) AS time_share FROM calls GROUP BY component""")
def profile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cost_profile(_calls(spark, sf_dir), "component")


@query("""
SELECT event_type, quantile_disc(value, 0.5) AS p50_rank, median(value) AS p50_middle, round(quantile_cont(value, 0.95), 6) AS p95_linear, quantile_disc(value, 0.95) AS p95_rank,
  CASE WHEN count(CASE WHEN event_id % 500 <> 3 THEN value END) = count(*) THEN round(sum(value), 4) END AS strict_total FROM events GROUP BY event_type
""")
def percentile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rank, median and linear percentiles side by side, and a sum that one missing value voids."""
    known = F.when(F.col("event_id") % 500 != 3, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        nearest_rank("value", 0.5).alias("p50_rank"), F.median("value").alias("p50_middle"), F.round(linear("value", 0.95), 6).alias("p95_linear"),
        nearest_rank("value", 0.95).alias("p95_rank"), F.round(strict_sum(known), 4).alias("strict_total"),
    )


@query("""
SELECT CASE WHEN GROUPING(n_name) = 0 THEN 'nation' WHEN GROUPING(c_mktsegment) = 0 THEN 'segment' ELSE 'all' END AS level, n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((), (n_name), (c_mktsegment))
""")
def group_dimension_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = metrics.by_sets(rows, [(), ("n_name",), ("c_mktsegment",)], F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return out.withColumn("level", F.when(F.col("level") == "n_name", "nation").when(F.col("level") == "c_mktsegment", "segment").otherwise("all"))


@query("""
WITH t AS (SELECT doc_id, quality, lang, row_number() OVER (PARTITION BY quality, lang ORDER BY doc_id) AS turn FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY turn, lang) AS place FROM t)
SELECT doc_id, quality, lang, turn, place FROM p WHERE place <= 16
""")
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "lang")
    return metrics.stratified_round_robin(rows, "quality", "lang", "doc_id", 16)


@query("""
SELECT conv_id, CASE max(CASE WHEN turn % 7 = 5 THEN 3 WHEN role = 'system' THEN 2 WHEN role = 'assistant' THEN 1 END) WHEN 3 THEN 'contradiction' WHEN 2 THEN 'uncertain' WHEN 1 THEN 'consistent' END AS verdict
FROM conversations GROUP BY conv_id
""")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("turn") % 7 == 5, "contradiction").when(F.col("role") == "system", "uncertain").when(F.col("role") == "assistant", "consistent")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rules.verdict_of(verdict).alias("verdict"))


@query("""
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'error' WHEN count(*) FILTER (event_type IN ('error', 'signup')) > 0 THEN 'partial' ELSE 'ok' END AS status
FROM events GROUP BY user_id
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "partial").otherwise("ok")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(rules.status_of(status).alias("status"))


@query("""
WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'consistent' ELSE 'uncertain' END AS v, user_id % 2 = 0 AS same, event_id % 5 <> 0 AS applies,
  CASE WHEN event_id % 2 = 0 THEN 'direct_conflict' ELSE 'direct_support' END AS rel, event_id % 11 = 0 AS assumed, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN TRUE WHEN 3 THEN TRUE WHEN 5 THEN TRUE ELSE FALSE END AS joint FROM events),
g AS (SELECT *, CASE WHEN v = 'contradiction' AND NOT (same AND applies AND NOT assumed AND rel = 'direct_conflict' AND joint IS NOT DISTINCT FROM FALSE) THEN 'coexistence_not_ruled_out'
  WHEN v = 'consistent' AND NOT (same AND applies AND NOT assumed AND rel = 'direct_support' AND joint IS NOT DISTINCT FROM TRUE) THEN 'direct_support_not_proven' END AS reason FROM a)
SELECT event_id, CASE WHEN reason IS NULL THEN v ELSE 'uncertain' END AS verdict, CASE WHEN reason IS NOT NULL THEN v END AS model_verdict, reason AS guard_reason FROM g
""")
def scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    joint = F.when(i % 7 == 0, F.lit(None)).when((i % 7).isin(1, 3, 5), True).otherwise(False)
    a = F.struct(
        (F.col("user_id") % 2 == 0).alias("same_subject"), (i % 5 != 0).alias("evidence_applicable"), F.when(i % 2 == 0, "direct_conflict").otherwise("direct_support").alias("relation"),
        joint.alias("can_both_be_true"), F.when(i % 11 == 0, F.array(F.lit("if"))).otherwise(F.array().cast("array<string>")).alias("assumptions"),
    )
    verdict = F.when(i % 3 == 0, "contradiction").when(i % 3 == 1, "consistent").otherwise("uncertain")
    rows = table(spark, sf_dir, "events").select("event_id", verdict.alias("v"), a.alias("a"))
    return rows.select("event_id", judging.guard(F.col("v"), F.col("a")).alias("g")).select("event_id", "g.*")


@query("""
SELECT event_id, CASE WHEN event_type = 'signup' THEN 'support_only' WHEN m IN ('speech', 'belief', 'plan', 'dream', 'inferred') THEN 'non_actual' WHEN event_id % 4 = 0 THEN 'no_evidence' ELSE 'judge' END AS route
FROM (SELECT *, ['observed', 'speech', 'belief', 'plan', 'dream', 'conditional', 'inferred'][CAST(event_id % 7 + 1 AS INTEGER)] AS m FROM events)
""")
def judge_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.functions.wire import MODALITIES

    m = F.get(F.array(*[F.lit(x) for x in MODALITIES]), (F.col("event_id") % 7).cast("int"))
    evidence = F.when(F.col("event_id") % 4 != 0, F.array(F.lit("L1")))
    importance = F.when(F.col("event_type") == "signup", "support_only").otherwise("check")
    return table(spark, sf_dir, "events").select("event_id", judging.route(m, importance, evidence).alias("route"))


@query("""
SELECT event_id, rule FROM (SELECT event_id, unnest([CASE WHEN event_id % 10 = 0 THEN 'compute_tokens' END, CASE WHEN event_id % 6 = 0 THEN 'phases_sum' END,
  CASE WHEN event_id % 14 = 0 THEN 'first_token' END, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error_text' END, CASE WHEN event_id % 22 = 0 THEN 'batch' END]) AS rule FROM events) WHERE rule IS NOT NULL
""")
def call_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows with planted faults: token sums off by one, phases that don't add up, late first tokens, errors without a text, empty batches."""
    i = F.col("event_id")
    c = _calls(spark, sf_dir).withColumns(
        {
            "compute_tokens": F.col("input_tokens") + F.col("padded_tokens") + (i % 10 == 0).cast("int"),
            "decode": F.col("decode") + F.when(i % 6 == 0, 1.0).otherwise(0.0),
            "status": F.when(F.col("component") == "error", "error").otherwise("ok"),
            "error": F.when(i % 3 != 0, "text"),
            "batch_size": F.when(i % 22 == 0, 0).otherwise(1),
            "ttft": F.col("ttft") + F.when(i % 14 == 0, 1.0).otherwise(0.0),
        }
    )
    return checks.violations(c, "event_id", checks.call_rules())


@query("""
SELECT event_type, user_id % 3 AS config, count(value) AS n, round(median(value), 6) AS median, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation
FROM events GROUP BY ALL
""")
def repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.repeats(table(spark, sf_dir, "events").withColumn("config", F.col("user_id") % 3), ["event_type", "config"], "value")


@query("""
WITH m AS (SELECT event_type, user_id % 2 AS side, round(avg(value), 6) AS v FROM events WHERE NOT (event_type = 'view' AND user_id % 2 = 1) GROUP BY ALL),
g AS (SELECT event_type, max(v) FILTER (side = 0) AS base, max(v) FILTER (side = 1) AS other FROM m GROUP BY event_type)
SELECT *, round(other - base, 6) AS delta, round((other - base) / nullif(base, 0), 6) AS relative FROM g
""")
def system_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems compared by measure; one measure is missing on one side and stays null."""
    e = table(spark, sf_dir, "events").where("NOT (event_type = 'view' AND user_id % 2 = 1)")
    m = e.groupBy("event_type", F.when(F.col("user_id") % 2 == 0, "base").otherwise("other").alias("side")).agg(F.round(F.avg("value"), 6).alias("v"))
    return metrics.deltas(m, "event_type", "side", "v", "base", "other")


@query("""
SELECT vec_id, rule FROM (SELECT vec_id, unnest([CASE WHEN len(embedding) <> 64 THEN 'dim' END,
  CASE WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 1e-5 THEN 'unit_norm' END]) AS rule FROM embeddings) WHERE rule IS NOT NULL
UNION ALL SELECT vec_id, 'label' FROM embeddings WHERE label = 0
""")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return checks.unit_vectors(v, 64).unionByName(checks.violations(v, "vec_id", {"label": F.col("label") != 0}))


@query("""
WITH p AS (SELECT event_id, 'a' AS part FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, 'b' FROM events WHERE event_type IN ('view', 'error', 'signup') AND event_id % 9 <> 0
  UNION ALL SELECT event_id + 1000000000, 'c' FROM events WHERE event_id % 1000 = 1),
h AS (SELECT event_id, count(*) AS n FROM p GROUP BY event_id)
SELECT event_id, problem FROM (SELECT coalesce(e.event_id, h.event_id) AS event_id, CASE WHEN e.event_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'twice' END AS problem
  FROM events e FULL JOIN h ON e.event_id = h.event_id) WHERE problem IS NOT NULL
""")
def partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that should hold every event once: some miss, some overlap, some are unknown."""
    e = table(spark, sf_dir, "events")
    parts = {
        "a": e.where("event_type IN ('click', 'view')"),
        "b": e.where("event_type IN ('view', 'error', 'signup') AND event_id % 9 <> 0"),
        "c": e.where("event_id % 1000 = 1").withColumn("event_id", F.col("event_id") + 1000000000),
    }
    return checks.partition_errors(e, parts, "event_id")


@query("""
WITH r AS (SELECT l_suppkey AS batch, CAST(l_quantity AS BIGINT) AS len FROM lineitem)
SELECT batch, count(*) AS rows, CAST(sum(len) AS BIGINT) AS tokens, count(*) * max(len) AS padded, CAST(count(*) * max(len) - sum(len) AS BIGINT) AS wasted FROM r GROUP BY batch
""")
def padding_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.sequences import padding

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("batch"), F.col("l_quantity").cast("long").alias("len"))
    return padding(rows, "batch", "len")


@query("""
SELECT component, event_id, total, place FROM (SELECT event_type AS component, event_id, value AS total, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 10
""")
def slowest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten slowest calls of each component: a top-k report."""
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("total"), "event_id"))
    return _calls(spark, sf_dir).select("component", "event_id", "total", place.alias("place")).where("place <= 10")
