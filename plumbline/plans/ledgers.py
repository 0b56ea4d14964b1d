"""Queries that score runs against gold facts and check review ledgers; customers are cases, orders gold facts, order lines events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import reviews, scoring
from plumbline.plans.base import registry, table
from plumbline.sources.scratch import dealt, scratch

QUERIES, ORACLES, query = registry()
K = 3

LEDGER = """
cases AS (SELECT c_custkey AS case_id, c_mktsegment AS grp FROM customer),
gold AS (SELECT o_custkey AS case_id, o_orderkey AS gold_id, o_orderpriority AS dimension, CASE o_orderstatus WHEN 'F' THEN 'contradiction' WHEN 'O' THEN 'consistent' ELSE 'uncertain' END AS expected,
  [o_orderkey % 10, (o_orderkey + 1) % 10] AS relevant, CASE WHEN o_orderstatus = 'P' THEN [] ELSE [[o_orderkey % 10], [(o_orderkey + 1) % 10, (o_orderkey + 4) % 10]] END AS sets FROM orders),
line AS (SELECT o_custkey AS case_id, l_orderkey * 10 + l_linenumber AS event_id, l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
labels AS (SELECT case_id, event_id, CASE l_partkey % 7 WHEN 0 THEN 'hallucinated' WHEN 1 THEN 'overselected' WHEN 2 THEN 'duplicate' ELSE 'valid_checkable' END AS label,
  CASE WHEN l_partkey % 7 > 2 AND l_linenumber % 4 <> 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN [l_orderkey, l_orderkey + 1] ELSE [l_orderkey] END ELSE [] END AS gold_ids FROM line),
mapping AS (SELECT case_id, l_orderkey AS gold_id, event_id, l_linenumber AS ord FROM line WHERE l_linenumber % 4 <> 0),
retrieved AS (SELECT case_id, event_id, CASE WHEN l_suppkey % 9 = 0 THEN 'error' ELSE 'ok' END AS status, [l_partkey % 10, (l_partkey + 3) % 10, (l_partkey + l_suppkey) % 10, l_suppkey % 10] AS chunks FROM line WHERE l_partkey % 11 <> 0),
judged AS (SELECT case_id, event_id, CASE WHEN l_linenumber % 6 = 5 THEN 'error' ELSE 'ok' END AS status, CASE l_returnflag WHEN 'R' THEN 'contradiction' WHEN 'A' THEN 'uncertain' ELSE 'consistent' END AS verdict,
  CASE WHEN l_partkey % 5 = 0 THEN 'program_nonactual_scope' ELSE 'model' END AS origin, l_linenumber AS ord FROM line),
ok AS (SELECT m.*, label FROM mapping m JOIN labels USING (case_id, event_id) WHERE label = 'valid_checkable')"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, numbers of an order that occur twice folded; dealt by order, so that a join with the orders deals them no more."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")])
    return rows.withColumn("event_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _ledger(spark: SparkSession, sf_dir: str, by_event: bool = False) -> dict[str, DataFrame]:
    """The tables of LEDGER; by_event for queries in which three or more of them meet by event."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    three = lambda c, a, b, rest: F.when(c == a[0], a[1]).when(c == b[0], b[1]).otherwise(rest)
    sets = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<array<bigint>>")).otherwise(F.array(F.array(key % 10), F.array((key + 1) % 10, (key + 4) % 10)))
    gold = o.select(
        F.col("o_custkey").alias("case_id"), key.alias("gold_id"), F.col("o_orderpriority").alias("dimension"), three(F.col("o_orderstatus"), ("F", "contradiction"), ("O", "consistent"), "uncertain").alias("expected"),
        F.array(key % 10, (key + 1) % 10).alias("relevant"), sets.alias("sets"),
    )
    line = _lines(spark, sf_dir).join(o.select("o_orderkey", F.col("o_custkey").alias("case_id")), F.col("l_orderkey") == key)
    # All but the cases and the gold facts are read off this table, which would else be summed and joined anew for each of them.
    line = scratch(line.drop("o_orderkey"), "lines")
    # Tables that meet again by event are dealt by event once for all of them.
    line = dealt(line, "case_id", "event_id") if by_event else line
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    label = F.when(p % 7 == 0, "hallucinated").when(p % 7 == 1, "overselected").when(p % 7 == 2, "duplicate").otherwise("valid_checkable")
    linked = F.when((p % 7 > 2) & (n % 4 != 0), F.when(s % 2 == 0, F.array("l_orderkey", F.col("l_orderkey") + 1)).otherwise(F.array("l_orderkey"))).otherwise(F.array().cast("array<bigint>"))
    return {
        "cases": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("grp")),
        "gold": gold,
        "lines": line.withColumns({"label": label, "gold_ids": linked}),
        "events": line.select("case_id", "event_id"),
        "labels": line.select("case_id", "event_id", label.alias("label"), linked.alias("gold_ids")),
        "mapping": line.where(n % 4 != 0).select("case_id", F.col("l_orderkey").alias("gold_id"), "event_id", n.alias("ord")),
        "retrieved": line.where(p % 11 != 0).select("case_id", "event_id", F.when(s % 9 == 0, "error").otherwise("ok").alias("status"), F.array(p % 10, (p + 3) % 10, (p + s) % 10, s % 10).alias("chunks")),
        "judged": line.select(
            "case_id", "event_id", F.when(n % 6 == 5, "error").otherwise("ok").alias("status"), three(F.col("l_returnflag"), ("R", "contradiction"), ("A", "uncertain"), "consistent").alias("verdict"),
            F.when(p % 5 == 0, "program_nonactual_scope").otherwise("model").alias("origin"), n.alias("ord"),
        ),
    }


@query(f"""WITH {LEDGER},
parts AS (SELECT case_id, grp, coalesce(gold_n, 0) AS gold_n, coalesce(hits, 0) AS hits, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(h, 0) AS h, coalesce(o, 0) AS o, coalesce(d, 0) AS d, dims FROM cases
  LEFT JOIN (SELECT g.case_id, count(*) AS gold_n, count(x.gold_id) AS hits, list(DISTINCT dimension) AS dims FROM gold g LEFT JOIN (SELECT DISTINCT case_id, gold_id FROM ok) x ON g.case_id = x.case_id AND g.gold_id = x.gold_id GROUP BY g.case_id) USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS n, count(*) FILTER (label = 'valid_checkable') AS v, count(*) FILTER (label = 'hallucinated') AS h, count(*) FILTER (label = 'overselected') AS o, count(*) FILTER (label = 'duplicate') AS d FROM labels GROUP BY case_id) USING (case_id)),
by_ AS (SELECT 'all' AS level, NULL AS value, * FROM parts UNION ALL SELECT 'group', grp, * FROM parts UNION ALL SELECT 'dimension', unnest(dims), * FROM parts)
SELECT level, value, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(gold_n) AS BIGINT) AS gold, round(sum(hits) / nullif(sum(gold_n), 0), 6) AS recall, CAST(sum(n) AS BIGINT) AS events, CAST(sum(v) AS BIGINT) AS valid,
  round(sum(v) / nullif(sum(n), 0), 6) AS precision, round(sum(h) / nullif(sum(n), 0), 6) AS hallucination_rate, round(sum(o) / nullif(sum(n), 0), 6) AS overselection_rate, round(sum(d) / nullif(sum(n), 0), 6) AS duplicate_rate
FROM by_ GROUP BY level, value""")
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _ledger(spark, sf_dir, by_event=True)
    return scoring.extraction_scores(scoring.extraction_parts(x["cases"], x["gold"], x["events"], x["labels"], x["mapping"]))


@query(f"""WITH {LEDGER},
pairs AS (SELECT k.case_id, k.gold_id, k.event_id, dimension, relevant, sets, CASE WHEN r.event_id IS NULL THEN NULL WHEN status = 'ok' THEN chunks[1:{K}] ELSE [] END AS got
  FROM ok k JOIN gold g ON g.case_id = k.case_id AND g.gold_id = k.gold_id LEFT JOIN retrieved r ON r.case_id = k.case_id AND r.event_id = k.event_id),
facts AS (SELECT case_id, gold_id, dimension, bool_or(len(sets) > 0) AS due, bool_or(len(list_filter(sets, lambda s: list_has_all(coalesce(got, []), s))) > 0) AS hit,
  max(coalesce(1.0 / list_min(list_filter([list_position(got, relevant[1]), list_position(got, relevant[2])], lambda p: p > 0)), 0.0)) AS rr FROM pairs GROUP BY ALL),
each_ AS (SELECT case_id, event_id, any_value(got) AS got, list_distinct(flatten(list(relevant))) AS rel, list(DISTINCT dimension) AS dims FROM pairs GROUP BY case_id, event_id),
a AS (SELECT d, count(*) FILTER (due) AS eligible, count(*) FILTER (due AND hit) AS hits, sum(rr) FILTER (due) AS rr FROM (SELECT *, unnest([NULL, dimension]) AS d FROM facts) GROUP BY d),
b AS (SELECT d, count(*) FILTER (got IS NOT NULL) AS scored, count(*) FILTER (got IS NULL) AS missing, CAST(coalesce(sum(len(got)), 0) AS BIGINT) AS returned,
  CAST(coalesce(sum(len(list_filter(got, lambda c: list_contains(rel, c)))), 0) AS BIGINT) AS relevant FROM (SELECT *, unnest(list_concat([NULL], dims)) AS d FROM each_) GROUP BY d)
SELECT a.d AS dimension, hits, eligible, round(hits / nullif(eligible, 0), 6) AS recall_at_k, round(rr / nullif(eligible, 0), 6) AS mrr, relevant, returned, round(relevant / nullif(returned, 0), 6) AS precision_at_k,
  round((returned - relevant) / nullif(returned, 0), 6) AS noise_rate_at_k, scored AS scored_events, missing AS missing_events FROM a JOIN b ON a.d IS NOT DISTINCT FROM b.d""")
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole evidence sets, reciprocal ranks of any relevant chunk and noise, overall and by dimension."""
    x = _ledger(spark, sf_dir, by_event=True)
    return scoring.evidence_scores(x["gold"], x["events"], x["labels"], x["mapping"], x["retrieved"], K)


STATES = f"""{LEDGER},
per AS (SELECT k.case_id, k.gold_id, count(*) AS n, bool_or(coalesce(r.status = 'ok', FALSE)) AS ready, bool_or(len(list_filter(sets, lambda s: list_has_all(coalesce(chunks[1:{K}], []), s))) > 0) AS whole,
  list(DISTINCT verdict) FILTER (j.status = 'ok') AS said FROM ok k JOIN gold g ON g.case_id = k.case_id AND g.gold_id = k.gold_id LEFT JOIN retrieved r ON r.case_id = k.case_id AND r.event_id = k.event_id
  LEFT JOIN judged j ON j.case_id = k.case_id AND j.event_id = k.event_id GROUP BY k.case_id, k.gold_id),
states AS (SELECT g.case_id, g.gold_id, expected, coalesce(n, 0) > 0 AS found, len(sets) > 0 AS alt, coalesce(ready, FALSE) AS ready, len(sets) = 0 OR coalesce(whole, FALSE) AS fine, coalesce(said, []) AS said
  FROM gold g LEFT JOIN per p ON p.case_id = g.case_id AND p.gold_id = g.gold_id),
flags AS (SELECT *, found AND ready AND fine AS fit, expected = 'contradiction' AS conflict, list_contains(said, 'contradiction') AS alarm FROM states)"""


def _states(x: dict[str, DataFrame]) -> DataFrame:
    return scoring.case_states(x["gold"], x["events"], x["labels"], x["mapping"], x["retrieved"], x["judged"], K)


@query(f"""WITH {STATES},
s AS (SELECT count(*) AS gold, count(*) FILTER (found) AS extracted, count(*) FILTER (found AND alt) AS retrieval_eligible, count(*) FILTER (found AND alt AND fine) AS retrieval_hits, count(*) FILTER (fit) AS judge_eligible,
  count(*) FILTER (fit AND list_contains(said, expected)) AS judge_correct, count(*) FILTER (fit AND conflict AND NOT alarm) AS fn_with_complete_evidence, count(*) FILTER (conflict AND alarm) AS tp,
  count(*) FILTER (NOT conflict AND alarm) AS fp, count(*) FILTER (conflict AND NOT alarm) AS fn FROM flags)
SELECT *, round(extracted / gold, 6) AS extraction_recall, round(retrieval_hits / retrieval_eligible, 6) AS retrieval_recall, round(judge_correct / judge_eligible, 6) AS judge_accuracy,
  round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s""")
def system_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.system_scores(_states(_ledger(spark, sf_dir, by_event=True)))


@query(f"""WITH {STATES} SELECT expected, CASE WHEN len(said) = 1 THEN said[1] ELSE 'mixed_or_missing' END AS predicted, count(*) AS n FROM flags WHERE fit GROUP BY ALL""")
def state_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.state_confusion(_states(_ledger(spark, sf_dir, by_event=True)))


@query(f"""WITH {STATES}
SELECT cause, count(*) AS n FROM (SELECT CASE WHEN case_id % 13 = 0 THEN 'execution_failure' WHEN NOT found THEN 'extraction_miss' WHEN alt AND NOT fine THEN 'retrieval_miss' WHEN NOT alarm THEN 'judge_fn'
  WHEN gold_id % 5 = 0 THEN 'report_miss' END AS cause FROM flags WHERE conflict) WHERE cause IS NOT NULL GROUP BY cause""")
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that lost each missed conflict; every thirteenth case has no result, and every fifth fact is not in the report."""
    x = _ledger(spark, sf_dir, by_event=True)
    x["gold"] = x["gold"].where(F.col("expected") == scoring.CONFLICT)
    reported = x["gold"].select("case_id", "gold_id", (F.col("gold_id") % 5 != 0).alias("found"))
    return scoring.failures(_states(x), x["cases"].where("case_id % 13 = 0"), reported).groupBy("cause").agg(F.count("*").alias("n"))


@query(f"""WITH {LEDGER},
first_ AS (SELECT k.case_id, k.gold_id, k.event_id, verdict, row_number() OVER (PARTITION BY k.case_id, k.gold_id ORDER BY k.ord, k.event_id) AS place FROM ok k JOIN judged j ON j.case_id = k.case_id AND j.event_id = k.event_id),
v AS (SELECT expected, verdict, len(sets) = 0 OR len(list_filter(sets, lambda s: list_has_all(coalesce(chunks, []), s))) > 0 AS strict FROM first_ f JOIN gold g ON g.case_id = f.case_id AND g.gold_id = f.gold_id
  LEFT JOIN retrieved r ON r.case_id = f.case_id AND r.event_id = f.event_id WHERE place = 1)
SELECT strict, expected, verdict AS predicted, count(*) AS n FROM v GROUP BY ALL""")
def conditioned_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on facts that were extracted, with and without a whole set of evidence."""
    x = _ledger(spark, sf_dir, by_event=True)
    rows = scoring.conditioned_verdicts(x["gold"], x["events"], x["labels"], x["mapping"], x["retrieved"], x["judged"])
    return rows.groupBy("strict", "expected", "predicted").agg(F.count("*").alias("n"))


TURNS = f"""{LEDGER},
alarm AS (SELECT j.case_id, j.event_id, j.ord, CASE WHEN label = 'valid_checkable' THEN list_sort(list_filter(gold_ids, lambda g: list_contains(due, g))) ELSE [] END AS may
  FROM judged j JOIN labels l ON l.case_id = j.case_id AND l.event_id = j.event_id LEFT JOIN (SELECT case_id, list(gold_id) AS due FROM gold WHERE expected = 'contradiction' GROUP BY case_id) d ON d.case_id = j.case_id
  WHERE status = 'ok' AND verdict = 'contradiction'),
queue AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord, event_id) AS place FROM alarm),
turn AS (SELECT case_id, event_id, place, may[1] AS taken, CASE WHEN may[1] IS NULL THEN [] ELSE [may[1]] END AS gone FROM queue WHERE place = 1
  UNION ALL SELECT q.case_id, q.event_id, q.place, list_filter(q.may, lambda g: NOT list_contains(t.gone, g))[1], list_concat(t.gone, list_filter(q.may, lambda g: NOT list_contains(t.gone, g))[1:1])
  FROM turn t JOIN queue q ON q.case_id = t.case_id AND q.place = t.place + 1)"""


@query(f"""WITH RECURSIVE {TURNS},
s AS (SELECT count(taken) AS tp, count(*) - count(taken) AS fp, (SELECT count(*) FROM gold WHERE expected = 'contradiction') - count(taken) AS fn FROM turn)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s""")
def end_to_end_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms against conflicts one to one, in the order of judgement; the SQL follows the order by recursion."""
    x = _ledger(spark, sf_dir)
    return scoring.end_to_end(x["gold"], scoring.one_to_one(x["gold"], x["labels"], x["judged"]))


@query(f"""WITH RECURSIVE {TURNS},
fp AS (SELECT 'FP' AS kind, t.case_id, CAST(t.event_id AS VARCHAR) AS ident, CAST(t.event_id AS VARCHAR) AS events, CASE WHEN label <> 'valid_checkable' THEN 'extraction_nonvalid_then_judge' ELSE 'requires_semantic_review' END AS boundary
  FROM turn t JOIN labels l ON l.case_id = t.case_id AND l.event_id = t.event_id WHERE taken IS NULL),
missed AS (SELECT case_id, gold_id FROM gold g WHERE expected = 'contradiction' AND NOT EXISTS (SELECT 1 FROM turn t WHERE t.case_id = g.case_id AND t.taken = g.gold_id)),
fn AS (SELECT 'FN' AS kind, m.case_id, CAST(m.gold_id AS VARCHAR) AS ident, coalesce(array_to_string(list_sort(list(DISTINCT l.event_id) FILTER (l.event_id IS NOT NULL)), ','), '') AS events,
  CASE WHEN count(l.event_id) = 0 THEN 'extraction_missing' WHEN count(j.origin) > 0 AND count(j.origin) = count(*) FILTER (j.origin = 'program_nonactual_scope') THEN 'program_scope_gate' ELSE 'requires_semantic_review' END AS boundary
  FROM missed m LEFT JOIN (SELECT case_id, event_id, unnest(gold_ids) AS gold_id FROM labels WHERE label = 'valid_checkable') l ON l.case_id = m.case_id AND l.gold_id = m.gold_id
  LEFT JOIN judged j ON j.case_id = l.case_id AND j.event_id = l.event_id GROUP BY m.case_id, m.gold_id)
SELECT * FROM fp UNION ALL SELECT * FROM fn""")
def error_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every false alarm and missed conflict with the boundary at which it was seen to go wrong."""
    x = _ledger(spark, sf_dir)
    out = scoring.error_packets(x["gold"], x["labels"], x["judged"], x["retrieved"], scoring.one_to_one(x["gold"], x["labels"], x["judged"]))
    return out.withColumn("events", F.array_join(F.transform("events", lambda e: e.cast("string")), ","))


FINDINGS = """
gf AS (SELECT o_custkey AS case_id, o_orderkey AS gold_finding_id FROM orders WHERE o_orderstatus = 'F'),
f AS (SELECT o_custkey AS case_id, l_orderkey * 10 + l_linenumber AS finding_id, CASE WHEN l_linenumber % 3 = 0 THEN 'uncertain' ELSE 'contradiction' END AS verdict,
  CASE l_partkey % 5 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'duplicate' ELSE 'true_positive' END AS label, l_orderkey AS linked, l_linenumber
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey WHERE flag = 'R'),
matched AS (SELECT DISTINCT g.case_id, gold_finding_id FROM gf g JOIN f ON f.case_id = g.case_id AND linked = gold_finding_id AND label = 'true_positive' AND l_linenumber % 4 <> 0),
owed AS (SELECT o_custkey AS case_id, o_orderkey AS gold_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0)"""


@query(f"""WITH {FINDINGS},
c AS (SELECT f.case_id, count(*) AS claims, count(*) FILTER (label = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'contradiction') AS conflicts, count(*) FILTER (verdict = 'contradiction' AND label = 'duplicate') AS repeats,
  count(*) FILTER (verdict = 'contradiction' AND (label IN ('false_positive', 'unsupported') OR (label = 'true_positive' AND g.gold_finding_id IS NULL))) AS fp
  FROM f LEFT JOIN gf g ON g.case_id = f.case_id AND g.gold_finding_id = linked GROUP BY f.case_id),
per AS (SELECT c_custkey AS case_id, coalesce(gold, 0) AS gold, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(claims, 0) AS claims, coalesce(unsupported, 0) AS unsupported, coalesce(conflicts, 0) AS conflicts, coalesce(repeats, 0) AS repeats
  FROM customer LEFT JOIN (SELECT case_id, count(*) AS gold FROM gf GROUP BY case_id) a ON a.case_id = c_custkey LEFT JOIN (SELECT case_id, count(*) AS tp FROM matched GROUP BY case_id) b ON b.case_id = c_custkey LEFT JOIN c ON c.case_id = c_custkey),
s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(gold - tp) AS BIGINT) AS fn, sum(repeats) AS repeats, sum(conflicts) AS conflicts, sum(unsupported) AS unsupported, sum(claims) AS claims,
  count(*) FILTER (tp = gold AND fp = 0) AS exact, count(*) FILTER (fp > 0) AS alarmed, count(*) AS cases FROM per),
o AS (SELECT count(*) AS owed, count(*) FILTER (m.gold_finding_id IS NULL) AS omitted FROM owed w LEFT JOIN matched m ON m.case_id = w.case_id AND m.gold_finding_id = w.gold_id)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(repeats / conflicts, 6) AS duplicate_rate,
  round(unsupported / claims, 6) AS unsupported_rate, round(omitted / owed, 6) AS omission_rate, round(exact / cases, 6) AS exact_story_rate, round(alarmed / cases, 6) AS false_alarm_rate FROM s, o""")
def finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflict findings of reports: right, wrong, repeated, unsupported, left out."""
    o = table(spark, sf_dir, "orders")
    line = _lines(spark, sf_dir).where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"case_id": F.col("o_custkey"), "finding_id": F.col("event_id")})
    p = F.col("l_partkey") % 5
    label = F.when(p == 0, "false_positive").when(p == 1, "unsupported").when(p == 2, "duplicate").otherwise("true_positive")
    shut = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("gold_finding_id"), F.array("o_orderkey").alias("gold_ids"))
    return scoring.finding_scores(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")),
        shut,
        line.select("case_id", "finding_id", F.when(F.col("l_linenumber") % 3 == 0, "uncertain").otherwise("contradiction").alias("verdict")),
        line.select("case_id", "finding_id", label.alias("label"), F.array("l_orderkey").alias("gold_finding_ids")),
        line.where("l_linenumber % 4 <> 0").select("case_id", F.col("l_orderkey").alias("gold_finding_id"), "finding_id"),
        shut.where("gold_finding_id % 2 = 0").select("case_id", F.col("gold_finding_id").alias("gold_id")),
    )


@query(f"""WITH {LEDGER},
l AS (SELECT case_id, event_id, l_orderkey, md5(CAST(l_partkey AS VARCHAR)) AS signature, CASE WHEN l_linenumber = 7 THEN 'pending' ELSE label END AS label, CASE WHEN l_suppkey % 6 = 0 THEN [l_orderkey + 1000000] ELSE gold_ids END AS gold_ids,
  l_partkey % 17 = 0 AS stale, l_linenumber % 2 = 1 AS noted, event_id - 1 AS origin FROM line JOIN labels USING (case_id, event_id) WHERE l_linenumber < 7 OR l_partkey % 2 = 0),
r AS (SELECT case_id, event_id, 'unreviewed' AS rule FROM line WHERE l_linenumber = 7
  UNION ALL SELECT case_id, event_id, 'signature' FROM l WHERE stale
  UNION ALL SELECT case_id, event_id, 'gold' FROM l WHERE label <> 'pending' AND len(gold_ids) > 0 AND NOT list_has_all((SELECT list(gold_id) FROM gold g WHERE g.case_id = l.case_id), gold_ids)
  UNION ALL SELECT case_id, event_id, 'gold of an invalid event' FROM l WHERE label NOT IN ('pending', 'valid_checkable') AND len(gold_ids) > 0
  UNION ALL SELECT case_id, event_id, 'note' FROM l WHERE label IN ('hallucinated', 'overselected') AND NOT noted
  UNION ALL SELECT case_id, event_id, 'duplicate_of' FROM l WHERE label = 'duplicate' AND NOT EXISTS (SELECT 1 FROM line e WHERE e.case_id = l.case_id AND e.event_id = l.origin)
  UNION ALL SELECT -1, -1, 'unknown event')
SELECT * FROM r""")
def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with planted faults: pending or missing ones, stale signatures, unknown facts, lost notes and wrong origins, and one of no event."""
    x = _ledger(spark, sf_dir)
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    sign = F.md5(p.cast("string"))
    events = x["lines"].select("case_id", "event_id", sign.alias("signature"))
    l = x["lines"].where((n < 7) | (p % 2 == 0)).select(
        "case_id", "event_id", F.when(p % 17 == 0, "stale").otherwise(sign).alias("signature"), F.when(n == 7, "pending").otherwise(F.col("label")).alias("label"),
        F.when(F.col("l_suppkey") % 6 == 0, F.array(F.col("l_orderkey") + 1000000)).otherwise(F.col("gold_ids")).alias("gold_ids"), F.when(n % 2 == 1, "seen").alias("note"), (F.col("event_id") - 1).alias("duplicate_of"),
    )
    none = F.array().cast("array<bigint>")
    stray = spark.range(1).select(F.lit(-1).cast("long").alias("case_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("x").alias("signature"), F.lit("valid_checkable").alias("label"), none.alias("gold_ids"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("long").alias("duplicate_of"))
    return reviews.label_problems(events, l.unionByName(stray), x["gold"])


@query("""
WITH e AS (SELECT doc_id, doc_id % 10 AS case_id, sha256(text) AS s, doc_id % 2 = 0 AS old FROM documents),
k AS (SELECT case_id, s, min(doc_id) AS id FROM e WHERE old GROUP BY case_id, s HAVING count(*) = 1)
SELECT e.case_id, e.doc_id AS event_id, CASE WHEN k.id IS NOT NULL AND k.id % 3 <> 0 THEN 'valid_checkable' ELSE 'pending' END AS label, CASE WHEN k.id % 3 <> 0 THEN k.id END AS reused_from
FROM (SELECT (doc_id + 1) % 10 AS case_id, doc_id, s FROM e WHERE NOT old) e LEFT JOIN k ON k.case_id = e.case_id AND k.s = e.s
""")
def reused_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents as a new run's events, labelled where exactly one even document of the case has the text and a label."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("signature"))
    old = d.where("doc_id % 2 = 0").select((F.col("doc_id") % 10).alias("case_id"), F.col("doc_id").alias("event_id"), "signature")
    new = d.where("doc_id % 2 = 1").select(((F.col("doc_id") + 1) % 10).alias("case_id"), F.col("doc_id").alias("event_id"), "signature")
    labels = old.select("case_id", "event_id", F.when(F.col("event_id") % 3 == 0, "pending").otherwise("valid_checkable").alias("label"), F.array().cast("array<bigint>").alias("gold_ids"))
    return reviews.reuse_exact(new, old, labels).select("case_id", "event_id", "label", "reused_from")


@query("""
WITH a AS (SELECT o_custkey AS case_id, o_orderpriority AS s, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS case_id, CASE WHEN o_orderkey % 50 = 0 THEN 'new' ELSE o_orderpriority END AS s, count(*) AS n FROM orders GROUP BY ALL)
SELECT DISTINCT coalesce(a.case_id, b.case_id) AS case_id FROM a FULL JOIN b ON a.case_id = b.case_id AND a.s = b.s WHERE a.n IS DISTINCT FROM b.n
""")
def changed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders' priorities differ between two runs as multisets."""
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("signature"))
    new = o.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderkey") % 50 == 0, "new").otherwise(F.col("o_orderpriority")).alias("signature"))
    return reviews.changed_cases(old, new)


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'keep' WHEN event_type = 'error' THEN 'review' ELSE 'ignore' END AS d,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
kept AS (SELECT event_id, user_id, before, FALSE AS support FROM e WHERE d = 'keep' UNION SELECT x.event_id, x.user_id, x.before, TRUE FROM kept k JOIN e x ON x.event_id = k.before AND x.user_id = k.user_id AND x.d = 'ignore' AND k.event_id % 3 <> 0),
k AS (SELECT event_id, bool_or(support) AS support FROM kept GROUP BY event_id)
SELECT e.event_id, CASE WHEN k.event_id IS NOT NULL THEN 'keep' ELSE d END AS decision, coalesce(support, FALSE) AS support_only FROM e LEFT JOIN k USING (event_id)
""")
def kept_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are kept, and with them, step by step, the event of the user before, unless the event's id is divisible by three."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("before", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    none = F.array().cast("array<bigint>")
    events = e.select(F.col("user_id").alias("story_id"), "event_id", F.array("event_id").alias("source_ids"), F.when((F.col("event_id") % 3 != 0) & F.col("before").isNotNull(), F.array("before")).otherwise(none).alias("context_ids"))
    said = F.when(F.col("event_type") == "purchase", "keep").when(F.col("event_type") == "error", "review").otherwise("ignore")
    out = reviews.keep_support(events, e.select(F.col("user_id").alias("story_id"), "event_id", said.alias("decision")))
    return out.select("event_id", "decision", "support_only")
