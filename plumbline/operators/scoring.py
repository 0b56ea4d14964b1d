"""Scores of extraction, evidence, verdicts and findings against gold facts, over long tables.

gold: case_id, gold_id, dimension, expected (a verdict), relevant (array of chunk ids), sets (array of arrays: any one of
them is enough evidence). events: case_id, event_id. labels: case_id, event_id, label, gold_ids. mapping: case_id,
gold_id, event_id, ord. retrieved: case_id, event_id, status, chunks (in rank order). judged: case_id, event_id,
status, verdict, origin, ord. Gold ids count within their case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import prf, ratio
from plumbline.sources.scratch import scratch

# What reviewers call events.
VALID = "valid_checkable"
LABELS = (VALID, "hallucinated", "overselected", "duplicate")
CONFLICT = "contradiction"
#: Cases (without labels, without a result) that are broadcast; more are met in a shuffle.
MOST_CASES = 1_000_000


def _mapped(mapping: DataFrame, events: DataFrame, labels: DataFrame) -> DataFrame:
    """mapping rows whose event was emitted and is labelled valid."""
    return mapping.join(events.select("case_id", "event_id"), ["case_id", "event_id"], "left_semi").join(labels.where(F.col("label") == VALID), ["case_id", "event_id"], "left_semi")


def extraction_parts(cases: DataFrame, gold: DataFrame, events: DataFrame, labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per case (case_id, grp): dimensions, gold, hits, events and how many of them bear each label."""
    named = events.join(labels.select("case_id", "event_id", "label"), ["case_id", "event_id"], "left")
    emitted = named.groupBy("case_id").agg(F.count("*").alias("events"), *[F.count_if(F.col("label") == x).alias(x) for x in LABELS])
    found = _mapped(mapping, events, labels).select("case_id", "gold_id").distinct().withColumn("hit", F.lit(1))
    due = gold.join(found, ["case_id", "gold_id"], "left").groupBy("case_id").agg(F.count("*").alias("gold"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.collect_set("dimension").alias("dimensions"))
    out = cases.select("case_id", F.coalesce("grp", F.lit("unknown")).alias("grp")).join(due, "case_id", "left").join(emitted, "case_id", "left")
    return out.fillna(0, ["gold", "hits", "events", *LABELS]).withColumn("dimensions", F.coalesce("dimensions", F.array().cast("array<string>")))


def extraction_scores(parts: DataFrame) -> DataFrame:
    """level (all, group, dimension), value, and recall, precision and the share of each other label.

    A case counts whole in each dimension that one of its gold facts has. Zero denominators give null.
    """
    by = F.concat(
        F.array(F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("group").alias("level"), F.col("grp").cast("string").alias("value"))),
        F.transform("dimensions", lambda d: F.struct(F.lit("dimension").alias("level"), d.cast("string").alias("value"))),
    )
    rows = parts.withColumn("by", F.explode(by)).groupBy("by.level", "by.value").agg(*[F.sum(c).alias(c) for c in ("gold", "hits", "events", *LABELS)])
    rate = lambda c: ratio(F.col(c), F.col("events"))
    return rows.select(
        "level", "value", "hits", "gold", ratio(F.col("hits"), F.col("gold")).alias("recall"), "events", F.col(VALID).alias("valid"), rate(VALID).alias("precision"),
        rate("hallucinated").alias("hallucination_rate"), rate("overselected").alias("overselection_rate"), rate("duplicate").alias("duplicate_rate"),
    )


def lower_bound(scores: DataFrame, complete: Column) -> DataFrame:
    """Scores with recall and precision moved to their own columns as lower bounds while reviews are pending."""
    bound = lambda c: F.when(~complete, F.col(c)).alias(f"reviewed_lower_bound_{c}")
    rest = [c for c in scores.columns if c not in ("recall", "precision")]
    return scores.select(*rest, *[F.when(complete, F.col(c)).alias(c) for c in ("recall", "precision")], bound("recall"), bound("precision"), F.when(complete, "reviewed").otherwise("pending_review").alias("quality_status"))


def _complete(sets: Column, chunks: Column) -> Column:
    return F.exists(sets, lambda s: (F.size(s) > 0) & (F.size(F.array_except(s, chunks)) == 0))


def evidence_scores(gold: DataFrame, events: DataFrame, labels: DataFrame, mapping: DataFrame, retrieved: DataFrame, k: int, overrides: DataFrame | None = None) -> DataFrame:
    """dimension (null: overall), recall at k of whole evidence sets, MRR of any relevant chunk, precision and noise at k.

    A gold fact is scored if a valid event maps to it, by the best of these events; one without evidence sets has no
    part in recall and MRR. Events are scored by what is relevant to any of their facts, changed by ``overrides``
    (case_id, event_id, relevant_ids, irrelevant_ids); events without a retrieval row are counted as missing. A failed
    retrieval returned nothing.
    """
    pairs = _mapped(mapping, events, labels).join(gold, ["case_id", "gold_id"])
    got = retrieved.select("case_id", "event_id", F.when(F.col("status") == "ok", F.slice("chunks", 1, k)).otherwise(F.slice("chunks", 1, 0)).alias("chunks"))
    pairs = pairs.join(got, ["case_id", "event_id"], "left")
    chunks = F.coalesce("chunks", F.slice("relevant", 1, 0))
    place = F.array_min(F.filter(F.transform("relevant", lambda r: F.array_position(chunks, r)), lambda p: p > 0))
    facts = pairs.groupBy("case_id", "gold_id", "dimension").agg(
        F.max(F.exists("sets", lambda s: F.size(s) > 0)).alias("due"), F.max(_complete(F.col("sets"), chunks)).alias("hit"), F.max(F.coalesce(1.0 / place, F.lit(0.0))).alias("rr")
    )
    each = pairs.groupBy("case_id", "event_id").agg(F.first("chunks").alias("chunks"), F.array_distinct(F.flatten(F.collect_list("relevant"))).alias("relevant"), F.collect_set("dimension").alias("dimensions"))
    if overrides is not None:
        each = each.join(overrides, ["case_id", "event_id"], "left")
        none = F.slice("relevant", 1, 0)
        each = each.withColumn("relevant", F.array_except(F.array_union("relevant", F.coalesce("relevant_ids", none)), F.coalesce("irrelevant_ids", none)))
    right = F.size(F.filter("chunks", lambda c: F.array_contains("relevant", c)))
    each = each.select("dimensions", F.size("chunks").alias("returned"), right.alias("right"), F.col("chunks").isNull().alias("missing"))
    both = lambda own: F.concat(F.array(F.lit(None).cast("string")), own)
    a = facts.withColumn("dimension", F.explode(both(F.array("dimension")))).groupBy("dimension").agg(
        F.count_if("due").alias("eligible"), F.count_if(F.col("due") & F.col("hit")).alias("hits"), F.sum(F.when(F.col("due"), F.col("rr"))).alias("rr")
    )
    b = each.withColumn("dimension", F.explode(both(F.col("dimensions")))).groupBy("dimension").agg(
        F.count_if(~F.col("missing")).alias("scored_events"), F.count_if("missing").alias("missing_events"),
        F.coalesce(F.sum(F.when(~F.col("missing"), F.col("returned"))), F.lit(0)).alias("returned"), F.coalesce(F.sum(F.when(~F.col("missing"), F.col("right"))), F.lit(0)).alias("relevant"),
    )
    key = F.col("l.dimension").eqNullSafe(F.col("r.dimension"))
    out = a.alias("l").join(b.alias("r"), key, "full")
    return out.select(
        F.coalesce("l.dimension", "r.dimension").alias("dimension"), "hits", "eligible", ratio(F.col("hits"), F.col("eligible")).alias("recall_at_k"), ratio(F.col("rr"), F.col("eligible")).alias("mrr"),
        "relevant", "returned", ratio(F.col("relevant"), F.col("returned")).alias("precision_at_k"), ratio(F.col("returned") - F.col("relevant"), F.col("returned")).alias("noise_rate_at_k"), "scored_events", "missing_events",
    )


def _sent(cases: DataFrame, label: str) -> DataFrame:
    """cases, broadcast while they are few."""
    cases = scratch(cases, label)
    return F.broadcast(cases) if cases.count() <= MOST_CASES else cases


def case_states(gold: DataFrame, events: DataFrame, labels: DataFrame, mapping: DataFrame, retrieved: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Per gold fact: mapped (events), alternatives, retrieval_ready, retrieval_ok, predictions; scores and attribution read this.

    In a case without any label, all its emitted events count as valid.
    """
    # All that is known of an event meets its mapping by one key, and cases without labels, few as a rule, are sent to it. Such
    # a case is one of those with an event without a label, so the other cases need not be listed.
    both = ["case_id", "event_id"]
    some = _sent(events.join(labels.select(*both), both, "left_anti").select("case_id").distinct(), "unlabelled")
    named = labels.select("case_id").join(some, "case_id", "left_semi").distinct()
    bare = _sent(some.join(named, "case_id", "left_anti").withColumn("bare", F.lit(True)), "bare")
    valid = labels.where(F.col("label") == VALID).select(*both).distinct().withColumn("valid", F.lit(True))
    rows = mapping.join(events.select(*both), both, "left_semi").join(valid, both, "left").join(bare, "case_id", "left")
    rows = rows.where("valid OR bare").drop("valid", "bare")
    rows = rows.join(retrieved.select("case_id", "event_id", F.col("status").alias("r_status"), F.slice("chunks", 1, k).alias("chunks")), ["case_id", "event_id"], "left")
    rows = rows.join(judged.select("case_id", "event_id", F.col("status").alias("j_status"), "verdict"), ["case_id", "event_id"], "left")
    # A fact's events are gathered before they meet it, so that facts and events are dealt by fact once each.
    said = F.when(F.col("j_status") == "ok", F.col("verdict")).alias("said")
    per = rows.select("case_id", "gold_id", "ord", "event_id", F.coalesce(F.col("r_status") == "ok", F.lit(False)).alias("ready"), "chunks", said).repartition("case_id", "gold_id").groupBy("case_id", "gold_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "event_id"))), lambda x: x.event_id).alias("mapped"), F.max("ready").alias("retrieval_ready"), F.collect_set("chunks").alias("got"), F.collect_set("said").alias("predictions")
    )
    out = gold.join(per, ["case_id", "gold_id"], "left").withColumn("alternatives", F.size("sets") > 0)
    complete = F.exists("got", lambda chunks: _complete(F.col("sets"), chunks))
    return out.select(
        "case_id", "gold_id", "dimension", "expected", "sets", F.coalesce("mapped", F.array().cast(dict(per.dtypes)["mapped"])).alias("mapped"), "alternatives",
        F.coalesce("retrieval_ready", F.lit(False)).alias("retrieval_ready"), (~F.col("alternatives") | F.coalesce(complete, F.lit(False))).alias("retrieval_ok"),
        F.coalesce("predictions", F.array().cast("array<string>")).alias("predictions"),
    )


def system_scores(states: DataFrame) -> DataFrame:
    """One row: extraction, retrieval, verdict and conflict scores of a system, each with its own denominator.

    A conflict counts as predicted on a gold fact if any of its events was called one, whether evidence was complete or not.
    """
    found = F.size("mapped") > 0
    fit = found & F.col("retrieval_ready") & F.col("retrieval_ok")
    is_conflict, said = F.col("expected") == CONFLICT, F.array_contains("predictions", CONFLICT)
    s = states.agg(
        F.count("*").alias("gold"),
        F.count_if(found).alias("extracted"),
        F.count_if(found & F.col("alternatives")).alias("retrieval_eligible"),
        F.count_if(found & F.col("alternatives") & F.col("retrieval_ok")).alias("retrieval_hits"),
        F.count_if(fit).alias("judge_eligible"),
        F.count_if(fit & F.array_contains("predictions", F.col("expected"))).alias("judge_correct"),
        F.count_if(fit & is_conflict & ~said).alias("fn_with_complete_evidence"),
        F.count_if(is_conflict & said).alias("tp"),
        F.count_if(~is_conflict & said).alias("fp"),
        F.count_if(is_conflict & ~said).alias("fn"),
    )
    return s.select(
        "*", ratio(F.col("extracted"), F.col("gold")).alias("extraction_recall"), ratio(F.col("retrieval_hits"), F.col("retrieval_eligible")).alias("retrieval_recall"),
        ratio(F.col("judge_correct"), F.col("judge_eligible")).alias("judge_accuracy"), *prf(F.col("tp"), F.col("fp"), F.col("fn")),
    )


def state_confusion(states: DataFrame) -> DataFrame:
    """expected, predicted, n over facts with complete evidence; facts whose events disagree or have no verdict are mixed_or_missing."""
    fit = states.where((F.size("mapped") > 0) & F.col("retrieval_ready") & F.col("retrieval_ok"))
    one = F.when(F.size("predictions") == 1, F.get("predictions", 0)).otherwise("mixed_or_missing")
    return fit.groupBy("expected", one.alias("predicted")).agg(F.count("*").alias("n"))


def failures(states: DataFrame, failed_cases: DataFrame, reported: DataFrame) -> DataFrame:
    """case_id, gold_id, cause of each conflict that a run missed: the first stage that lost it.

    failed_cases: case_id of cases without a result; reported: case_id, gold_id, found (whether its finding is in the report; no
    row: nothing to report).
    """
    dead = _sent(failed_cases.select("case_id", F.lit(True).alias("dead")).distinct(), "dead")
    # Only what is not in the report tells; the rest need not be met.
    rows = states.where(F.col("expected") == CONFLICT).join(reported.where(~F.col("found")), ["case_id", "gold_id"], "left").join(dead, "case_id", "left")
    cause = (
        F.when(F.coalesce("dead", F.lit(False)), "execution_failure")
        .when(F.size("mapped") == 0, "extraction_miss")
        .when(F.col("alternatives") & ~F.col("retrieval_ok"), "retrieval_miss")
        .when(~F.array_contains("predictions", CONFLICT), "judge_fn")
        .when(F.col("found") == False, "report_miss")  # noqa: E712
    )
    return rows.select("case_id", "gold_id", cause.alias("cause")).where("cause IS NOT NULL")


def conditioned_verdicts(gold: DataFrame, events: DataFrame, labels: DataFrame, mapping: DataFrame, retrieved: DataFrame, judged: DataFrame) -> DataFrame:
    """case_id, gold_id, event_id, expected, predicted, strict: the verdict of the first valid judged event of each gold fact.

    ``strict`` says that its evidence holds a whole set, or that none is needed. Facts without such an event are left out.
    """
    rows = _mapped(mapping, events, labels).join(judged.select("case_id", "event_id", "verdict"), ["case_id", "event_id"])
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("case_id", "gold_id").orderBy("ord", "event_id"))).where("at = 1")
    rows = first.select("case_id", "gold_id", "event_id", F.col("verdict").alias("predicted")).join(gold, ["case_id", "gold_id"]).join(retrieved.select("case_id", "event_id", "chunks"), ["case_id", "event_id"], "left")
    needs = F.exists("sets", lambda s: F.size(s) > 0)
    strict = ~needs | _complete(F.col("sets"), F.coalesce("chunks", F.flatten(F.slice("sets", 1, 0))))
    return rows.select("case_id", "gold_id", "event_id", "expected", "predicted", strict.alias("strict"))


def finding_scores(cases: DataFrame, gold_findings: DataFrame, findings: DataFrame, finding_labels: DataFrame, finding_mapping: DataFrame, reportable: DataFrame) -> DataFrame:
    """One row: conflict findings right, wrong and missed, and rates of repeats, unsupported claims, omissions, exact stories and false alarms.

    gold_findings: case_id, gold_finding_id, gold_ids. findings: case_id, finding_id, verdict. finding_labels: case_id,
    finding_id, label, gold_finding_ids. finding_mapping: case_id, gold_finding_id, finding_id. reportable: case_id,
    gold_id of facts that were judged rightly and should be reported.
    """
    named = findings.join(finding_labels, ["case_id", "finding_id"], "left")
    right = finding_mapping.join(named.where("label = 'true_positive'").select("case_id", "finding_id"), ["case_id", "finding_id"], "left_semi")
    matched = gold_findings.join(right, ["case_id", "gold_finding_id"], "left_semi")
    known = gold_findings.groupBy("case_id").agg(F.collect_set("gold_finding_id").alias("known"))
    named = named.join(known, "case_id", "left")
    linked = F.coalesce(F.arrays_overlap("gold_finding_ids", "known"), F.lit(False))
    conflict = F.col("verdict") == CONFLICT
    wrong = conflict & (F.col("label").isin("false_positive", "unsupported") | ((F.col("label") == "true_positive") & ~linked))
    claims = named.groupBy("case_id").agg(
        F.count("*").alias("claims"), F.count_if(F.col("label") == "unsupported").alias("unsupported"), F.count_if(conflict).alias("conflicts"),
        F.count_if(conflict & (F.col("label") == "duplicate")).alias("repeats"), F.count_if(wrong).alias("fp"),
    )
    told = matched.select("case_id", F.explode("gold_ids").alias("gold_id")).distinct().withColumn("told", F.lit(True))
    owed = reportable.join(told, ["case_id", "gold_id"], "left").groupBy("case_id").agg(F.count("*").alias("owed"), F.count_if(F.col("told").isNull()).alias("omitted"))
    per = cases.select("case_id").join(gold_findings.groupBy("case_id").agg(F.count("*").alias("gold")), "case_id", "left")
    per = per.join(matched.groupBy("case_id").agg(F.count("*").alias("tp")), "case_id", "left").join(claims, "case_id", "left").join(owed, "case_id", "left").fillna(0)
    s = per.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum(F.col("gold") - F.col("tp")).alias("fn"), F.sum("repeats").alias("repeats"), F.sum("conflicts").alias("conflicts"), F.sum("unsupported").alias("unsupported"),
        F.sum("claims").alias("claims"), F.sum("omitted").alias("omitted"), F.sum("owed").alias("owed"), F.count_if((F.col("tp") == F.col("gold")) & (F.col("fp") == 0)).alias("exact"), F.count_if(F.col("fp") > 0).alias("alarmed"), F.count("*").alias("cases"),
    )
    rate = lambda a, b, name: ratio(F.col(a), F.col(b)).alias(name)
    return s.select(
        "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), rate("repeats", "conflicts", "duplicate_rate"), rate("unsupported", "claims", "unsupported_rate"),
        rate("omitted", "owed", "omission_rate"), rate("exact", "cases", "exact_story_rate"), rate("alarmed", "cases", "false_alarm_rate"),
    )


def one_to_one(gold: DataFrame, labels: DataFrame, judged: DataFrame) -> DataFrame:
    """case_id, event_id, gold_id (null: false alarm) of each alarm: in the order of judgement, it takes the smallest conflict of its facts that is still free.

    What an alarm may take depends on those before it. A case's alarms are one group, as a case is one story.
    """
    due = gold.where(F.col("expected") == CONFLICT).groupBy("case_id").agg(F.collect_set("gold_id").alias("due"))
    alarms = judged.where((F.col("status") == "ok") & (F.col("verdict") == CONFLICT)).join(labels, ["case_id", "event_id"]).join(due, "case_id", "left")
    may = F.when(F.col("label") == VALID, F.array_sort(F.array_intersect("gold_ids", F.coalesce("due", F.slice("gold_ids", 1, 0))))).otherwise(F.slice("gold_ids", 1, 0))
    return take_in_turn(alarms.select("case_id", F.col("event_id").alias("alarm_id"), "ord", may.alias("may"))).select("case_id", F.col("alarm_id").alias("event_id"), F.col("taken").alias("gold_id"))


def take_in_turn(rows: DataFrame) -> DataFrame:
    """case_id, alarm_id, taken: each row (case_id, alarm_id, ord, may) takes the first of its sorted choices that no earlier one took."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gone = None, set()
        for batch in batches:  # sorted by case and order, so a case is a run of rows
            out = []
            for case, alarm, may in zip(batch["case_id"], batch["alarm_id"], batch["may"], strict=True):
                if case != now:
                    now, gone = case, set()
                free = next((g for g in may if g not in gone), None) if may is not None else None
                if free is not None:
                    gone.add(free)
                out.append((case, alarm, free))
            yield pd.DataFrame(out, columns=["case_id", "alarm_id", "taken"], dtype=object)

    kinds = dict(rows.dtypes)
    dealt = rows.where("case_id IS NOT NULL").repartition("case_id").sortWithinPartitions("case_id", "ord", "alarm_id")
    return dealt.select("case_id", "alarm_id", "may").mapInPandas(take, f"case_id {kinds['case_id']}, alarm_id {kinds['alarm_id']}, taken {kinds['may'][6:-1]}")


def end_to_end(gold: DataFrame, matches: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of one_to_one()."""
    due = gold.agg(F.count_if(F.col("expected") == CONFLICT).alias("due"))
    s = matches.agg(F.count("gold_id").alias("tp"), F.count_if(F.col("gold_id").isNull()).alias("fp")).join(F.broadcast(due)).select("tp", "fp", (F.col("due") - F.col("tp")).alias("fn"))
    return s.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def error_packets(gold: DataFrame, labels: DataFrame, judged: DataFrame, retrieved: DataFrame, matches: DataFrame) -> DataFrame:
    """kind (FP, FN), case_id, ident, events, boundary: where each false alarm and each missed conflict was seen to go wrong."""
    wrong = matches.where("gold_id IS NULL").select("case_id", "event_id").join(labels, ["case_id", "event_id"])
    fp = wrong.select(F.lit("FP").alias("kind"), "case_id", F.col("event_id").cast("string").alias("ident"), F.array("event_id").alias("events"), F.when(F.col("label") != VALID, "extraction_nonvalid_then_judge").otherwise("requires_semantic_review").alias("boundary"))
    missed = gold.where(F.col("expected") == CONFLICT).join(matches.select("case_id", "gold_id"), ["case_id", "gold_id"], "left_anti").select("case_id", "gold_id")
    valid = labels.where(F.col("label") == VALID).select("case_id", "event_id", F.explode("gold_ids").alias("gold_id"))
    rows = missed.join(valid, ["case_id", "gold_id"], "left").join(judged.select("case_id", "event_id", "origin"), ["case_id", "event_id"], "left")
    per = rows.groupBy("case_id", "gold_id").agg(F.array_sort(F.collect_set("event_id")).alias("events"), F.count("origin").alias("items"), F.count_if(F.col("origin") == "program_nonactual_scope").alias("scoped"))
    gate = F.when(F.size("events") == 0, "extraction_missing").when((F.col("items") > 0) & (F.col("items") == F.col("scoped")), "program_scope_gate").otherwise("requires_semantic_review")
    return fp.unionByName(per.select(F.lit("FN").alias("kind"), "case_id", F.col("gold_id").cast("string").alias("ident"), "events", gate.alias("boundary")))


def claim_scores(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Per claim: found, verdict, verdict_ok, kind_ok, subject_ok, context_ok, and the items that hold its quote.

    claims: case_id, claim_id, quote, expected, kinds, subjects, terms. items: case_id, item_id, kind, entity, text, whole (all its
    fields as one text), status, verdict. Entities and time nodes hold no claims. A quote in items of different texts is not found.
    """
    facts = items.where(~F.col("kind").isin("entity", "timepoint"))
    met = claims.join(facts, "case_id").where(F.contains("text", "quote"))
    per = met.groupBy("case_id", "claim_id").agg(
        F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.collect_set(F.when(F.col("status") == "ok", F.col("verdict"))).alias("said"), F.count_if((F.col("status") != "ok") | F.col("verdict").isNull()).alias("lost"),
        F.min(F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False))).alias("kind_ok"), F.min(F.coalesce(F.array_contains("subjects", F.col("entity")), F.lit(False))).alias("subject_in"),
        F.min_by("whole", "item_id").alias("whole"), F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    rows = claims.join(per, ["case_id", "claim_id"], "left")
    found = F.coalesce(F.col("texts") == 1, F.lit(False))
    verdict = F.when((F.coalesce("n", F.lit(0)) == 0) | (F.col("lost") > 0), "missing").when(F.array_contains("said", CONFLICT), CONFLICT).when(F.array_contains("said", "uncertain"), "uncertain").otherwise("consistent")
    whole = F.forall("terms", lambda t: F.contains(F.col("whole"), t))
    return rows.select(
        "case_id", "claim_id", found.alias("found"), verdict.alias("verdict"), (found & (F.col("lost") == 0) & (F.size("said") == 1) & (F.get("said", 0) == F.col("expected"))).alias("verdict_ok"), (found & F.coalesce("kind_ok", F.lit(False))).alias("kind_ok"),
        ((F.size("subjects") == 0) | (found & F.coalesce("subject_in", F.lit(False)))).alias("subject_ok"), F.when(found, whole).otherwise(F.size("terms") == 0).alias("context_ok"), F.coalesce("items", F.array().cast(dict(per.dtypes)["items"])).alias("items"),
    )


def case_totals(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of all flags and counts of scores, overall and by each of ``keys`` (null: overall)."""
    kinds = dict(scores.dtypes)
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c, t in kinds.items() if t in ("boolean", "int", "bigint") and c not in keys and c != "case_id" and not c.endswith("_id")]
    return scores.groupingSets([[], *[[F.col(k)] for k in keys]], *[F.col(k) for k in keys]).agg(F.count("*").alias("rows"), *sums)


def quality_gate(base: DataFrame, candidate: DataFrame, pending: int, slack: int = 1) -> DataFrame:
    """One row: status (pending_review, pass or fail) of a candidate against a base, by hits, hallucinations and uncovered spans.

    base, candidate: one row of hits, hallucinated, uncovered. A candidate may lose ``slack`` hits, and nothing else.
    """
    b = base.select(F.col("hits").alias("b_hits"), F.col("hallucinated").alias("b_hallucinated"))
    ok = (F.col("hits") >= F.col("b_hits") - slack) & (F.col("hallucinated") <= F.col("b_hallucinated")) & (F.col("uncovered") == 0)
    return candidate.join(F.broadcast(b)).select("hits", "b_hits", "hallucinated", "b_hallucinated", "uncovered", F.when(F.lit(pending > 0), "pending_review").when(ok, "pass").otherwise("fail").alias("status"))
