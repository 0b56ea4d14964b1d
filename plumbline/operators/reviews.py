"""Review ledgers as long tables: templates, reuse, decisions, checks, corrections and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import digest
from plumbline.operators.checks import violations
from plumbline.operators.scoring import LABELS, VALID
from plumbline.sources.scratch import scratch

# The fields of events and findings that a signature covers, and what findings may be called.
EVENT_SIGNED = ("actors", "event", "mental_state", "explicit", "modality", "conditions", "source_ids", "context_ids", "check_reason")
FINDING_SIGNED = ("id", "event_ids", "verdict", "citations", "reason", "origin", "evidence")
FINDING_LABELS = ("true_positive", "false_positive", "duplicate", "unsupported", "correct")
PENDING = "pending"


def event_signature(e: Column) -> Column:
    """Digest of what an event says; its id and place play no part."""
    return digest(*[e.getField(f).alias(f) for f in EVENT_SIGNED])


def ledger_signature(case: Column, system: Column, e: Column, *names: str) -> Column:
    """Digest of an event or finding of one system's run of a case, by the named fields."""
    return digest(case.alias("case_id"), system.alias("system"), *[e.getField(f).alias(f"_{f}") for f in names])


def template(events: DataFrame, signature: Column) -> DataFrame:
    """A pending label for each event (case_id, event_id, ..), signed, for reviewers to fill."""
    none = F.array().cast("array<string>")
    return events.select("case_id", "event_id", signature.alias("signature"), F.lit(PENDING).alias("label"), none.alias("gold_ids"), F.lit(None).cast("string").alias("note"))


def reuse_exact(new: DataFrame, old: DataFrame, labels: DataFrame) -> DataFrame:
    """new (case_id, event_id, signature) with label, gold_ids and reused_from where exactly one old event of the case says the same and has a label.

    All else is pending.
    """
    once = old.groupBy("case_id", "signature").agg(F.count("*").alias("n"), F.first("event_id").alias("reused_from")).where("n = 1").drop("n")
    known = once.join(labels.where(F.col("label") != PENDING).select("case_id", F.col("event_id").alias("reused_from"), "label", "gold_ids"), ["case_id", "reused_from"])
    out = new.select("case_id", "event_id", "signature").join(known, ["case_id", "signature"], "left")
    return out.select("case_id", "event_id", "signature", F.coalesce("label", F.lit(PENDING)).alias("label"), F.coalesce("gold_ids", F.array().cast(dict(labels.dtypes)["gold_ids"])).alias("gold_ids"), "reused_from")


def decided(ledger: DataFrame, decisions: DataFrame, gold: DataFrame) -> DataFrame:
    """The ledger with its pending rows decided; decisions must meet exactly these, each once, with a label, known facts and a note.

    ledger: case_id, event_id, label, gold_ids. decisions: case_id, event_id, label, gold_ids, note. gold: case_id, gold_id.
    """
    d = decisions.groupBy("case_id", "event_id").agg(F.count("*").alias("__n"), F.first("label").alias("__label"), F.first("gold_ids").alias("__gold"), F.first("note").alias("__note"))
    known = gold.groupBy("case_id").agg(F.collect_set("gold_id").alias("__known"))
    rows = ledger.withColumn("__there", F.lit(True)).join(d, ["case_id", "event_id"], "full").join(known, "case_id", "left")
    open_ = F.col("__there").isNotNull() & (F.col("label") == PENDING)
    problem = (
        F.when(open_ & F.col("__n").isNull(), "undecided")
        .when(~open_ & F.col("__n").isNotNull(), "not pending")
        .when(open_ & (F.col("__n") > 1), "decided twice")
        .when(open_ & ~F.coalesce(F.col("__label").isin(*LABELS), F.lit(False)), "label")
        .when(open_ & ((F.size(F.array_distinct("__gold")) != F.size("__gold")) | (F.size(F.array_except("__gold", F.coalesce("__known", F.slice("__gold", 1, 0)))) > 0)), "gold")
        .when(open_ & (F.col("__label") != VALID) & (F.size("__gold") > 0), "gold of an invalid event")
        .when(open_ & ~F.coalesce(F.col("__note").rlike(r"\S"), F.lit(False)), "note")
    )
    value = lambda new, old: F.when(problem.isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("review decision:"), problem, F.col("case_id").cast("string"), F.col("event_id").cast("string"))).cast(dict(ledger.dtypes)[old])).when(open_, F.col(new)).otherwise(F.col(old))
    return rows.select("case_id", "event_id", value("__label", "label").alias("label"), value("__gold", "gold_ids").alias("gold_ids"), F.when(open_, F.col("__note")).alias("note"))


def label_problems(events: DataFrame, labels: DataFrame, gold: DataFrame, complete: bool = True) -> DataFrame:
    """case_id, event_id, rule: what is wrong with the labels of emitted events (case_id, event_id, signature).

    labels: case_id, event_id, signature, label, gold_ids, note, duplicate_of. Pending labels count only if the review is said to be
    ``complete``; labels of events that nobody emitted are unknown.
    """
    l = labels.withColumnRenamed("signature", "__signed").withColumn("__there", F.lit(True))
    known = gold.groupBy("case_id").agg(F.collect_set("gold_id").alias("__known"))
    emitted = events.groupBy("case_id").agg(F.collect_set("event_id").alias("__events"))
    rows = events.select("case_id", "event_id", "signature", F.lit(True).alias("__emitted")).join(l, ["case_id", "event_id"], "full").join(known, "case_id", "left").join(emitted, "case_id", "left")
    here, open_ = F.col("__emitted").isNotNull(), F.coalesce(F.col("label") == PENDING, F.lit(True))
    done = here & ~open_
    linked = F.coalesce("gold_ids", F.slice("__known", 1, 0))
    fine = {
        "unknown event": here,
        "unreviewed": ~here | ~open_ | F.lit(not complete),
        "label": ~done | F.col("label").isin(*LABELS),
        "signature": ~here | F.col("__there").isNull() | F.col("signature").eqNullSafe(F.col("__signed")),
        "gold": ~done | (F.size(linked) == 0) | ((F.size(F.array_except(linked, F.coalesce("__known", F.slice(linked, 1, 0)))) == 0) & (F.size(F.array_distinct(linked)) == F.size(linked))),
        "gold of an invalid event": ~done | (F.col("label") == VALID) | (F.size(linked) == 0),
        "note": ~done | ~F.col("label").isin("hallucinated", "overselected") | F.coalesce(F.col("note").rlike(r"\S"), F.lit(False)),
        "duplicate_of": ~done | (F.col("label") != "duplicate") | (F.array_contains("__events", F.col("duplicate_of")) & (F.col("duplicate_of") != F.col("event_id"))),
    }
    return violations(rows.withColumn("__key", F.struct("case_id", "event_id")), "__key", fine).select("__key.*", "rule")


def mapping_problems(mapping: DataFrame, gold: DataFrame, events: DataFrame) -> DataFrame:
    """case_id, gold_id, event_id, rule: mappings of facts or to events that are not there."""
    m = mapping.select("case_id", "gold_id", "event_id")
    no_gold = m.join(gold.select("case_id", "gold_id"), ["case_id", "gold_id"], "left_anti").withColumn("rule", F.lit("gold"))
    no_event = m.join(events.select("case_id", "event_id"), ["case_id", "event_id"], "left_anti").select("case_id", "gold_id", "event_id", F.lit("event").alias("rule"))
    return no_gold.unionByName(no_event)


def unprefixed(rows: DataFrame, key: str, prefix: str = "candidate:") -> DataFrame:
    """Rows whose key bears the prefix, without it."""
    return rows.where(F.col(key).startswith(prefix)).withColumn(key, F.regexp_replace(key, f"^{prefix}", ""))


def changed_cases(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id of cases whose events (case_id, signature) differ between two runs as multisets."""
    count = lambda d, n: d.groupBy("case_id", "signature").agg(F.count("*").alias(n))
    both = count(old, "a").join(count(new, "b"), ["case_id", "signature"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("case_id").distinct()


def run_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, status_changed, events_changed, output_changed, missing for cases of a new run that differ from the old one.

    Both: case_id, status, events, output (digests or texts). A case that the old run lacks has changed in all.
    """
    o = old.select("case_id", *[F.col(c).alias(f"__{c}") for c in ("status", "events", "output")], F.lit(True).alias("__there"))
    j = new.join(o, "case_id", "left")
    gone = F.col("__there").isNull()
    diff = lambda c: (gone | ~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(f"{c}_changed")
    out = j.select("case_id", diff("status"), diff("events"), diff("output"), gone.alias("missing"))
    return out.where("status_changed OR events_changed OR output_changed")


def prefix_done(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases (case_id, ord) still to run; finished ones must be the first of them without a gap, else it is an error."""
    rows = cases.join(done.select("case_id", F.lit(1).alias("done")), "case_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    s = rows.agg(F.sum("done").alias("n"), F.max(F.when(F.col("done") == 1, F.col("ord"))).alias("last"), F.min("ord").alias("first")).first()
    if s["n"] and s["last"] - s["first"] + 1 != s["n"]:
        raise ValueError("finished cases are not the first ones")
    return rows.where("done = 0").drop("done")


def importance_review(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """story_id, id, state (kept, discarded, pending) of candidate facts, and story_id, id, issue of decisions that don't meet them once each.

    candidates: story_id, id. decisions: story_id, id, keep (boolean).
    """
    d = decisions.groupBy("story_id", "id").agg(F.count("*").alias("n"), F.bool_and("keep").alias("keep"))
    both = candidates.select("story_id", "id", F.lit(True).alias("there")).join(d, ["story_id", "id"], "full")
    state = F.when(F.coalesce("n", F.lit(0)) != 1, PENDING).when(F.col("keep"), "kept").otherwise("discarded")
    issue = F.when(F.col("there").isNull(), "unknown candidate").when(F.col("n").isNull(), "no decision").when(F.col("n") > 1, "repeated decision")
    return both.where("there").select("story_id", "id", state.alias("state")), both.select("story_id", "id", issue.alias("issue")).where("issue IS NOT NULL")


def keep_support(events: DataFrame, decisions: DataFrame, most_rounds: int = 50) -> DataFrame:
    """decisions (story_id, event_id, decision) with ignored events kept that kept ones refer to, and support_only, required_by.

    events: story_id, event_id, source_ids, context_ids. An event that is kept for another one may refer to more, so rounds
    go on until none changes; each follows only what the round before has kept.
    """
    kind = dict(decisions.dtypes)["event_id"]
    gives = events.select("story_id", "event_id", F.explode("source_ids").alias("span"))
    asks = events.select("story_id", F.col("event_id").alias("by"), F.explode("context_ids").alias("span"))
    refers = asks.join(gives, ["story_id", "span"]).select("story_id", "by", "event_id").distinct()
    # Only ignored events change, so only references to them matter; each is followed once, in the round after its event was kept.
    open_ = scratch(refers.join(decisions.where("decision = 'ignore'").select("story_id", "event_id"), ["story_id", "event_id"], "left_semi"), "support")
    fresh, rounds = decisions.where("decision = 'keep'").select("story_id", F.col("event_id").alias("by")).distinct(), []
    for _ in range(most_rounds):
        need = scratch(open_.join(fresh, ["story_id", "by"], "left_semi").groupBy("story_id", "event_id").agg(F.array_sort(F.collect_set("by")).alias("__by")), "support")
        if not need.limit(1).count():
            break
        rounds.append(need)
        fresh = need.select("story_id", F.col("event_id").alias("by"))
        open_ = scratch(open_.join(need.select("story_id", "event_id"), ["story_id", "event_id"], "left_anti"), "support")
    else:
        raise RuntimeError(f"support did not settle in {most_rounds} rounds")
    state = decisions.select("story_id", "event_id", "decision")
    none = F.array().cast(f"array<{kind}>")
    if not rounds:
        return state.select("*", F.lit(False).alias("support_only"), none.alias("required_by"))
    found = reduce(DataFrame.unionByName, rounds)
    state = state.join(found, ["story_id", "event_id"], "left")
    new = F.col("__by").isNotNull() & (F.col("decision") == "ignore")
    return state.select("story_id", "event_id", F.when(new, "keep").otherwise(F.col("decision")).alias("decision"), F.coalesce(new, F.lit(False)).alias("support_only"), F.when(new, F.col("__by")).otherwise(none).alias("required_by"))
