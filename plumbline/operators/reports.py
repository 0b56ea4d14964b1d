"""Whether the reports of stages agree with themselves and with the stage before, as tables of broken rules; sections of a report for its reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import judging
from plumbline.functions.rules import verdict_of
from plumbline.functions.wire import IGNORE_REASONS, MODALITIES
from plumbline.operators.checks import violations

# States of runs and decisions.
STATES = ("ok", "partial", "error")
DECISIONS = ("keep", "ignore", "review")
SUPPORT = "support_only"
WORSE = {"ok": 0, "partial": 1, "error": 2}


def _keyed(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    return violations(rows.withColumn("__key", F.struct(*keys)), "__key", rules).select("__key.*", "rule")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _rank(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in WORSE.items() for x in pair]), status)


def hidden_failures(rows: DataFrame, upstream: DataFrame) -> DataFrame:
    """case_id of reports (case_id, status) that look better than the stage before them."""
    u = upstream.select("case_id", F.col("status").alias("__u"))
    return rows.join(u, "case_id").where(_rank(F.col("status")) < _rank(F.col("__u"))).select("case_id")


def extraction_problems(stories: DataFrame, spans: DataFrame, events: DataFrame, ignored: DataFrame, non_events: DataFrame) -> DataFrame:
    """case_id, id (a span's or null), rule of extraction reports.

    stories: case_id, text, status, uncovered (ids reported). spans: case_id, id, text, start, stop. events: case_id, event_id,
    source_ids. ignored: case_id, source_id, reason. non_events: case_id, id.
    """
    told = stories.select("case_id", F.col("text").alias("__story"), "status", "uncovered")
    cut = F.substring(F.col("__story"), F.col("start") + 1, F.col("stop") - F.col("start"))
    placed = _keyed(spans.join(told, "case_id", "left"), ["case_id", "id"], {"span text": cut == F.col("text")})
    e = events.select("case_id", F.explode(F.array_distinct("source_ids")).alias("id")).distinct().withColumn("kind", F.lit("event"))
    claims = _union([e, ignored.select("case_id", F.col("source_id").alias("id"), F.lit("ignored").alias("kind")), non_events.select("case_id", "id", F.lit("non_event").alias("kind"))])
    claims = claims.groupBy("case_id", "id").agg(F.count("*").alias("n"))
    both = spans.select("case_id", "id", F.lit(True).alias("there")).join(claims, ["case_id", "id"], "full")
    rule = F.when(F.col("there").isNull(), "unknown span").when(F.col("n") > 1, "repeated disposition")
    claimed = both.select("case_id", "id", rule.alias("rule")).where("rule IS NOT NULL")
    missing = both.where("there AND n IS NULL").groupBy("case_id").agg(F.array_sort(F.collect_list("id")).alias("missing"))
    whole = told.join(missing, "case_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    fine = {"status": F.col("status").isin(*STATES), "uncovered": (F.size("missing") == 0) | ((F.col("status") != "ok") & (F.array_sort("uncovered") == F.col("missing")))}
    states = violations(whole, "case_id", fine).select("case_id", F.lit(None).cast("string").alias("id"), "rule")
    reasons = ignored.where(~F.coalesce(F.col("reason").isin(*IGNORE_REASONS), F.lit(False))).select("case_id", F.col("source_id").alias("id"), F.lit("ignore reason").alias("rule"))
    return _union([placed, claimed, states, reasons])


def input_problems(events: DataFrame) -> DataFrame:
    """case_id, event_id, rule of events that are to be filtered (actors, event, modality, explicit, conditions)."""
    n = F.count("*").over(Window.partitionBy("case_id", "event_id"))
    filled = lambda x: F.coalesce(x.rlike(r"(?U)\S"), F.lit(False))
    fine = {
        "id": filled(F.col("event_id").cast("string")) & (F.col("__n") == 1),
        "event": filled(F.col("event")),
        "actors": (F.size("actors") > 0) & F.forall("actors", filled),
        "modality": F.col("modality").isin(*MODALITIES),
        "explicit": F.col("explicit").isNotNull(),
        "conditions": F.col("conditions").isNotNull(),
    }
    return _keyed(events.withColumn("__n", n), ["case_id", "event_id"], fine).distinct()


def filtering_problems(events: DataFrame, decisions: DataFrame, listed: DataFrame) -> DataFrame:
    """case_id, event_id, rule: decisions must meet events once each, lists must hold what was decided, and support must name kept events.

    decisions: case_id, event_id, decision, support_only, required_by. listed: case_id, event_id, decision (the list it is in).
    """
    d = decisions.groupBy("case_id", "event_id").agg(F.count("*").alias("n"), F.first("decision").alias("decision"), F.first(SUPPORT).alias(SUPPORT), F.first("required_by").alias("required_by"))
    l = listed.groupBy("case_id", "event_id").agg(F.count("*").alias("lists"), F.first("decision").alias("list"))
    kept = d.where("decision = 'keep'").groupBy("case_id").agg(F.collect_set("event_id").alias("kept"))
    rows = events.select("case_id", "event_id", F.lit(True).alias("there")).join(d, ["case_id", "event_id"], "full").join(l, ["case_id", "event_id"], "full").join(kept, "case_id", "left")
    held = F.coalesce("kept", F.slice("required_by", 1, 0))
    fine = {
        "unknown event": F.col("there").isNotNull(),
        "decided once": F.col("there").isNull() | (F.col("n") == 1),
        "decision": F.col("n").isNull() | F.col("decision").isin(*DECISIONS),
        "listed": F.col("n").isNull() | ((F.col("lists") == 1) & (F.col("list") == F.col("decision"))),
        "support": ~F.coalesce(F.col(SUPPORT), F.lit(False)) | ((F.col("decision") == "keep") & (F.size("required_by") > 0) & (F.size(F.array_except("required_by", held)) == 0)),
    }
    return _keyed(rows, ["case_id", "event_id"], fine)


def retrieval_problems(events: DataFrame, items: DataFrame) -> DataFrame:
    """case_id, event_id, rule: retrieval items must meet the events that go on, once each, with evidence of distinct, filled chunks.

    events: case_id, event_id, support_only. items: case_id, event_id, status, evidence (array of struct(id, text)).
    """
    i = items.groupBy("case_id", "event_id").agg(F.count("*").alias("n"), F.first("status").alias("status"), F.first("evidence").alias("evidence"))
    rows = events.select("case_id", "event_id", F.coalesce(SUPPORT, F.lit(False)).alias("support"), F.lit(True).alias("there")).join(i, ["case_id", "event_id"], "full")
    ids = F.transform("evidence", lambda c: c.id)
    here = F.col("n").isNotNull()
    fine = {
        "unknown event": F.col("there").isNotNull(),
        "missing": F.col("there").isNull() | here,
        "repeated": ~here | (F.col("n") == 1),
        "status": ~here | F.col("status").isin("ok", "error", SUPPORT),
        "support": ~here | F.col("there").isNull() | ((F.col("status") == SUPPORT) == F.col("support")),
        "evidence": ~here | (F.forall("evidence", lambda c: F.coalesce((c.id != "") & c.text.rlike(r"(?U)\S"), F.lit(False))) & (F.size(F.array_distinct(ids)) == F.size(ids))),
    }
    return _keyed(rows, ["case_id", "event_id"], fine)


def judge_problems(items: DataFrame, judged: DataFrame) -> DataFrame:
    """case_id, event_id, rule: verdicts must meet retrieval items, hide no failure and cite what was retrieved, word for word.

    items: case_id, event_id, status, evidence. judged: case_id, event_id, status, verdict, reason, citations (array of
    struct(evidence_id, chunk_id, quote)).
    """
    j = judged.groupBy("case_id", "event_id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("status", "verdict", "reason", "citations")])
    rows = items.select("case_id", "event_id", F.col("status").alias("before"), "evidence").join(j, ["case_id", "event_id"], "full")
    here, support = F.col("n").isNotNull(), F.col("status") == SUPPORT
    chunk = lambda c: F.try_element_at("evidence", F.greatest(F.coalesce(F.substring(c.evidence_id, 2, 9).try_cast("int"), F.lit(1)), F.lit(1)))
    cited = lambda c: F.coalesce(c.evidence_id.rlike("^L[1-9][0-9]*$") & (chunk(c).id == c.chunk_id) & c.quote.rlike(r"(?U)\S") & F.contains(chunk(c).text, c.quote), F.lit(False))
    labels = F.transform("citations", lambda c: c.evidence_id)
    judgeable = here & F.col("before").isNotNull() & ~F.coalesce(support, F.lit(False))
    fine = {
        "unknown event": F.col("before").isNotNull(),
        "missing": F.col("before").isNull() | here,
        "repeated": ~here | (F.col("n") == 1),
        "status": ~here | F.col("status").isin("ok", "error", SUPPORT),
        "support": ~here | F.col("before").isNull() | (support == (F.col("before") == SUPPORT)),
        "support verdict": ~here | ~F.coalesce(support, F.lit(False)) | F.col("verdict").isNull(),
        "verdict": ~judgeable | (F.col("verdict").isin(*judging.VERDICTS) & F.col("reason").rlike(r"(?U)\S")),
        "failure": ~judgeable | (F.col("status") != "error") | (F.col("verdict") == "uncertain"),
        "hidden failure": ~judgeable | (F.col("before") != "error") | (F.col("status") == "error"),
        "missing citation": ~judgeable | (F.col("verdict") == "uncertain") | (F.size("citations") > 0),
        "citation": ~judgeable | (F.forall("citations", cited) & (F.size(F.array_distinct(labels)) == F.size(labels))),
    }
    return _keyed(rows, ["case_id", "event_id"], fine)


def pair_problems(events: DataFrame, results: DataFrame, pairs: DataFrame) -> DataFrame:
    """case_id, rule: a story check must account for every pair of observed events, once each, without hiding what failed.

    events: case_id, event_id, observed. results: case_id, status, pair_count, unprocessed. pairs: case_id, pair_id, first, second, status, verdict.
    """
    n = events.where("observed").groupBy("case_id").agg(F.count("*").alias("k"), F.collect_set("event_id").alias("ids"))
    p = pairs.select("case_id", "pair_id", F.array_sort(F.array("first", "second")).alias("pair"), "status", "verdict").join(n, "case_id", "left")
    known = F.coalesce("ids", F.slice("pair", 1, 0))
    per = p.groupBy("case_id").agg(
        F.count("*").alias("items"), F.count_distinct("pair").alias("distinct_pairs"), F.count_distinct("pair_id").alias("distinct_ids"), F.count_if(F.size(F.array_except("pair", known)) > 0).alias("strange"),
        F.count_if(F.get("pair", 0) == F.get("pair", 1)).alias("selves"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if((F.col("status") == "error") & (F.col("verdict") != "uncertain")).alias("told"),
    )
    rows = results.join(n, "case_id", "left").join(per, "case_id", "left").fillna(0)
    due = (F.col("k") * (F.col("k") - 1) / 2).cast("long")
    fine = {
        "status": F.col("status").isin("ok", "partial"),
        "pair_count": F.col("pair_count") == due,
        "accounted": (F.col("unprocessed") >= 0) & (F.col("items") + F.col("unprocessed") == due),
        "pairs": (F.col("items") == F.col("distinct_pairs")) & (F.col("items") == F.col("distinct_ids")) & (F.col("strange") == 0) & (F.col("selves") == 0),
        "failure": F.col("told") == 0,
        "hidden failure": (F.col("status") != "ok") | ((F.col("unprocessed") == 0) & (F.col("errors") == 0)),
    }
    return violations(rows, "case_id", fine)


def sections(findings: DataFrame) -> DataFrame:
    """findings (verdict, origin, modality, uncertainty_code) with the section of a report they belong to.

    Uncertain findings on actual events that no rule covers may be additions; the rest are to be confirmed.
    """
    actual = F.col("modality").isin("observed", "conditional") & (F.coalesce("origin", F.lit("")) != "program_nonactual_scope")
    bare = (F.col("uncertainty_code") == "missing_rule") | (F.col("origin") == "program_no_evidence")
    section = (
        F.when(F.col("verdict") == "contradiction", "contradictions")
        .when(F.col("verdict") == "consistent", "confirmations")
        .when(F.coalesce(actual & bare, F.lit(False)), "possible_additions")
        .otherwise("uncertainties")
    )
    return findings.withColumn("section", section)


def overview(sectioned: DataFrame, group: str) -> DataFrame:
    """Per group: how many findings are in each section, and the most severe verdict."""
    n = lambda s: F.count_if(F.col("section") == s).alias(s)
    return sectioned.groupBy(group).agg(*[n(s) for s in ("contradictions", "possible_additions", "uncertainties", "confirmations")], verdict_of(F.col("verdict")).alias("verdict"))


def author_report(title: str, sectioned: DataFrame, order: str, text: str, most: int = 1000) -> str:
    """Sections of one report as text for its author; a report is read by a person, so more than ``most`` findings are an error."""
    rows = sectioned.orderBy(order).select("section", text).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many findings for one report")
    out = [title]
    for name in ("contradictions", "possible_additions", "uncertainties", "confirmations"):
        found = [r[text] for r in rows if r["section"] == name]
        out += ["", f"{name}:", *([f"{i}. {t}" for i, t in enumerate(found, 1)] or ["none"])]
    return "\n".join(out) + "\n"
