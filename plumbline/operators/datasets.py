"""Gold datasets: anchors, evidence sets, distributions, upgrades, builders and fixtures, as rule tables.

cases: case_id, grp, story, character_count, dimensions. facts: case_id, gold_id, subject, predicate, object,
normalized_fact, type, dimension, expected, reportable, anchors, context_anchors (arrays of struct(text, start, stop)),
relevant, sets. findings: case_id, finding_id, gold_ids, expected_type, dimension, sets, merge. ignored: case_id, anchor,
proposition, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.contracts import SAID
from plumbline.operators.checks import repeated_keys, violations

# Lengths of stories, groups with their conflicts, reasons, paddings of a built story.
LEAST_STORY, MOST_STORY, BUILT_STORY = 200, 800, 205
GROUPS = {"zero_conflict": 0, "one_conflict": 1, "multi_conflict": 2}
IGNORED = ("routine", "process_detail")
SAME, CONFLICT, OPEN = SAID
STORY_HEAD = "故事发生在城区的一间安静房间里。人物先观察周围环境，再按照当时的情况继续行动。"
STORY_FILL = "他把杯子移到桌子中央，整理衣袖，检查门窗，又在椅子旁停了一会儿。"
STORY_TAIL = "随后房间里的光线慢慢移动，风吹过窗帘，桌上的纸张仍留在原处。人物确认没有新的动静，便继续等待后续安排。"
STORY_PAD = "他安静地观察四周。"
ROUTINE = "他把杯子移到桌子中央，"
CHARACTER_DIMENSIONS = ("physical_rule", "identity", "character_relation")


def anchor_ok(anchor: Column, story: Column) -> Column:
    """Whether an anchor's text is the story's from start to stop (code points, end exclusive)."""
    inside = (anchor.start >= 0) & (anchor.start < anchor.stop) & (anchor.stop <= F.length(story))
    return F.coalesce(inside & (anchor.text != "") & (F.substring(story, anchor.start + 1, anchor.stop - anchor.start) == anchor.text), F.lit(False))


def sets_ok(sets: Column, relevant: Column, required: Column) -> Column:
    """Whether evidence sets are non-empty subsets of the relevant ids without repeats, and there is one if one is required."""
    each = F.forall(sets, lambda s: (F.size(s) > 0) & (F.size(F.array_distinct(s)) == F.size(s)) & (F.size(F.array_except(s, relevant)) == 0))
    return F.coalesce(each & (~required | (F.size(sets) > 0)), F.lit(False))


def fact_problems(facts: DataFrame, cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, gold_id, rule: rules that gold facts break against their story and the collection (chunk_id)."""
    known = chunks.select(F.col("chunk_id").alias("c"), F.lit(True).alias("k")).distinct()
    stray = facts.select("case_id", "gold_id", F.explode("relevant").alias("c")).join(known, "c", "left_anti").select("case_id", "gold_id").distinct().withColumn("__stray", F.lit(True))
    twice = repeated_keys(facts, ["case_id", "gold_id"]).select("case_id", "gold_id", F.lit(True).alias("__twice"))
    rows = facts.join(cases.select("case_id", "story"), "case_id", "left").join(stray, ["case_id", "gold_id"], "left").join(twice, ["case_id", "gold_id"], "left")
    filled = lambda c: F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))
    fine = {
        "case": F.col("story").isNotNull(),
        "id": F.col("__twice").isNull(),
        **{c: filled(c) for c in ("subject", "predicate", "normalized_fact", "type")},
        "dimension": F.col("dimension").isin(*rules.DIMENSIONS, "time"),
        "verdict": F.col("expected").isin(*SAID),
        "reportable": F.col("reportable").isNotNull(),
        "anchors": (F.size("anchors") > 0) & F.forall("anchors", lambda a: anchor_ok(a, F.col("story"))),
        "context_anchors": F.forall("context_anchors", lambda a: anchor_ok(a, F.col("story"))),
        "relevant": F.col("__stray").isNull() & (F.size(F.array_distinct("relevant")) == F.size("relevant")),
        "sets": sets_ok(F.col("sets"), F.col("relevant"), F.col("expected") != OPEN),
    }
    return violations(rows.withColumn("__key", F.struct("case_id", "gold_id")), "__key", fine).select("__key.*", "rule").distinct()


def case_problems(cases: DataFrame, facts: DataFrame, findings: DataFrame, ignored: DataFrame) -> DataFrame:
    """case_id, rule: rules about whole cases: lengths, groups and their conflicts, ignored passages, findings that cover the conflicts."""
    per = facts.groupBy("case_id").agg(
        F.count_if(F.col("expected") == CONFLICT).alias("conflicts"),
        F.collect_set(F.when((F.col("expected") == CONFLICT) & F.col("reportable"), F.col("gold_id"))).alias("owed"),
        F.flatten(F.collect_list(F.transform("anchors", lambda a: F.struct(a.start.alias("start"), a.stop.alias("stop"))))).alias("taken"),
    )
    told = findings.groupBy("case_id").agg(F.array_distinct(F.flatten(F.collect_list("gold_ids"))).alias("told"))
    passed = ignored.groupBy("case_id").agg(F.collect_list(F.struct("anchor", "proposition", "reason")).alias("passed"))
    rows = cases.join(per, "case_id", "left").join(told, "case_id", "left").join(passed, "case_id", "left").join(repeated_keys(cases, ["case_id"]).withColumnRenamed("n", "__twice"), "case_id", "left")
    due = F.try_element_at(F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair]), F.col("grp"))
    none = F.slice("owed", 1, 0)
    known = F.coalesce("passed", F.slice("passed", 1, 0))
    fine = {
        "id": F.col("__twice").isNull(),
        "length": F.length("story").between(LEAST_STORY, MOST_STORY),
        "character_count": F.col("character_count") == F.length("story"),
        "group": due.isNotNull(),
        "dimensions": F.forall("dimensions", lambda d: d.isin(*rules.DIMENSIONS, "time")),
        "conflicts": due.isNull() | (F.coalesce("conflicts", F.lit(0)) == due),
        "ignored anchor": known.isNull() | F.forall(known, lambda x: anchor_ok(x.anchor, F.col("story"))),
        "ignored reason": known.isNull() | F.forall(known, lambda x: F.coalesce(x.reason.isin(*IGNORED) & x.proposition.rlike(r"(?U)\S"), F.lit(False))),
        "ignored fact": known.isNull() | ~F.exists(known, lambda x: F.exists(F.coalesce("taken", F.slice("taken", 1, 0)), lambda t: (t.start == x.anchor.start) & (t.stop == x.anchor.stop))),
        "findings": F.array_sort(F.coalesce("owed", none)) == F.array_sort(F.coalesce("told", none)),
    }
    rows = rows.withColumn("taken", F.coalesce("taken", F.array().cast("array<struct<start: int, stop: int>>"))).withColumn("owed", F.coalesce("owed", F.array().cast(dict(facts.select(F.array("gold_id").alias("x")).dtypes)["x"])))
    return violations(rows, "case_id", fine).distinct()


def finding_problems(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """case_id, finding_id, rule: rules that gold findings break against the facts they cover."""
    each = findings.select("case_id", "finding_id", F.explode("gold_ids").alias("gold_id")).join(facts.select("case_id", "gold_id", "expected", "reportable", "relevant"), ["case_id", "gold_id"], "left")
    per = each.groupBy("case_id", "finding_id").agg(
        F.count_if(F.col("expected").isNull()).alias("unknown"), F.count_if((F.col("expected") != CONFLICT) | ~F.col("reportable")).alias("odd"), F.array_distinct(F.flatten(F.collect_list("relevant"))).alias("relevant")
    )
    rows = findings.join(per, ["case_id", "finding_id"], "left")
    fine = {
        "facts": (F.size("gold_ids") > 0) & (F.size(F.array_distinct("gold_ids")) == F.size("gold_ids")) & (F.col("unknown") == 0),
        "type": F.col("expected_type") == "conflict",
        "dimension": F.col("dimension").isin(*rules.DIMENSIONS, "time"),
        "conflicts": F.coalesce("odd", F.lit(0)) == 0,
        "sets": sets_ok(F.col("sets"), F.coalesce("relevant", F.slice(F.flatten("sets"), 1, 0)), F.lit(True)),
        "merge": F.col("merge").isNotNull(),
    }
    return violations(rows.withColumn("__key", F.struct("case_id", "finding_id")), "__key", fine).select("__key.*", "rule")


def distribution_problems(rows: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """value, n, expected of values that occur more or less often than they should, or should not at all."""
    due = rows.sparkSession.createDataFrame(list(expected.items()), "value string, expected long")
    both = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).join(due, "value", "full").fillna(0, ["n", "expected"])
    return both.where("n <> expected")


def upgraded_facts(old: DataFrame) -> DataFrame:
    """Gold facts of the first schema in the current one; it knew one dimension only.

    old: case_id, gold_id, subject, predicate, object, type, verdict, anchor, context_anchors, evidence (ids), sets.
    """
    text = F.concat(*[F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object")])
    return old.select(
        "case_id", "gold_id", "subject", "predicate", "object", text.alias("normalized_fact"), "type", F.lit("physical_rule").alias("dimension"), F.col("verdict").alias("expected"),
        (F.col("verdict") == CONFLICT).alias("reportable"), F.array("anchor").alias("anchors"), "context_anchors", F.col("evidence").alias("relevant"), F.coalesce("sets", F.array().cast(dict(old.dtypes)["sets"])).alias("sets"),
    )


def conflict_findings(facts: DataFrame) -> DataFrame:
    """One finding for each reportable conflict, named after its fact."""
    hit = facts.where((F.col("expected") == CONFLICT) & F.col("reportable"))
    return hit.select("case_id", F.concat(F.lit("F"), F.regexp_replace("gold_id", "^G+", "")).alias("finding_id"), F.array("gold_id").alias("gold_ids"), F.lit("conflict").alias("expected_type"), "dimension", "sets", F.lit(False).alias("merge"))


def built_story(sentences: Column) -> Column:
    """A story around the sentences, padded to its least length."""
    bare = F.concat(F.lit(STORY_HEAD), F.array_join(sentences, ""), F.lit(STORY_FILL + STORY_TAIL))
    short = F.greatest(F.lit(0), F.ceil((BUILT_STORY - F.length(bare)) / len(STORY_PAD))).cast("int")
    return F.concat(bare, F.repeat(F.lit(STORY_PAD), short))


def built_cases(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cases (case_id, story, character_count, dimensions, ignored) and facts with anchors, from facts (case_id, ord, gold_id, sentence, .., expected, dimension, relevant).

    Sentences are laid end to end, so each one's place follows from the lengths before it.
    """
    w = Window.partitionBy("case_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.length("sentence")).over(w), F.lit(0)) + len(STORY_HEAD)).cast("int")
    placed = facts.withColumn("__start", start)
    anchor = F.struct(F.col("sentence").alias("text"), F.col("__start").alias("start"), (F.col("__start") + F.length("sentence")).alias("stop"))
    need = F.when(F.col("expected") != OPEN, F.array("relevant")).otherwise(F.slice(F.array("relevant"), 1, 0))
    out = placed.withColumns({"anchors": F.array(anchor), "sets": need, "reportable": F.col("expected") == CONFLICT, "normalized_fact": F.concat("subject", "predicate", F.coalesce("object", F.lit("")))})
    cases = facts.groupBy("case_id").agg(built_story(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda x: x.sentence)).alias("story"), F.array_sort(F.collect_set("dimension")).alias("dimensions"))
    at = F.instr("story", ROUTINE) - 1
    ignored = F.struct(F.lit(ROUTINE).alias("text"), at.alias("start"), (at + len(ROUTINE)).alias("stop"))
    return cases.select("case_id", "story", F.length("story").alias("character_count"), "dimensions", ignored.alias("ignored")), out.drop("__start")


def fixture(claims: DataFrame, canonical: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """fixture_id, canonical (ids), lore (up to k ids): annotated chunks first, then retrieved ones, each once.

    canonical: fixture_id, chunk_id, ord; retrieved: fixture_id, chunk_id, rank. A claim without any chunk is an error.
    """
    both = canonical.select("fixture_id", "chunk_id", F.lit(0).alias("from"), F.col("ord").alias("at")).unionByName(retrieved.select("fixture_id", "chunk_id", F.lit(1).alias("from"), F.col("rank").alias("at")))
    first = both.groupBy("fixture_id", "chunk_id").agg(F.min(F.struct("from", "at")).alias("p"))
    lists = first.groupBy("fixture_id").agg(F.array_sort(F.collect_list(F.struct("p", "chunk_id"))).alias("x"))
    ids = lambda rows: F.transform(rows, lambda r: r.chunk_id)
    out = claims.select("fixture_id").join(lists, "fixture_id", "left")
    lore = F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("no chunk for claim "), F.col("fixture_id").cast("string"))).cast("array<string>")).otherwise(F.slice(ids(F.col("x")), 1, k))
    return out.select("fixture_id", ids(F.filter("x", lambda r: r.p["from"] == 0)).alias("canonical"), lore.alias("lore"))


def fixture_problems(items: DataFrame, per_label: int, k: int) -> DataFrame:
    """fixture_id, rule: items (fixture_id, expected, lore, canonical) that are repeated, hold too much or lack their annotated evidence; labels out of balance are under a null id."""
    n = F.count("*").over(Window.partitionBy("fixture_id"))
    rows = items.withColumn("__n", n)
    fine = {
        "id": (F.col("__n") == 1) & (F.col("fixture_id") != ""),
        "lore": F.size("lore").between(1, k) & (F.size(F.array_distinct("lore")) == F.size("lore")),
        "canonical": F.size(F.array_except("canonical", "lore")) == 0,
        "evidence": (F.col("expected") == OPEN) | (F.size("canonical") > 0),
    }
    off = distribution_problems(items, "expected", dict.fromkeys(SAID, per_label))
    return violations(rows, "fixture_id", fine).unionByName(off.select(F.lit(None).cast(dict(items.dtypes)["fixture_id"]).alias("fixture_id"), F.concat(F.lit("balance of "), F.col("value")).alias("rule")))


def oracle_items(facts: DataFrame, curated: DataFrame, overrides: DataFrame, chunks: DataFrame) -> DataFrame:
    """fixture_id, case_id, gold_id, expected, lore, source of each fact with the evidence that a judge should get.

    Decided facts take their first evidence set; open ones what a curator chose (curated: normalized_fact, lore, rationale), with
    a verdict that may be overridden (overrides: normalized_fact, verdict, rationale). A fact without evidence, an
    open one without a rationale, and evidence beyond the collection are errors.
    """
    o = overrides.select("normalized_fact", F.col("verdict").alias("o_verdict"), F.col("rationale").alias("o_rationale"))
    rows = facts.join(curated, "normalized_fact", "left").join(o, "normalized_fact", "left")
    open_ = F.col("expected") == OPEN
    lore = F.array_distinct(F.when(open_, F.col("lore")).otherwise(F.get("sets", 0)))
    why = F.when(~open_, "minimum_evidence_set").when(F.col("o_verdict").isNotNull(), "manual_label_override").otherwise("manual_curation")
    told = ~open_ | F.coalesce(F.coalesce("o_rationale", "rationale").rlike(r"(?U)\S"), F.lit(False))
    stray = rows.select("case_id", "gold_id", F.explode(lore).alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("case_id", "gold_id").distinct().withColumn("__stray", F.lit(True))
    rows = rows.withColumn("__lore", lore).join(stray, ["case_id", "gold_id"], "left")
    name = F.concat_ws("-", F.lit("OR"), "case_id", "gold_id")
    problem = F.when(F.coalesce(F.size("__lore"), F.lit(0)) <= 0, "no evidence").when(~told, "no rationale").when(F.col("__stray"), "unknown evidence")
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(name, F.lit(": "), problem)).cast("array<string>")).otherwise(F.col("__lore"))
    return rows.select(name.alias("fixture_id"), "case_id", "gold_id", F.coalesce("o_verdict", "expected").alias("expected"), checked.alias("lore"), why.alias("source"))
