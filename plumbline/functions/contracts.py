"""What answers, findings, labels and records must satisfy, and what becomes of valid ones.

Each contract is a list of named rules over a reply (typed, see replies, or a variant) and what it was asked about; the first
broken one is its error. Rules are Catalyst expressions, so replies of all contracts are checked in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import judging
from plumbline.functions import shapes as S

# The words of the protocols.
SAID = ("一致", "矛盾", "不确定")
PRONOUNS = ("他", "她", "它", "他们", "她们", "它们", "我", "你", "我们", "这个人", "此人")
LABEL_PRONOUNS = (*PRONOUNS, "你们")
RECORD_FIELDS = ("kind", "entity", "entity_type", "category", "text", "target", "time", "valid_from", "valid_until")
RECORD_KINDS = ("entity", "attribute", "relation", "rule", "event", "timepoint")
PAIR_VERDICTS = ("contradiction", "no_conflict", "uncertain")
MOST_RECORDS = 20


@dataclass(frozen=True)
class Contract:
    """The fields of an answer. cites: how evidence is named (quotes, labels L1.. or ids); flags and assumptions (list, flag
    or none): what an assessment holds; reason: none (0), any length (-1) or the longest one."""

    verdicts: tuple[str, ...] = judging.VERDICTS
    cites: str = "labels"
    flags: tuple[str, ...] = ()
    assumptions: str | None = None
    reason: int = 0

    @property
    def fields(self) -> tuple[str, ...]:
        named = ("citations",) if self.cites == "quotes" else ("evidence_ids",)
        return ("verdict", *named, *(("reason",) if self.reason else ()), *(("assessment",) if self.flags else ()))


_SCOPE = ("same_subject", "evidence_applicable")
_JOINT = (*_SCOPE, "can_both_be_true")
CONTRACTS = {
    "scope": Contract(cites="quotes", flags=_SCOPE, assumptions="list", reason=-1),
    "joint": Contract(cites="quotes", flags=_JOINT, assumptions="list", reason=-1),
    "lean": Contract(),
    "structured": Contract(flags=_JOINT, assumptions="flag"),
    "short-reason": Contract(flags=_JOINT, assumptions="flag", reason=80),
    "assumptions-list": Contract(flags=_JOINT, assumptions="list"),
    "rationale-120": Contract(flags=_JOINT, assumptions="list", reason=120),
    "rationale-240": Contract(flags=_JOINT, assumptions="list", reason=240),
    "story": Contract(verdicts=SAID, cites="ids", reason=-1),
}


def _number(label: Column, letter: str = "L") -> Column:
    """The place that a label such as L3 names; null for anything else."""
    return F.when(label.rlike(f"^{letter}[1-9][0-9]{{0,8}}$"), F.substring(label, 2, 9).try_cast("int"))


def _known(label: Column, evidence: Column, letter: str = "L") -> Column:
    return S.yes(_number(label, letter) <= F.size(evidence))


def _exactly(keys: Column, need: tuple[str, ...]) -> Column:
    """Whether an object has all these keys and no others; null keys are those of no object."""
    return S.yes((F.size(keys) == len(need)) & (F.size(F.array_except(F.array(*[F.lit(k) for k in need]), keys)) == 0))


def _filled(texts: Column) -> Column:
    """Whether a list has only texts that hold more than white space."""
    return S.yes(F.forall(texts, lambda x: S.filled(x)))


def answer_rules(a: Column, evidence: Column, contract: Contract) -> S.Rules:
    """Rules of an answer (see replies.answer) over its evidence: array of struct(id, text)."""
    rules: S.Rules = [("fields", _exactly(a["keys"], contract.fields)), ("verdict", S.yes(a["verdict"].isin(*contract.verdicts)))]
    sure = contract.verdicts[-1] if contract.verdicts == SAID else "uncertain"
    if contract.reason:
        limit = F.length(a["reason"]) <= contract.reason if contract.reason > 0 else F.lit(True)
        rules.append(("reason", S.filled(a["reason"]) & limit))
    if contract.flags:
        held = "assumptions_required" if contract.assumptions == "flag" else "assumptions"
        rules.append(("assessment", _exactly(a["held"], (*contract.flags, "relation", held))))
        rules += [(flag, S.yes(a[flag].isin("true", "false", "null"))) for flag in contract.flags]
        rules.append(("relation", S.yes(a["relation"].isin(*judging.RELATIONS))))
        rules.append((held, S.yes(a[held].isin("true", "false")) if contract.assumptions == "flag" else _filled(a[held])))
    decided = a["verdict"] != sure
    if contract.cites == "quotes":
        cited = a["citations"]
        labels = F.transform(cited, lambda c: c.label)
        told = lambda c: F.try_element_at(evidence, F.coalesce(_number(c.label), F.lit(1))).text
        rules += [
            ("citations", S.yes(F.size(cited) <= F.size(evidence)) & cited.isNotNull()),
            ("missing citation", ~S.yes(decided) | (F.size(cited) > 0)),
            ("citation fields", F.forall(cited, lambda c: _exactly(c["keys"], ("evidence_id", "quote")))),
            ("citation label", F.forall(labels, lambda x: _known(x, evidence)) & (F.size(F.array_distinct(labels)) == F.size(labels))),
            ("citation quote", F.forall(cited, lambda c: S.yes(S.filled(c.quote) & F.contains(told(c), c.quote)))),
        ]
        return rules
    ids = a["ids"]
    known = (lambda x: _known(x, evidence)) if contract.cites == "labels" else (lambda x: F.exists(evidence, lambda e: e.id == x))
    rules += [
        ("evidence_ids", S.yes(F.forall(ids, lambda x: x.isNotNull()) & (F.size(F.array_distinct(ids)) == F.size(ids)))),
        ("evidence label", F.forall(ids, lambda x: S.yes(known(x)))),
        ("missing citation", ~S.yes(decided) | (F.size(ids) > 0)),
    ]
    return rules


def assessment(a: Column) -> Column:
    """The assessment of an answer with flags as booleans; null if it has none."""
    flag = lambda name: F.when(a[name].isin("true", "false"), a[name] == "true").alias(name)
    required = F.when(a["assumptions_required"] == "true", F.array(F.lit("required")))
    held = F.coalesce(a["assumptions"], required, F.array().cast("array<string>"))
    return F.when(a["held"].isNotNull(), F.struct(*[flag(n) for n in _JOINT], a["relation"].alias("relation"), held.alias("assumptions")))


def final_answer(a: Column, evidence: Column, contract: Contract) -> Column:
    """struct(error, verdict, model_verdict, guard_reason, origin, chunk_ids) of an answer (see replies.answer).

    An invalid answer has its error and nothing else. An unproven verdict becomes uncertain where the contract has an assessment.
    """
    guarded = judging.guard(a["verdict"], assessment(a), "can_both_be_true" in contract.flags)
    labels = F.transform(a["citations"], lambda c: c.label) if contract.cites == "quotes" else a["ids"]
    chunks = labels if contract.cites == "ids" else F.transform(labels, lambda x: F.try_element_at(evidence, F.coalesce(_number(x), F.lit(1))).id)

    def made(parts: Column) -> Column:
        ok, g = parts.error.isNull(), parts.guarded
        return F.struct(
            parts.error.alias("error"),
            F.when(ok, g.verdict).alias("verdict"),
            F.when(ok, g.model_verdict).alias("model_verdict"),
            F.when(ok, g.guard_reason).alias("guard_reason"),
            F.when(ok, F.when(g.guard_reason.isNotNull(), "program_scope_guard").otherwise("model")).alias("origin"),
            F.when(ok, chunks).alias("chunk_ids"),
        )

    # As a lambda's variable, error and guard are computed once for all fields.
    return S.let(F.struct(S.first_broken(answer_rules(a, evidence, contract)).alias("error"), guarded.alias("guarded")), made)


def proof_error(a: Column, evidence: Column) -> Column:
    """Error of a joint answer (see replies.answer) that must prove its verdict by itself, without a guard after it."""
    held, verdict = assessment(a), a["verdict"]
    return S.first_broken(
        [
            *answer_rules(a, evidence, CONTRACTS["joint"]),
            ("unproven conflict", (verdict != "contradiction") | judging.proven(held, "direct_conflict", False)),
            ("unproven support", (verdict != "consistent") | judging.proven(held, "direct_support", True)),
        ]
    )


def findings_error(r: Column, source: Column, evidence: Column, labelled: bool = False) -> Column:
    """Error of a reply with findings (see replies.findings) about a source text; evidence is array of struct(id, text).

    Quotes must stand in the source and in the evidence that they name: by id, or by E1.. if ``labelled``.
    """
    found = r["findings"]
    every = lambda f: F.forall(found, lambda x: S.yes(f(x)))
    if labelled:
        text_of = lambda c: F.try_element_at(evidence, F.coalesce(_number(c.label, "E"), F.lit(1))).text
        known = lambda c: _known(c.label, evidence, "E")
    else:
        text_of = lambda c: F.get(F.filter(evidence, lambda e: e.id == c.label), 0).text
        known = lambda c: F.exists(evidence, lambda e: e.id == c.label)
    only_quote = lambda x: (x.verdict == SAID[2]) & (F.size(x.new_candidates) == 1) & (F.get(x.new_candidates, 0) == x.input_quote)
    fields = ("input_quote", "verdict", "evidence", "reason", "new_candidates")
    return S.first_broken(
        [
            ("fields", _exactly(r["keys"], ("findings",))),
            ("findings", S.yes(F.size(found) > 0)),
            ("finding fields", every(lambda x: _exactly(x["keys"], fields))),
            ("input_quote", every(lambda x: S.filled(x.input_quote) & F.contains(source, x.input_quote))),
            ("verdict", every(lambda x: x.verdict.isin(*SAID))),
            ("reason", every(lambda x: S.filled(x.reason))),
            ("new_candidates", every(lambda x: _filled(x.new_candidates) & ((F.size(x.new_candidates) == 0) | S.yes(only_quote(x))))),
            ("evidence", every(lambda x: x.evidence.isNotNull() & ((x.verdict == SAID[2]) | (F.size(x.evidence) > 0)))),
            ("citation fields", every(lambda x: F.forall(x.evidence, lambda c: _exactly(c["keys"], ("chunk_id", "quote"))))),
            ("citation label", every(lambda x: F.forall(x.evidence, lambda c: S.yes(known(c))))),
            ("citation quote", every(lambda x: F.forall(x.evidence, lambda c: S.yes(S.filled(c.quote) & F.contains(text_of(c), c.quote))))),
        ]
    )


def findings_verdict(r: Column) -> Column:
    """The verdict of all findings: 矛盾 before 不确定 before 一致."""
    said = F.transform(r["findings"], lambda x: x.verdict)
    return F.when(F.array_contains(said, SAID[1]), SAID[1]).when(F.array_contains(said, SAID[2]), SAID[2]).otherwise(SAID[0])


def classification(v: Column, source: Column, categories: Column, given: Column | None = None) -> Column:
    """struct(error, entity, category, event_time, status) of suggested labels; ``given`` (a struct of the three) takes precedence.

    Suggested labels must stand in the source, or among the categories; a pronoun names no entity.
    """
    names = ("entity", "category", "event_time")
    own = {n: (given.getField(n) if given is not None else F.lit(None).cast("string")) for n in names}
    raw = {n: F.coalesce(own[n], S.text(v, f"$.{n}")) for n in names}
    single = lambda n: own[n].isNotNull() | S.yes(S.kind(v, f"$.{n}") == "VOID") | S.is_text(v, f"$.{n}")
    line = lambda n: raw[n].isNull() | (S.filled(raw[n]) & ~raw[n].rlike("[\n\r]"))
    value = {n: F.trim(raw[n]) for n in names}
    error = S.first_broken(
        [
            ("fields", S.has_keys(v, names)),
            *[(n, single(n) & line(n)) for n in names],
            ("entity source", value["entity"].isNull() | own["entity"].isNotNull() | F.contains(source, value["entity"])),
            ("category choice", value["category"].isNull() | own["category"].isNotNull() | F.array_contains(categories, value["category"])),
            ("event_time source", value["event_time"].isNull() | own["event_time"].isNotNull() | F.contains(source, value["event_time"])),
        ]
    )
    entity = F.when(own["entity"].isNull() & value["entity"].isin(*LABEL_PRONOUNS), F.lit(None)).otherwise(value["entity"])
    ok = error.isNull()
    return F.struct(
        error.alias("error"),
        F.when(ok, entity).alias("entity"),
        F.when(ok, value["category"]).alias("category"),
        F.when(ok, value["event_time"]).alias("event_time"),
        F.when(ok, F.when(entity.isNull() | value["category"].isNull(), "needs_clarification").otherwise("ok")).alias("status"),
    )


def record_rules(r: Column, source: Column) -> S.Rules:
    """Rules of a record (struct of RECORD_FIELDS) that is to be kept from a source text."""
    named = ("entity", "target", "time", "valid_from", "valid_until")
    line = lambda n: r[n].isNull() | (S.filled(r[n]) & ((F.lit(n) == "text") | ~r[n].rlike("[\n\r]")))
    return [
        ("source", S.filled(source)),
        ("kind", r["kind"].isin(*RECORD_KINDS)),
        *[(n, line(n)) for n in RECORD_FIELDS[1:]],
        ("category missing", r["category"].isNotNull()),
        ("text source", F.contains(source, r["text"])),
        *[(f"{n} source", r[n].isNull() | F.contains(source, r[n])) for n in named],
        ("pronoun", ~S.yes(r["entity"].isin(*PRONOUNS) | r["target"].isin(*PRONOUNS))),
        ("entity missing", ~r["kind"].isin("entity", "attribute", "relation", "timepoint") | r["entity"].isNotNull()),
        ("entity_type missing", (r["kind"] != "entity") | r["entity_type"].isNotNull()),
        ("target missing", (r["kind"] != "relation") | r["target"].isNotNull()),
        ("time missing", (r["kind"] != "timepoint") | r["time"].isNotNull()),
    ]


def record_of(v: Column) -> Column:
    """A record's fields from a variant, absent ones null."""
    return F.struct(*[S.text(v, f"$.{n}").alias(n) for n in RECORD_FIELDS])


def plan_error(v: Column, source: Column) -> Column:
    """Error of a plan of 1 to 20 records over a source text: the first rule that any record breaks, or a repeated record."""
    items = S.rows(v, "$.records")
    strings = lambda x: S.yes(F.forall(F.array(*[S.kind(x, f"$.{n}") for n in RECORD_FIELDS]), lambda k: k.isNull() | k.isin("STRING", "VOID")))
    fields = lambda x: S.has_keys(x, ("kind", "category", "text"), RECORD_FIELDS) & strings(x)
    broken = lambda kept: F.get(F.filter(F.transform(kept, lambda r: S.first_broken(record_rules(r, source))), lambda e: e.isNotNull()), 0)
    shape = S.first_broken(
        [
            ("fields", S.has_keys(v, ("records",))),
            ("records", S.is_list(v, "$.records") & F.size(items).between(1, MOST_RECORDS)),
            ("record fields", F.forall(items, fields)),
        ]
    )
    return S.let(F.transform(items, record_of), lambda kept: F.coalesce(shape, broken(kept), F.when(F.size(F.array_distinct(kept)) < F.size(kept), "repeated record")))


def world_verdict_error(v: Column, evidence: Column) -> Column:
    """Error of a verdict about one record, with evidence by labels E1.."""
    ids = S.texts(v, "$.evidence")
    return S.first_broken(
        [
            ("fields", S.has_keys(v, ("verdict", "evidence", "reason")) & S.is_list(v, "$.evidence")),
            ("evidence label", F.forall(ids, lambda x: S.yes(_known(x, evidence, "E"))) & (F.size(F.array_distinct(ids)) == F.size(ids))),
            ("verdict", S.one_of(v, "$.verdict", SAID)),
            ("reason", S.is_text(v, "$.reason")),
            ("missing citation", (S.text(v, "$.verdict") == SAID[2]) | (F.size(ids) > 0)),
        ]
    )


def pair_check(v: Column, pair_id: Column, events: Column) -> Column:
    """struct(error, verdict, model_verdict) of a check of two events of one story: array of struct(id, texts).

    A contradiction must quote both events and hold for one subject and scope without assumptions; else it becomes uncertain.
    """
    cited = S.rows(v, "$.citations")
    conflict = S.yes(S.text(v, "$.verdict") == PAIR_VERDICTS[0])
    of = lambda c: F.get(F.filter(events, lambda e: e.id == S.text(c, "$.event_id")), 0)
    quoted = lambda c: S.is_text(c, "$.quote") & F.exists(of(c).texts, lambda t: F.contains(t, S.text(c, "$.quote")))
    both = F.size(F.array_distinct(F.transform(cited, lambda c: S.text(c, "$.event_id")))) == F.size(events)
    free = S.yes(S.kind(v, "$.assumptions").isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(S.texts(v, "$.assumptions"), lambda x: x.isNotNull()))
    error = S.first_broken(
        [
            ("fields", S.has_keys(v, ("pair_id", "verdict", "same_subject", "same_scope", "assumptions", "reason", "citations"))),
            ("pair_id", S.text(v, "$.pair_id") == pair_id),
            ("verdict", S.one_of(v, "$.verdict", PAIR_VERDICTS)),
            ("scope", S.is_flag(v, "$.same_subject", True) & S.is_flag(v, "$.same_scope", True)),
            ("reason", S.is_text(v, "$.reason")),
            ("assumptions", free),
            ("citations", S.is_list(v, "$.citations")),
            ("citation fields", ~conflict | F.forall(cited, lambda c: S.has_keys(c, ("event_id", "quote")))),
            ("citation label", ~conflict | F.forall(cited, lambda c: S.yes(of(c).id.isNotNull()))),
            ("citation quote", ~conflict | F.forall(cited, lambda c: S.yes(quoted(c)))),
            ("both events", ~conflict | both),
        ]
    )
    truth = lambda name: S.yes(F.try_variant_get(v, f"$.{name}", "boolean"))
    sure = truth("same_subject") & truth("same_scope") & (F.size(S.texts(v, "$.assumptions")) == 0)
    down = conflict & ~S.yes(sure)
    ok = error.isNull()
    return F.struct(error.alias("error"), F.when(ok, F.when(down, "uncertain").otherwise(S.text(v, "$.verdict"))).alias("verdict"), F.when(ok & down, "contradiction").alias("model_verdict"))


STAGES, SYSTEMS, STATES = ("extraction", "retrieval", "judge", "report", "total"), ("baseline", "candidate"), ("ok", "partial", "error")


def run_row_error(v: Column) -> Column:
    """Error of a run's row: case, system, state, result, and the seconds of each stage."""
    seconds = lambda s: F.try_variant_get(v, f"$.stage_metrics.{s}.seconds", "double")
    number = lambda s: S.yes(S.kind(v, f"$.stage_metrics.{s}.seconds").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")) & S.yes(seconds(s) >= 0)
    return S.first_broken(
        [
            ("object", S.yes(S.kind(v).startswith("OBJECT<"))),
            ("case_id", S.yes(F.length(S.text(v, "$.case_id")) > 0)),
            ("system", S.one_of(v, "$.system", SYSTEMS)),
            ("status", S.one_of(v, "$.status", STATES)),
            ("result", S.yes(S.kind(v, "$.result").startswith("OBJECT<"))),
            ("stages", S.has_keys(v, STAGES, path="$.stage_metrics")),
            *[(f"{s} seconds", number(s)) for s in STAGES],
        ]
    )
