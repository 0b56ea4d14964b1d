"""Replies made from conversations, and SQL that holds them against the contracts.

Each turn stands for a reply about itself and the turn before. What it says, quotes and gets wrong follows from the digits of a hash of the
turn; the expressions that write it are SQL that both engines run. What is wrong with it is computed by the library here and by JSON
functions in the SQL there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import contracts, judging, replies, wire
from plumbline.plans.base import registry, table

QUERIES, ORACLES, query = registry()

_CLEAN = "translate(coalesce({c}, ''), chr(34) || chr(92) || chr(10) || chr(13) || chr(9), '     ')"
#: A turn's own text, the one before, and what they say in short; h decides the rest.
BASE = {
    "conv_id": "conv_id",
    "turn": "turn",
    "t1": _CLEAN.format(c="text"),
    "t2": _CLEAN.format(c="coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 'none before')"),
    "h": "md5(CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) || coalesce(text, ''))",
}
QUOTES = {"q1": "substr(t1, 3, 9)", "q2": "substr(t2, 2, 7)"}
DIGITS = {f"n{i}": f"position(substr(h, {i + 1}, 1) IN '0123456789abcdef') - 1" for i in range(16)}


def by(digit: int, *cases: tuple[int, str]) -> str:
    """SQL: the text of the first case whose bound is above the digit."""
    return "CASE " + " ".join(f"WHEN n{digit} < {below} THEN {sql}" for below, sql in cases[:-1]) + f" ELSE {cases[-1][1]} END"


def obj(*fields: tuple[str, str]) -> str:
    """SQL of a JSON object: a field is its name and SQL of its JSON; null leaves it out."""
    each = ", ".join(f"'\"{k}\": ' || {sql}" for k, sql in fields)
    return f"'{{' || concat_ws(', ', {each}) || '}}'"


def text(sql: str) -> str:
    return f"chr(34) || {sql} || chr(34)"


def said(value: str) -> str:
    """SQL of a JSON text that is the same in every reply."""
    return f"'\"{value}\"'"


def spoilt(raw: str) -> str:
    """A reply that is no JSON, or holds one key too many, in two of sixteen turns."""
    return by(0, (1, f"'so: ' || {raw}"), (2, f"replace({raw}, '{{' || chr(34) || 'verdict', '{{' || chr(34) || 'extra' || chr(34) || ': 1, ' || chr(34) || 'verdict')"), (16, raw))


def duck(sql: str) -> str:
    return sql.replace(" AS STRING)", " AS VARCHAR)")


def ctes(raw: str) -> str:
    """The CTEs of a query in DuckDB: r has the turn, t1, t2, raw and j, its JSON."""
    named = lambda of: ", ".join(f"{duck(v)} AS {k}" for k, v in of.items())
    return f"b AS (SELECT {named(BASE)} FROM conversations), q AS (SELECT *, {named(QUOTES)}, {named(DIGITS)} FROM b), w AS (SELECT *, {duck(raw)} AS raw FROM q), r AS (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM w)"


def derived(spark: SparkSession, sf_dir: str, raw: str) -> DataFrame:
    """conv_id, turn, t1, t2, raw of every turn."""
    rows = table(spark, sf_dir, "conversations").select(*[F.expr(v).alias(k) for k, v in BASE.items()])
    rows = rows.select("*", *[F.expr(v).alias(k) for k, v in {**QUOTES, **DIGITS}.items()])
    return rows.select("conv_id", "turn", "t1", "t2", F.expr(raw).alias("raw"))


def evidence(*ids: str) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.col(t).alias("text")) for i, t in zip(ids, ("t1", "t2"), strict=True)])


def first_broken(rules: list[tuple[str, str]]) -> str:
    """SQL: the name of the first rule that does not hold."""
    return "CASE " + " ".join(f"WHEN NOT coalesce({sql}, FALSE) THEN '{name}'" for name, sql in rules) + " END"


def keys(need: tuple[str, ...], path: str = "$", of: str = "j") -> str:
    return f"list_sort(json_keys({of}, '{path}')) = {sorted(need)}"


def is_text(path: str, of: str = "j") -> str:
    return f"(json_type({of}, '{path}') = 'VARCHAR' AND regexp_matches({of}->>'{path}', '\\S'))"


def one_of(path: str, values: tuple[str, ...], of: str = "j") -> str:
    return f"(json_type({of}, '{path}') = 'VARCHAR' AND {of}->>'{path}' IN {values})"


def is_texts(path: str, filled: bool = True) -> str:
    good = "json_type(x) = 'VARCHAR' AND regexp_matches(x->>'$', '\\S')" if filled else "json_type(x) = 'VARCHAR'"
    return f"(json_type(j, '{path}') = 'ARRAY' AND len(list_filter(json_extract(j, '{path}[*]'), lambda x: NOT ({good}))) = 0)"


# ---- answers

VERDICT = by(1, (6, said("contradiction")), (12, said("consistent")), (14, said("uncertain")), (15, said("maybe")), (16, "'3'"))
VERDICT_SAID = by(1, (6, said("矛盾")), (12, said("一致")), (14, said("不确定")), (15, said("contradiction")), (16, "NULL"))
REASON = by(2, (1, said("  ")), (2, "'7'"), (4, text("repeat('long ', 50)")), (7, text("repeat('why ', 25)")), (16, said("because")))
FLAG = {name: by(i, *cases, (13, "'true'"), (14, "'null'"), (15, said("yes")), (16, "NULL")) for name, i, cases in (("same_subject", 3, ((1, "'false'"),)), ("evidence_applicable", 4, ((1, "'false'"),)))}
FLAG["can_both_be_true"] = by(5, (7, "'false'"), (13, "'true'"), (15, "'null'"), (16, said("no")))
RELATION = by(6, (7, said("direct_conflict")), (13, said("direct_support")), (15, said("insufficient")), (16, said("weak")))
ASSUMED = by(7, (10, "'[]'"), (12, "'[' || chr(34) || 'if so' || chr(34) || ']'"), (13, "'[' || chr(34) || ' ' || chr(34) || ']'"), (14, said("no")), (15, "'[1]'"), (16, "NULL"))
REQUIRED = by(7, (11, "'false'"), (13, "'true'"), (14, "'null'"), (15, said("no")), (16, "NULL"))
_cite = lambda label, quote: obj(("evidence_id", said(label)), ("quote", text(quote)))
CITED = by(
    8, (1, "'[]'"), (8, f"'[' || {_cite('L1', 'q1')} || ']'"), (11, f"'[' || {_cite('L1', 'q1')} || ', ' || {_cite('L2', 'q2')} || ']'"), (12, f"'[' || {_cite('L2', 'q1')} || ']'"),
    (13, f"'[' || {_cite('L1', 'q1')} || ', ' || {_cite('L1', 'q1')} || ']'"), (14, "'[{' || chr(34) || 'evidence_id' || chr(34) || ': 1}]'"), (15, "'{}'"), (16, f"'[' || {_cite('L3', 'q1')} || ']'"),
)
_list = lambda *items: "'[" + ", ".join(f'"{x}"' for x in items) + "]'"
NAMED = lambda a, b, other: by(8, (1, "'[]'"), (8, _list(a)), (11, _list(a, b)), (12, _list(b)), (13, _list(a, a)), (14, "'[1]'"), (15, said(a)), (16, _list(other)))


def answer_raw(c: contracts.Contract) -> str:
    """SQL of a reply under a contract."""
    fields = [("verdict", VERDICT_SAID if c.verdicts == contracts.SAID else VERDICT)]
    fields.append(("citations", CITED) if c.cites == "quotes" else ("evidence_ids", NAMED("c1", "c2", "c7") if c.cites == "ids" else NAMED("L1", "L2", "L9")))
    if c.reason:
        fields.append(("reason", REASON))
    if c.flags:
        held = ("assumptions_required", REQUIRED) if c.assumptions == "flag" else ("assumptions", ASSUMED)
        fields.append(("assessment", by(9, (15, obj(*[(f, FLAG[f]) for f in c.flags], ("relation", RELATION), held)), (16, "'[]'"))))
    return spoilt(obj(*fields))


def answer_rules(c: contracts.Contract) -> list[tuple[str, str]]:
    """The rules of a contract as SQL over j, its two pieces of evidence t1 and t2."""
    rules = [("fields", keys(c.fields)), ("verdict", one_of("$.verdict", c.verdicts))]
    if c.reason:
        rules.append(("reason", is_text("$.reason") + (f" AND length(j->>'$.reason') <= {c.reason}" if c.reason > 0 else "")))
    if c.flags:
        held = "assumptions_required" if c.assumptions == "flag" else "assumptions"
        rules.append(("assessment", keys((*c.flags, "relation", held), "$.assessment")))
        rules += [(f, f"json_type(j, '$.assessment.{f}') IN ('BOOLEAN', 'NULL')") for f in c.flags]
        rules.append(("relation", one_of("$.assessment.relation", judging.RELATIONS)))
        rules.append((held, f"json_type(j, '$.assessment.{held}') = 'BOOLEAN'" if c.assumptions == "flag" else is_texts("$.assessment.assumptions")))
    open_ = f"j->>'$.verdict' = '{c.verdicts[-1]}'"
    if c.cites == "quotes":
        each = "json_extract(j, '$.citations[*]')"
        bad = lambda good: f"len(list_filter({each}, lambda x: NOT coalesce({good}, FALSE))) = 0"
        labels = f"list_transform({each}, lambda x: x->>'$.evidence_id')"
        return [
            *rules,
            ("citations", f"json_type(j, '$.citations') = 'ARRAY' AND len({each}) <= 2"),
            ("missing citation", f"{open_} OR len({each}) > 0"),
            ("citation fields", bad("list_sort(json_keys(x)) = ['evidence_id', 'quote']")),
            ("citation label", bad("json_type(x, '$.evidence_id') = 'VARCHAR' AND x->>'$.evidence_id' IN ('L1', 'L2')") + f" AND len(list_distinct({labels})) = len({each})"),
            ("citation quote", bad("json_type(x, '$.quote') = 'VARCHAR' AND regexp_matches(x->>'$.quote', '\\S') AND contains(CASE x->>'$.evidence_id' WHEN 'L1' THEN t1 ELSE t2 END, x->>'$.quote')")),
        ]
    ids = "CAST(json_extract_string(j, '$.evidence_ids[*]') AS VARCHAR[])"
    known = ("c1", "c2") if c.cites == "ids" else ("L1", "L2")
    return [
        *rules,
        ("evidence_ids", is_texts("$.evidence_ids", filled=False) + f" AND len(list_distinct({ids})) = len({ids})"),
        ("evidence label", f"len(list_filter({ids}, lambda x: x NOT IN {known})) = 0"),
        ("missing citation", f"{open_} OR len({ids}) > 0"),
    ]


def proven(c: contracts.Contract, relation: str, coexist: str) -> str:
    free = "(j->>'$.assessment.assumptions_required') = 'false'" if c.assumptions == "flag" else "len(json_extract(j, '$.assessment.assumptions[*]')) = 0"
    joint = f" AND (j->>'$.assessment.can_both_be_true') = '{coexist}'" if "can_both_be_true" in c.flags else ""
    return f"coalesce((j->>'$.assessment.same_subject') = 'true' AND (j->>'$.assessment.evidence_applicable') = 'true' AND j->>'$.assessment.relation' = '{relation}' AND {free}{joint}, FALSE)"


def answer_sql(c: contracts.Contract) -> str:
    guard = "NULL"
    if c.flags:
        guard = f"CASE WHEN j->>'$.verdict' = 'contradiction' AND NOT {proven(c, 'direct_conflict', 'false')} THEN 'coexistence_not_ruled_out' WHEN j->>'$.verdict' = 'consistent' AND NOT {proven(c, 'direct_support', 'true')} THEN 'direct_support_not_proven' END"
    return f"""
WITH {ctes(answer_raw(c))}, e AS (SELECT *, {first_broken(answer_rules(c))} AS error, CAST({guard} AS VARCHAR) AS guard FROM r)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE WHEN guard IS NULL THEN j->>'$.verdict' ELSE 'uncertain' END END AS verdict, CASE WHEN error IS NULL THEN guard END AS guard_reason FROM e
"""


def _answers(name: str) -> Callable[[SparkSession, str], DataFrame]:
    c = contracts.CONTRACTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = ("c1", "c2")
        rows = derived(spark, sf_dir, answer_raw(c)).withColumn("a", replies.answer(F.col("raw")))
        return rows.select("conv_id", "turn", contracts.final_answer(F.col("a"), evidence(*ids), c).alias("x")).select("conv_id", "turn", "x.error", "x.verdict", "x.guard_reason")

    run.__doc__ = f"Answers under the contract {name}: what they break, and what the guard makes of valid ones."
    return run


for _name, _contract in contracts.CONTRACTS.items():
    query(answer_sql(_contract), "answers_" + _name.replace("-", "_"))(_answers(_name))

_JOINT = contracts.CONTRACTS["joint"]


@query(f"""
WITH {ctes(answer_raw(_JOINT))}
SELECT conv_id, turn, {first_broken([*answer_rules(_JOINT), ("unproven conflict", f"j->>'$.verdict' <> 'contradiction' OR {proven(_JOINT, 'direct_conflict', 'false')}"), ("unproven support", f"j->>'$.verdict' <> 'consistent' OR {proven(_JOINT, 'direct_support', 'true')}")])} AS error FROM r
""")
def answers_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that must prove their verdict by themselves."""
    rows = derived(spark, sf_dir, answer_raw(_JOINT)).withColumn("a", replies.answer(F.col("raw")))
    return rows.select("conv_id", "turn", contracts.proof_error(F.col("a"), evidence("c1", "c2")).alias("error"))


# ---- findings


def finding_raw(first: str, second: str, other: str) -> str:
    """SQL of a reply with one or two findings about the turn before, t2, that quote t1."""
    cite = lambda label, quote: obj(("chunk_id", said(label)), ("quote", text(quote)))
    cited = by(4, (10, f"'[' || {cite(first, 'q1')} || ']'"), (12, "'[]'"), (13, f"'[' || {cite(second, 'q2')} || ', ' || {cite(first, 'q1')} || ']'"), (14, f"'[' || {cite(other, 'q1')} || ']'"), (15, f"'[' || {cite(second, 'q1')} || ']'"), (16, "'[{}]'"))
    verdict = lambda i: by(i, (6, said("一致")), (11, said("矛盾")), (15, said("不确定")), (16, said("maybe")))
    offered = by(6, (11, "'[]'"), (14, "'[' || chr(34) || q2 || chr(34) || ']'"), (15, "'[' || chr(34) || 'other' || chr(34) || ']'"), (16, "'[2]'"))
    quote = by(7, (14, text("q2")), (15, text("q1")), (16, "'null'"))
    reason = by(8, (15, said("because")), (16, said(" ")))
    one = lambda i: obj(("input_quote", quote), ("verdict", verdict(i)), ("evidence", cited), ("reason", by(9, (15, reason), (16, "NULL"))), ("new_candidates", offered))
    rows = by(10, (8, f"'[' || {one(5)} || ']'"), (14, f"'[' || {one(5)} || ', ' || {one(11)} || ']'"), (15, "'[]'"), (16, "'{}'"))
    return by(0, (1, "'none'"), (2, obj(("findings", rows), ("more", "'1'"))), (16, obj(("findings", rows))))


def finding_sql(first: str, second: str, other: str) -> str:
    each = "json_extract(j, '$.findings[*]')"
    every = lambda good: f"len(list_filter({each}, lambda x: NOT coalesce({good}, FALSE))) = 0"
    cited = lambda good: every(f"len(list_filter(json_extract(x, '$.evidence[*]'), lambda y: NOT coalesce({good}, FALSE))) = 0")
    filled = lambda path, of: f"json_type({of}, '{path}') = 'VARCHAR' AND regexp_matches({of}->>'{path}', '\\S')"
    offered = "json_extract(x, '$.new_candidates[*]')"
    rules = [
        ("fields", keys(("findings",))),
        ("findings", f"json_type(j, '$.findings') = 'ARRAY' AND len({each}) > 0"),
        ("finding fields", every("list_sort(json_keys(x)) = ['evidence', 'input_quote', 'new_candidates', 'reason', 'verdict']")),
        ("input_quote", every(filled("$.input_quote", "x") + " AND contains(t2, x->>'$.input_quote')")),
        ("verdict", every(f"json_type(x, '$.verdict') = 'VARCHAR' AND x->>'$.verdict' IN {contracts.SAID}")),
        ("reason", every(filled("$.reason", "x"))),
        ("new_candidates", every(f"len(list_filter({offered}, lambda y: NOT (json_type(y) = 'VARCHAR' AND regexp_matches(y->>'$', '\\S')))) = 0 AND (len({offered}) = 0 OR (x->>'$.verdict' = '不确定' AND len({offered}) = 1 AND x->>'$.new_candidates[0]' = x->>'$.input_quote'))")),
        ("evidence", every("json_type(x, '$.evidence') = 'ARRAY' AND (x->>'$.verdict' = '不确定' OR len(json_extract(x, '$.evidence[*]')) > 0)")),
        ("citation fields", cited("list_sort(json_keys(y)) = ['chunk_id', 'quote']")),
        ("citation label", cited(f"y->>'$.chunk_id' IN ('{first}', '{second}')")),
        ("citation quote", cited(filled("$.quote", "y") + f" AND contains(CASE y->>'$.chunk_id' WHEN '{first}' THEN t1 ELSE t2 END, y->>'$.quote')")),
    ]
    told = "json_extract_string(j, '$.findings[*].verdict')"
    return f"""
WITH {ctes(finding_raw(first, second, other))}, e AS (SELECT *, {first_broken(rules)} AS error FROM r)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE WHEN list_contains({told}, '矛盾') THEN '矛盾' WHEN list_contains({told}, '不确定') THEN '不确定' ELSE '一致' END END AS verdict FROM e
"""


def _found(spark: SparkSession, sf_dir: str, ids: tuple[str, str, str], labelled: bool) -> DataFrame:
    rows = derived(spark, sf_dir, finding_raw(*ids)).withColumn("r", replies.findings(F.col("raw")))
    rows = rows.withColumn("error", contracts.findings_error(F.col("r"), F.col("t2"), evidence("c1", "c2"), labelled))
    return rows.select("conv_id", "turn", "error", F.when(F.col("error").isNull(), contracts.findings_verdict(F.col("r"))).alias("verdict"))


@query(finding_sql("c1", "c2", "c9"))
def finding_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about the turn before, with evidence by id."""
    return _found(spark, sf_dir, ("c1", "c2", "c9"), False)


@query(finding_sql("E1", "E2", "E9"))
def finding_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about the turn before, with evidence by labels."""
    return _found(spark, sf_dir, ("E1", "E2", "E9"), True)


# ---- labels, verdicts about records, pairs

CATEGORIES = ("people", "places")
LABEL_RAW = spoilt(
    obj(
        ("entity", by(1, (7, text("q1")), (9, "'null'"), (11, said("她")), (13, said("Nobody")), (14, "'4'"), (15, said(" ")), (16, "NULL"))),
        ("category", by(2, (10, said("people")), (13, "'null'"), (14, said("odd")), (15, "'3'"), (16, said(" ")))),
        ("event_time", by(3, (8, "'null'"), (13, text("substr(t1, 1, 4)")), (15, said("noon")), (16, "NULL"))),
    )
)
_VALUE = {n: f"trim(j->>'$.{n}')" for n in ("entity", "category", "event_time")}


@query(f"""
WITH {ctes(LABEL_RAW)}, e AS (SELECT *, {_VALUE["entity"]} AS v1, {_VALUE["category"]} AS v2, {_VALUE["event_time"]} AS v3, {first_broken([
    ("fields", keys(("entity", "category", "event_time"))),
    *[(n, f"json_type(j, '$.{n}') = 'NULL' OR {is_text('$.' + n)}") for n in ("entity", "category", "event_time")],
    ("entity source", f"{_VALUE['entity']} IS NULL OR contains(t1 || ' 她', {_VALUE['entity']})"),
    ("category choice", f"{_VALUE['category']} IS NULL OR {_VALUE['category']} IN {CATEGORIES}"),
    ("event_time source", f"{_VALUE['event_time']} IS NULL OR contains(t1 || ' 她', {_VALUE['event_time']})"),
])} AS error FROM r)
SELECT conv_id, turn, error, CASE WHEN error IS NULL AND v1 <> '她' THEN v1 END AS entity, CASE WHEN error IS NULL THEN v2 END AS category, CASE WHEN error IS NULL THEN v3 END AS event_time,
  CASE WHEN error IS NULL THEN CASE WHEN v1 IS NULL OR v1 = '她' OR v2 IS NULL THEN 'needs_clarification' ELSE 'ok' END END AS status FROM e
""")
def label_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested labels of a turn."""
    rows = derived(spark, sf_dir, LABEL_RAW).withColumn("v", F.explode(F.array(F.try_parse_json("raw"))))
    made = contracts.classification(F.col("v"), F.concat("t1", F.lit(" 她")), F.array(*map(F.lit, CATEGORIES)))
    return rows.select("conv_id", "turn", F.explode(F.array(made)).alias("c")).select("conv_id", "turn", "c.*")


WORLD_RAW = spoilt(obj(("verdict", by(1, (6, said("一致")), (11, said("矛盾")), (14, said("不确定")), (15, said("x")), (16, "'1'"))), ("evidence", NAMED("E1", "E2", "E9")), ("reason", REASON)))
_WORLD_IDS = "CAST(json_extract_string(j, '$.evidence[*]') AS VARCHAR[])"


@query(f"""
WITH {ctes(WORLD_RAW)} SELECT conv_id, turn, {first_broken([
    ("fields", keys(("verdict", "evidence", "reason")) + " AND json_type(j, '$.evidence') = 'ARRAY'"),
    ("evidence label", f"len(list_filter({_WORLD_IDS}, lambda x: x NOT IN ('E1', 'E2'))) = 0 AND len(list_distinct({_WORLD_IDS})) = len({_WORLD_IDS})"),
    ("verdict", one_of("$.verdict", contracts.SAID)),
    ("reason", is_text("$.reason")),
    ("missing citation", f"j->>'$.verdict' = '不确定' OR len({_WORLD_IDS}) > 0"),
])} AS error FROM r
""")
def world_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts about single records, with two pieces of evidence."""
    rows = derived(spark, sf_dir, WORLD_RAW).withColumn("v", F.explode(F.array(F.try_parse_json("raw"))))
    return rows.select("conv_id", "turn", contracts.world_verdict_error(F.col("v"), evidence("c1", "c2")).alias("error"))


_quote = lambda event, sql: obj(("event_id", said(event)), ("quote", text(sql)))
_FLAGGED = lambda i: by(i, (13, "'true'"), (14, "'false'"), (15, "'null'"), (16, "'1'"))
PAIR_RAW = spoilt(
    obj(
        ("verdict", by(1, (10, said("contradiction")), (12, said("no_conflict")), (15, said("uncertain")), (16, said("clash")))),
        ("pair_id", by(2, (15, said("P1")), (16, said("P2")))),
        ("same_subject", _FLAGGED(3)),
        ("same_scope", _FLAGGED(4)),
        ("assumptions", ASSUMED),
        ("reason", by(5, (14, said("because")), (15, said(" ")), (16, "NULL"))),
        ("citations", by(8, (9, f"'[' || {_quote('E1', 'q1')} || ', ' || {_quote('E2', 'q2')} || ']'"), (11, f"'[' || {_quote('E1', 'q1')} || ']'"), (12, f"'[' || {_quote('E1', 'q1')} || ', ' || {_quote('E2', 'q1')} || ']'"), (13, f"'[' || {_quote('E7', 'q1')} || ']'"), (14, "'[]'"), (15, "'[{}]'"), (16, said("no")))),
    )
)
_PAIR_CITED = "json_extract(j, '$.citations[*]')"
_NO_CONFLICT = "coalesce(j->>'$.verdict', '') <> 'contradiction' OR "
_EACH_CITED = lambda good: f"{_NO_CONFLICT}len(list_filter({_PAIR_CITED}, lambda x: NOT coalesce({good}, FALSE))) = 0"


@query(f"""
WITH {ctes(PAIR_RAW)}, e AS (SELECT *, {first_broken([
    ("fields", keys(("pair_id", "verdict", "same_subject", "same_scope", "assumptions", "reason", "citations"))),
    ("pair_id", "j->>'$.pair_id' = 'P1'"),
    ("verdict", one_of("$.verdict", contracts.PAIR_VERDICTS)),
    ("scope", "json_type(j, '$.same_subject') IN ('BOOLEAN', 'NULL') AND json_type(j, '$.same_scope') IN ('BOOLEAN', 'NULL')"),
    ("reason", is_text("$.reason")),
    ("assumptions", is_texts("$.assumptions", filled=False)),
    ("citations", "json_type(j, '$.citations') = 'ARRAY'"),
    ("citation fields", _EACH_CITED("list_sort(json_keys(x)) = ['event_id', 'quote']")),
    ("citation label", _EACH_CITED("x->>'$.event_id' IN ('E1', 'E2')")),
    ("citation quote", _EACH_CITED("regexp_matches(x->>'$.quote', '\\S') AND contains(CASE x->>'$.event_id' WHEN 'E1' THEN t1 ELSE t2 END, x->>'$.quote')")),
    ("both events", _NO_CONFLICT + f"len(list_distinct(list_transform({_PAIR_CITED}, lambda x: x->>'$.event_id'))) = 2"),
])} AS error, j->>'$.verdict' = 'contradiction' AND NOT coalesce((j->>'$.same_subject') = 'true' AND (j->>'$.same_scope') = 'true' AND len(json_extract(j, '$.assumptions[*]')) = 0, FALSE) AS down FROM r)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE WHEN down THEN 'uncertain' ELSE j->>'$.verdict' END END AS verdict, CASE WHEN error IS NULL AND down THEN 'contradiction' END AS model_verdict FROM e
""")
def pair_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a turn and the one before for a contradiction."""
    rows = derived(spark, sf_dir, PAIR_RAW).withColumn("v", F.explode(F.array(F.try_parse_json("raw"))))
    events = F.array(*[F.struct(F.lit(i).alias("id"), F.array(t).alias("texts")) for i, t in (("E1", "t1"), ("E2", "t2"))])
    return rows.select("conv_id", "turn", F.explode(F.array(contracts.pair_check(F.col("v"), F.lit("P1"), events))).alias("p")).select("conv_id", "turn", "p.*")


# ---- decisions, rows of runs, replies that break off or go on

_CODES = tuple(wire.DECISIONS)
DECISION_RAW = spoilt(
    obj(
        ("event_id", text("h")),
        ("decision", by(1, (6, said("keep")), (9, said("ignore")), (11, said("review")), (14, said(_CODES[0])), (15, said("drop")), (16, "NULL"))),
        ("reason_code", by(2, (4, said(_CODES[0])), (8, said(_CODES[-1])), (12, said(_CODES[len(_CODES) // 2])), (14, said(_CODES[1])), (15, said("whim")), (16, "'7'"))),
    )
)
_DUE = "CASE j->>'$.reason_code' " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in wire.DECISIONS.items()) + " END"


@query(f"""
WITH {ctes(DECISION_RAW)}, e AS (SELECT *, {_DUE} AS due, {first_broken([
    ("fields", keys(("event_id", "decision", "reason_code"))),
    ("reason_code", f"{_DUE} IS NOT NULL"),
    ("decision", f"j->>'$.decision' IN ({_DUE}, j->>'$.reason_code')"),
])} AS error FROM r)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN due END AS decision, CASE WHEN error IS NULL AND j->>'$.decision' = j->>'$.reason_code' THEN 'decision_from_reason_code' END AS note FROM e
""")
def filter_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter decisions by their reason codes."""
    rows = derived(spark, sf_dir, DECISION_RAW).withColumn("v", F.explode(F.array(F.try_parse_json("raw"))))
    return rows.select("conv_id", "turn", F.explode(F.array(wire.decision(F.col("v")))).alias("c")).select("conv_id", "turn", "c.error", "c.decision", "c.note")


_SECONDS = lambda s, i: (s, f"'{{' || chr(34) || 'seconds' || chr(34) || ': ' || {by(i, (13, f'CAST(length(t1) AS STRING) || chr(46) || CAST(n{i} AS STRING)'), (14, said('1')), (15, chr(39) + '-1.5' + chr(39)), (16, chr(39) + 'true' + chr(39)))} || '}}'")
RUN_RAW = by(
    0,
    (1, "'[1]'"),
    (16, obj(
        ("case_id", by(1, (14, text("h")), (15, said("")), (16, "'5'"))),
        ("system", by(2, (8, said("baseline")), (15, said("candidate")), (16, said("other")))),
        ("status", by(3, (8, said("ok")), (12, said("partial")), (15, said("error")), (16, said("done")))),
        ("result", by(4, (15, "'{}'"), (16, "'[]'"))),
        ("stage_metrics", obj(*[_SECONDS(s, i) for i, s in enumerate(contracts.STAGES[:-1], 5)], ("total", by(9, (15, "'{' || chr(34) || 'seconds' || chr(34) || ': 3}'"), (16, "NULL"))))),
    )),
)


@query(f"""
WITH {ctes(RUN_RAW)} SELECT conv_id, turn, {first_broken([
    ("object", "json_type(j) = 'OBJECT'"),
    ("case_id", "json_type(j, '$.case_id') = 'VARCHAR' AND length(j->>'$.case_id') > 0"),
    ("system", one_of("$.system", contracts.SYSTEMS)),
    ("status", one_of("$.status", contracts.STATES)),
    ("result", "json_type(j, '$.result') = 'OBJECT'"),
    ("stages", keys(contracts.STAGES, "$.stage_metrics")),
    *[(f"{s} seconds", f"json_type(j, '$.stage_metrics.{s}.seconds') IN ('DOUBLE', 'UBIGINT', 'BIGINT') AND TRY_CAST(j->>'$.stage_metrics.{s}.seconds' AS DOUBLE) >= 0") for s in contracts.STAGES],
])} AS error FROM r
""")
def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of runs with their stages' seconds."""
    rows = derived(spark, sf_dir, RUN_RAW).withColumn("v", F.explode(F.array(F.try_parse_json("raw"))))
    return rows.select("conv_id", "turn", contracts.run_row_error(F.col("v")).alias("error"))


CUT_RAW = f"'{{' || chr(34) || 'verdict' || chr(34) || ':' || {by(1, (8, said('不确定')), (12, said('矛盾')), (16, said('uncertain')))} || ',' || chr(34) || 'reason' || chr(34) || ':' || {text('q1')} || {by(2, (9, chr(39) + ',' + chr(34) + 'evidence_ids' + chr(34) + '}' + chr(39)), (12, chr(39) + ',' + chr(34) + 'evidence_ids' + chr(34) + ':[]}' + chr(39)), (16, chr(39) + '}' + chr(39)))}"


@query(f"""
WITH {ctes(CUT_RAW)}, e AS (SELECT *, j IS NULL AND raw LIKE '%,"evidence_ids"}}' AND raw LIKE '{{"verdict":"不确定"%' AS cut FROM r)
SELECT conv_id, turn, CASE WHEN cut THEN left(raw, length(raw) - 1) || ':[]}}' ELSE raw END AS fixed, CASE WHEN cut THEN 'missing_empty_uncertain_evidence_array' END AS note FROM e
""")
def reply_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain answers that break off before their empty evidence, completed."""
    return derived(spark, sf_dir, CUT_RAW).select("conv_id", "turn", wire.cut_answer(F.col("raw")).alias("c")).select("conv_id", "turn", F.col("c.raw").alias("fixed"), "c.note")


_AFTER = by(2, (6, "''"), (8, "chr(34)"), (10, "' 说明：' || q1"), (11, "' 解释:'"), (12, "' 说明：{' || q1"), (14, "' ' || chr(10) || ' more ' || q2"), (15, "'  '"), (16, "' 说明 ' || q1"))
TRAILER_RAW = f"{by(1, (13, obj(('verdict', text('q1')))), (14, chr(39) + '[1]' + chr(39)), (15, chr(39) + 'so ' + chr(39)), (16, chr(39) + chr(39)))} || {_AFTER}"


@query(f"""
WITH {ctes(TRAILER_RAW)}, e AS (SELECT *, CASE WHEN n1 < 13 THEN trim(substr(raw, strpos(raw, '}}') + 1), ' ' || chr(10)) END AS rest FROM r)
SELECT conv_id, turn, CASE WHEN rest = '"' THEN 'single_trailing_quote_removed' WHEN regexp_matches(rest, '^(说明|解释)\\s*[：:]') AND NOT regexp_matches(rest, '[{{}}\\[\\]]') THEN 'trailing_explanation_removed' END AS note,
  CASE WHEN rest IS NULL THEN 'no object' WHEN NOT (rest = '' OR rest = '"' OR (regexp_matches(rest, '^(说明|解释)\\s*[：:]') AND NOT regexp_matches(rest, '[{{}}\\[\\]]'))) THEN 'trailing content' END AS error FROM e
""")
def reply_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may follow the object of a reply."""
    rows = derived(spark, sf_dir, TRAILER_RAW).withColumn("lead", wire.leading_object(F.col("raw")))
    return rows.select("conv_id", "turn", wire.tolerated(F.col("lead")).alias("t")).select("conv_id", "turn", "t.note", "t.error")


# ---- records, compact and lean events, misspelled fields, projections


def listed(*items: str) -> str:
    """SQL of a JSON list."""
    return "'[' || " + " || ', ' || ".join(items) + " || ']'"


def _record(category: str) -> str:
    kind = by(1, (5, said("attribute")), (7, said("rule")), (9, said("entity")), (11, said("relation")), (13, said("timepoint")), (15, said("event")), (16, said("wish")))
    return obj(
        ("kind", kind),
        ("entity", by(2, (10, text("q1")), (12, "'null'"), (13, said("Nobody")), (14, "'4'"), (15, said("我")), (16, "NULL"))),
        ("category", by(3, (14, said(category)), (15, said(" ")), (16, "NULL"))),
        ("text", by(4, (13, text("substr(t1, 1, 20)")), (14, said("Something else")), (15, "'null'"), (16, text("t1")))),
        ("target", by(5, (8, "NULL"), (14, text("substr(t1, 2, 5)")), (16, said("Nobody")))),
        ("time", by(6, (9, "NULL"), (14, text("substr(t1, 4, 4)")), (16, said("noon")))),
        ("entity_type", by(7, (8, "NULL"), (15, said("person")), (16, said(" ")))),
    )


PLAN_RAW = by(0, (1, "'no plan'"), (2, "'{}'"), (3, obj(("records", "'[]'"))), (4, obj(("records", "'{}'"))), (10, obj(("records", listed(_record("skill"))))), (13, obj(("records", listed(_record("skill"), _record("place"))))), (16, obj(("records", listed(_record("skill"), _record("skill"))))))
_RECORDS = "json_extract(j, '$.records[*]')"


def _record_error(x: str) -> str:
    of = lambda n: f"({x}->>'$.{n}')"
    line = lambda n: f"{of(n)} IS NULL OR (regexp_matches({of(n)}, '\\S') AND NOT regexp_matches({of(n)}, '[\\n\\r]'))"
    named = ("entity", "target", "time", "valid_from", "valid_until")
    return first_broken(
        [
            ("source", "regexp_matches(t1, '\\S')"),
            ("kind", f"{of('kind')} IN {contracts.RECORD_KINDS}"),
            *[(n, line(n)) for n in contracts.RECORD_FIELDS[1:]],
            ("category missing", f"{of('category')} IS NOT NULL"),
            ("text source", f"contains(t1, {of('text')})"),
            *[(f"{n} source", f"{of(n)} IS NULL OR contains(t1, {of(n)})") for n in named],
            ("pronoun", f"NOT coalesce({of('entity')} IN {contracts.PRONOUNS} OR {of('target')} IN {contracts.PRONOUNS}, FALSE)"),
            ("entity missing", f"{of('kind')} NOT IN ('entity', 'attribute', 'relation', 'timepoint') OR {of('entity')} IS NOT NULL"),
            ("entity_type missing", f"{of('kind')} <> 'entity' OR {of('entity_type')} IS NOT NULL"),
            ("target missing", f"{of('kind')} <> 'relation' OR {of('target')} IS NOT NULL"),
            ("time missing", f"{of('kind')} <> 'timepoint' OR {of('time')} IS NOT NULL"),
        ]
    )


_SHAPED = f"len(list_filter({_RECORDS}, lambda x: NOT coalesce(len(list_filter(['kind', 'category', 'text'], lambda k: NOT list_contains(json_keys(x), k))) = 0 AND len(list_filter(json_keys(x), lambda k: k NOT IN {contracts.RECORD_FIELDS} OR json_type(x, '$.' || k) NOT IN ('VARCHAR', 'NULL'))) = 0, FALSE))) = 0"


@query(f"""
WITH {ctes(PLAN_RAW)}, e AS (SELECT *, {first_broken([("fields", keys(("records",))), ("records", f"json_type(j, '$.records') = 'ARRAY' AND len({_RECORDS}) BETWEEN 1 AND 20"), ("record fields", _SHAPED)])} AS shape, list_filter(list_transform({_RECORDS}, lambda x: {_record_error('x')}), lambda e: e IS NOT NULL)[1] AS broken FROM r)
SELECT conv_id, turn, coalesce(shape, broken, CASE WHEN len(list_distinct(list_transform({_RECORDS}, lambda x: CAST(x AS VARCHAR)))) < len({_RECORDS}) THEN 'repeated record' END) AS error FROM e
""")
def record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of records taken from a turn."""
    rows = derived(spark, sf_dir, PLAN_RAW).withColumn("v", F.explode(F.array(F.try_parse_json("raw"))))
    return rows.select("conv_id", "turn", contracts.plan_error(F.col("v"), F.col("t1")).alias("error"))


_MODALITY = by(1, (9, said("observed")), (11, said("belief")), (14, said("inferred")), (15, said("sung")), (16, "'1'"))
_REASONED = by(2, (6, said("mechanism")), (9, said("mechanical")), (12, said("observed")), (16, said("knowledge_relation")))
COMPACT_EVENT = obj(
    ("actors", listed(text("q1"))),
    ("event", text("t1")),
    ("source_ids", listed(said("S1"))),
    ("modality", _MODALITY),
    ("check_reason", by(3, (12, _REASONED), (16, "NULL"))),
    ("checkReason", by(3, (11, "NULL"), (15, _REASONED), (16, "NULL"))),
    ("explicit", by(4, (8, "NULL"), (13, "'true'"), (15, "'false'"), (16, said("yes")))),
    ("conditions", by(5, (9, "NULL"), (15, listed(text("q2"))), (16, "'[]'"))),
    ("mood", by(6, (15, "NULL"), (16, "'1'"))),
)
EXPAND_RAW = by(0, (1, "'{'"), (2, obj(("events", "'[]'"), ("non_event_span_ids", "'[]'"))), (3, obj(("events", "'{}'"), ("ignored_spans", "'[]'"), ("non_event_span_ids", "'[]'"))), (4, obj(("events", "'[1]'"), ("ignored_spans", "'[]'"), ("non_event_span_ids", "'[]'"))), (16, obj(("events", listed(COMPACT_EVENT)), ("ignored_spans", "'[]'"), ("non_event_span_ids", listed(said("S2"))))))
_KNOWN_EVENT = (*wire.NEEDED, *wire.OPTIONAL, *wire.FIELD_ALIASES)
_WITH_ALIAS = f"(list_contains(json_keys(e), 'check_reason') <> list_contains(json_keys(e), 'checkReason')) AND len(list_filter(json_keys(e), lambda k: k NOT IN {_KNOWN_EVENT})) = 0 AND len(list_filter({list(wire.NEEDED[:-1])}, lambda k: NOT list_contains(json_keys(e), k))) = 0"
_CODE = "coalesce(e->>'$.check_reason', e->>'$.checkReason')"


@query(f"""
WITH {ctes(EXPAND_RAW)}, f AS (SELECT *, j->'$.events[0]' AS e FROM r),
g AS (SELECT *, coalesce({first_broken([("exits", keys(wire.EXITS)), *[(x, f"json_type(j, '$.{x}') = 'ARRAY'") for x in wire.EXITS]])}, CASE WHEN json_array_length(j, '$.events') > 0 THEN {first_broken([
    ("object", "json_type(e) = 'OBJECT'"),
    ("fields", _WITH_ALIAS),
    ("modality", f"json_type(e, '$.modality') = 'VARCHAR' AND e->>'$.modality' IN {wire.MODALITIES}"),
    ("explicit", "json_type(e, '$.explicit') IS NULL OR (json_type(e, '$.explicit') = 'BOOLEAN' AND (e->>'$.explicit') = CAST(e->>'$.modality' <> 'inferred' AS VARCHAR))"),
])} END) AS error FROM f)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE {_CODE} WHEN 'mechanical' THEN 'mechanism' WHEN 'observed' THEN 'state_time_space' ELSE {_CODE} END END AS check_reason,
  CASE WHEN error IS NULL AND e IS NOT NULL THEN CAST(e->>'$.modality' <> 'inferred' AS VARCHAR) END AS explicit, CASE WHEN error IS NULL AND e IS NOT NULL THEN coalesce(json_array_length(e, '$.conditions'), 0) END AS conditions,
  CASE WHEN error IS NULL THEN e->>'$.actors[0]' END AS actor FROM g
""")
def wire_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact replies: aliases, defaults and what they may not hold."""
    rows = derived(spark, sf_dir, EXPAND_RAW).select("conv_id", "turn", F.explode(F.array(wire.expand_payload(F.col("raw")))).alias("p"))
    e = F.get("p.events", 0)
    return rows.select("conv_id", "turn", "p.error", e.check_reason.alias("check_reason"), e.explicit.cast("string").alias("explicit"), F.when(e.isNotNull(), F.size(e.conditions)).cast("long").alias("conditions"), F.get(e.actors, 0).alias("actor"))


LEAN_EVENT = obj(
    ("actors", by(1, (11, listed(text("q1"))), (16, "NULL"))),
    ("Actors", by(1, (11, "NULL"), (15, listed(text("q1"))), (16, "NULL"))),
    ("ACTORS", by(3, (15, "NULL"), (16, "'[]'"))),
    ("event", text("t1")),
    ("Modality", said("observed")),
    ("source_ids", listed(said("S1"))),
    ("context_ids", "'[]'"),
    ("check_reason", by(2, (15, said("mechanism")), (16, "NULL"))),
    ("mood", by(4, (15, "NULL"), (16, "'1'"))),
)
LEAN_RAW = by(0, (1, "'{}'"), (2, obj(("events", "'[3]'"), ("ignored_span_ids", "'[]'"), ("non_event_span_ids", "'[]'"))), (16, obj(("events", listed(LEAN_EVENT)), ("ignored_span_ids", by(5, (8, listed(said("S3"))), (12, "'[]'"), (14, listed(said("S3"), said("S3"))), (15, "'[3]'"), (16, said("S3")))), ("non_event_span_ids", by(6, (15, "'[]'"), (16, "'{}'"))))))
_LEAN_NAMES = (*wire.LEAN_NEEDED, *wire.LEAN_OPTIONAL)
_LOW = f"list_filter(list_transform(json_keys(e), lambda k: lower(k)), lambda k: k IN {_LEAN_NAMES})"


@query(f"""
WITH {ctes(LEAN_RAW)}, f AS (SELECT *, j->'$.events[0]' AS e FROM r),
g AS (SELECT *, coalesce({first_broken([("exits", keys(wire.LEAN_EXITS)), *[(x, f"json_type(j, '$.{x}') = 'ARRAY'") for x in wire.LEAN_EXITS], ("ignored ids", is_texts("$.ignored_span_ids") + " AND len(list_distinct(json_extract(j, '$.ignored_span_ids[*]'))) = json_array_length(j, '$.ignored_span_ids')")])}, {first_broken([
    ("event object", "json_type(e) = 'OBJECT'"),
    ("field case", f"len(list_distinct({_LOW})) = len({_LOW})"),
    ("event fields", f"len(list_filter({list(wire.LEAN_NEEDED)}, lambda n: NOT list_contains({_LOW}, n))) = 0 AND len({_LOW}) = len(json_keys(e))"),
])}) AS error FROM f)
SELECT conv_id, turn, error, CASE WHEN json_type(e) = 'OBJECT' THEN 'event_field_case_normalized' ELSE '' END AS changes, CASE WHEN error IS NULL THEN j->>'$.ignored_span_ids[0]' END AS ignored,
  CASE WHEN error IS NULL THEN coalesce(e->>'$.actors[0]', e->>'$.Actors[0]') END AS actor FROM g
""")
def wire_lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lean replies on the full wire: names in any case, ignored ids as process details."""
    rows = derived(spark, sf_dir, LEAN_RAW).select("conv_id", "turn", F.explode(F.array(wire.lean_payload(F.col("raw")))).alias("p"))
    changes = F.coalesce(F.array_join("p.changes", ","), F.lit("")).alias("changes")
    return rows.select("conv_id", "turn", "p.error", changes, F.get("p.ignored_spans", 0).source_id.alias("ignored"), F.get(F.get("p.events", 0).actors, 0).alias("actor"))


MISSPELLED_RAW = by(
    0,
    (2, "'no json ' || q1"),
    (16, obj(
        ("events", listed(obj(("a", text("q1")), ("mentalological_state", by(1, (9, text("q2")), (16, "NULL"))), ("mental_state", by(2, (5, said("calm")), (16, "NULL")))), obj(("mentalological_state", by(3, (5, "'null'"), (16, "NULL")))))),
        ("ignored_spans", listed(obj(("source_id", said("S1"))), obj(("source_Ids", by(4, (9, said("S2")), (16, "NULL")))))),
    )),
)
_HAS = lambda at, name: f"list_contains(json_keys(j, '{at}'), '{name}')"
_MOVES = "concat_ws(',', " + ", ".join(f"CASE WHEN {_HAS('$.' + at, wrong)} AND NOT {_HAS('$.' + at, right)} THEN '{at}' END" for at, wrong, right in (("events[0]", "mentalological_state", "mental_state"), ("events[1]", "mentalological_state", "mental_state"), ("ignored_spans[0]", "source_Ids", "source_id"), ("ignored_spans[1]", "source_Ids", "source_id"))) + ")"


@query(f"""
WITH {ctes(MISSPELLED_RAW)}, m AS (SELECT *, CASE WHEN j IS NULL THEN '' ELSE {_MOVES} END AS paths FROM r)
SELECT conv_id, turn, paths, paths = '' AS untouched, CASE WHEN contains(paths, 'events[0]') THEN j->>'$.events[0].mentalological_state' ELSE j->>'$.events[0].mental_state' END AS state,
  CASE WHEN contains(paths, 'spans[1]') THEN j->>'$.ignored_spans[1].source_Ids' END AS span FROM m
""")
def wire_misspelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with misspelled fields put right; the others keep every byte."""
    rows = derived(spark, sf_dir, MISSPELLED_RAW).select("conv_id", "turn", "raw", F.explode(F.array(wire.repair(F.col("raw")))).alias("p"))
    paths = F.array_join(F.transform("p.actions", lambda a: a.path), ",")
    told = lambda path: F.get_json_object("p.raw", path)
    return rows.select("conv_id", "turn", paths.alias("paths"), (F.col("p.raw") == F.col("raw")).alias("untouched"), told("$.events[0].mental_state").alias("state"), told("$.ignored_spans[1].source_id").alias("span"))


PROJECTED_RAW = obj(
    ("events", by(1, (12, listed(obj(("a", text("q1"))))), (14, "'[]'"), (16, "NULL"))),
    ("ignored_spans", by(2, (9, listed(obj(("source_id", said("S1")), ("reason", text("q2"))), said("S2"), obj(("x", "'1'")))), (12, listed(obj(("source_id", said(""))))), (14, "'[]'"), (16, "NULL"))),
    ("non_event_span_ids", by(3, (9, listed(said("S3"), text("h"))), (13, "'[]'"), (16, "NULL"))),
)
_IGNORED = "list_filter(list_transform(json_extract(j, '$.ignored_spans[*]'), lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' ELSE nullif(x->>'$.source_id', '') END), lambda i: i IS NOT NULL)"


@query(f"""
WITH {ctes(PROJECTED_RAW)} SELECT conv_id, turn, coalesce(json_array_length(j, '$.events'), 0) AS events, j->>'$.events[0].a' AS said, coalesce(array_to_string({_IGNORED}, ','), '') AS ignored, coalesce(array_to_string(json_extract_string(j, '$.non_event_span_ids[*]'), ','), '') AS others FROM r
""")
def reply_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies cut down to what later stages need, read back."""
    made = wire.extractor_projection(F.col("raw"))
    rows = derived(spark, sf_dir, PROJECTED_RAW).select("conv_id", "turn", F.from_json(made, "events array<struct<a: string>>, ignored_span_ids array<string>, non_event_span_ids array<string>").alias("p"))
    return rows.select("conv_id", "turn", F.size("p.events").cast("long").alias("events"), F.get("p.events", 0).a.alias("said"), F.array_join("p.ignored_span_ids", ",").alias("ignored"), F.array_join("p.non_event_span_ids", ",").alias("others"))


# ---- facts and short records over a story of two spans: the turn before, a full stop or a comma, and the turn


MARK = by(15, (8, "', '"), (16, "'。'"))
SPANNED = {"mark": MARK, "story": f"t2 || {MARK} || t1", "a2": "0", "b2": "length(t2)", "a1": f"length(t2) + length({MARK})", "b1": f"length(t2) + length({MARK}) + length(t1)"}


def spans() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.col(t).alias("text"), F.col(a).cast("int").alias("start"), F.col(b).cast("int").alias("stop")) for i, t, a, b in (("S1", "t2", "a2", "b2"), ("S2", "t1", "a1", "b1"))])


def spanned(spark: SparkSession, sf_dir: str, raw: str) -> DataFrame:
    """derived() with the story, its spans and the reply's variant."""
    rows = table(spark, sf_dir, "conversations").select(*[F.expr(v).alias(k) for k, v in BASE.items()])
    rows = rows.select("*", *[F.expr(v).alias(k) for k, v in {**QUOTES, **DIGITS}.items()])
    rows = rows.select("*", *[F.expr(v).alias(k) for k, v in SPANNED.items()], F.expr(raw).alias("raw"))
    return rows.withColumn("v", F.explode(F.array(F.try_parse_json("raw"))))


def spanned_ctes(raw: str) -> str:
    return ctes(raw) + ", s AS (SELECT *, " + ", ".join(f"{duck(v)} AS {k}" for k, v in SPANNED.items()) + " FROM r)"


def _fact(kind: str) -> str:
    return obj(
        ("subject", by(1, (9, text("q1")), (12, text("q2")), (13, said("Nobody")), (14, said("她")), (15, "'4'"), (16, "NULL"))),
        ("predicate", by(2, (15, said("says")), (16, said(" ")))),
        ("type", by(3, (14, said(kind)), (15, said("mood")), (16, "NULL"))),
        ("source_ids", by(4, (7, listed(said("S2"))), (10, listed(said("S1"))), (12, listed(said("S2"), said("S1"))), (13, listed(said("S1"), said("S1"))), (14, listed(said("S7"))), (15, "'[]'"), (16, said("S2")))),
        ("context_ids", by(5, (10, "NULL"), (13, "'[]'"), (15, listed(said("S1"))), (16, listed(said("S9"))))),
        ("time", by(6, (10, "NULL"), (12, "'null'"), (15, text("substr(t2, 1, 4)")), (16, said("noon")))),
        ("object", by(7, (9, "NULL"), (13, text("q2")), (15, said(" ")), (16, "'8'"))),
    )


FACT_RAW = by(0, (1, "'facts'"), (2, obj(("fact", "'[]'"))), (3, obj(("facts", "'[]'"))), (9, obj(("facts", listed(_fact("location"))))), (12, obj(("facts", listed(_fact("location"), _fact("location"))))), (16, obj(("facts", listed(_fact("timeline"), _fact("identity"), "'3'")))))
_FACTS = "json_extract(j, '$.facts[*]')"
_F = lambda n: f"(x->>'$.{n}')"
_FT = lambda n: f"json_type(x, '$.{n}') = 'VARCHAR' AND regexp_matches({_F(n)}, '\\S')"
_IDS = lambda n: f"CAST(json_extract_string(x, '$.{n}[*]') AS VARCHAR[])"
_REFS = lambda n: f"json_type(x, '$.{n}') = 'ARRAY' AND len(list_filter({_IDS(n)}, lambda i: i NOT IN ('S1', 'S2'))) = 0 AND len(list_distinct({_IDS(n)})) = len({_IDS(n)})"
_SAYS = lambda of: f"len(list_filter({of}, lambda i: contains(CASE i WHEN 'S1' THEN t2 ELSE t1 END, {_F('subject')}))) > 0"
_ALL = f"list_concat({_IDS('source_ids')}, coalesce({_IDS('context_ids')}, []))"
_FROM = f"list_min(list_transform({_IDS('source_ids')}, lambda i: CASE i WHEN 'S1' THEN a2 ELSE a1 END))"
#: Only the first span can end before another begins: it alone names the subject, and no sentence ends in between.
_NEAR = f"(contains(t2, {_F('subject')}) AND NOT contains(t1, {_F('subject')}) AND b2 <= {_FROM} AND NOT regexp_matches(substr(story, b2, greatest({_FROM} - b2 + 1, 0)), '[。！？!?；;\\r\\n]'))"
_FACT_ERROR = first_broken(
    [
        ("fields", "len(list_filter(['subject', 'predicate', 'type', 'source_ids'], lambda k: NOT list_contains(json_keys(x), k))) = 0 AND len(list_filter(json_keys(x), lambda k: k NOT IN ('subject', 'predicate', 'type', 'source_ids', 'object', 'context_ids', 'time'))) = 0"),
        *[(n, _FT(n)) for n in ("subject", "predicate", "type")],
        ("object", "json_type(x, '$.object') IS NULL OR json_type(x, '$.object') IN ('VARCHAR', 'NULL')"),
        ("type", f"{_F('type')} IN {wire.FACT_TYPES}"),
        ("named subject", f"{_F('subject')} NOT IN {wire.FACT_PRONOUNS} AND contains(story, {_F('subject')})"),
        ("source_ids", _REFS("source_ids") + f" AND len({_IDS('source_ids')}) > 0"),
        ("context_ids", f"json_type(x, '$.context_ids') IS NULL OR ({_REFS('context_ids')})"),
        ("grounding", f"{_SAYS(_ALL)} OR {_NEAR}"),
        ("time", f"json_type(x, '$.time') IS NULL OR json_type(x, '$.time') = 'NULL' OR ({_FT('time')} AND contains(story, {_F('time')}))"),
    ]
)
_SOURCE = f"substr(story, {_FROM} + 1, list_max(list_transform({_IDS('source_ids')}, lambda i: CASE i WHEN 'S1' THEN b2 ELSE b1 END)) - {_FROM})"
_ADDED = f"list_concat(coalesce({_IDS('context_ids')}, []), CASE WHEN NOT {_SAYS(_ALL)} THEN ['S1'] ELSE [] END)"


@query(f"""
WITH {spanned_ctes(FACT_RAW)}, e AS (SELECT *, {first_broken([("facts", keys(("facts",)) + f" AND json_type(j, '$.facts') = 'ARRAY' AND len({_FACTS}) <= 20")])} AS error, list_transform({_FACTS}, lambda x: {_FACT_ERROR}) AS bad,
  list_transform({_FACTS}, lambda x: {_SOURCE}) AS sources, list_transform({_FACTS}, lambda x: array_to_string(list_sort({_ADDED}), ',')) AS contexts, list_transform({_FACTS}, lambda x: CAST(x AS VARCHAR)) AS said FROM s),
k AS (SELECT *, list_filter(range(1, len(bad) + 1), lambda i: bad[i] IS NULL) AS good FROM e), g AS (SELECT *, list_filter(good, lambda i: list_position(said, said[i]) = i) AS kept FROM k)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE WHEN len(good) = len(bad) THEN 'ok' WHEN len(kept) > 0 THEN 'partial' ELSE 'error' END END AS status,
  CASE WHEN error IS NULL THEN array_to_string(list_transform(kept, lambda i: 'F' || i), ',') ELSE '' END AS ids, CASE WHEN error IS NULL AND len(kept) > 0 THEN contexts[kept[1]] END AS context, CASE WHEN error IS NULL AND len(kept) > 0 THEN sources[kept[1]] END AS source_text,
  CASE WHEN error IS NULL THEN array_to_string(list_filter(bad, lambda b: b IS NOT NULL), ',') ELSE '' END AS rejected FROM g
""")
def fact_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested facts of a story of two turns: references, subjects and what they add as context."""
    rows = spanned(spark, sf_dir, FACT_RAW)
    rows = rows.select("conv_id", "turn", F.explode(F.array(wire.decoded_facts(F.col("v"), F.col("story"), spans()))).alias("p"))
    first = F.get("p.facts", 0).fact
    listed_ = lambda c, of: F.coalesce(F.array_join(F.transform(c, of), ","), F.lit(""))
    return rows.select("conv_id", "turn", "p.error", "p.status", listed_("p.facts", lambda f: f.id).alias("ids"), F.array_join(first.context_ids, ",").alias("context"), first.source_text.alias("source_text"), listed_("p.rejected", lambda r: r.error).alias("rejected"))


def _short(category: str) -> str:
    return obj(
        ("k", by(1, (8, said("attribute")), (10, said("entity")), (12, said("timepoint")), (14, said("event")), (15, said("wish")), (16, "NULL"))),
        ("e", by(2, (11, text("q1")), (13, text("q2")), (14, said("Nobody")), (15, "'null'"), (16, "'4'"))),
        ("c", by(3, (10, said(category)), (13, "NULL"), (16, said(" ")))),
        ("y", by(4, (8, "NULL"), (16, said("person")))),
        ("t", by(5, (7, "NULL"), (10, said("未知")), (14, text("substr(t1, 1, 4)")), (16, said("noon")))),
        ("s", by(6, (10, said("S2")), (12, said("S1")), (13, said("S9")), (16, "NULL"))),
        ("q", by(7, (15, "NULL"), (16, "'1'"))),
    )


SHORT_RAW = by(0, (1, "'records'"), (2, obj(("records", "'[]'"))), (3, obj(("records", "'{}'"))), (8, obj(("records", listed(_short("skill"))))), (11, obj(("records", listed(_short("skill"), _short("skill"))))), (16, obj(("records", listed(_short("skill"), _short("place"))))))
_R = lambda n: f"(x->>'$.{n}')"
_NODE, _THING = "coalesce((x->>'$.k') = 'timepoint', FALSE)", "coalesce((x->>'$.k') = 'entity', FALSE)"
_SPAN = "CASE x->>'$.s' WHEN 'S1' THEN t2 WHEN 'S2' THEN t1 END"
_BARE = f"CASE WHEN regexp_matches({_R('t')}, '\\S') AND NOT (trim({_R('t')}) IN {wire.NO_TIME} AND NOT contains(story, {_R('t')})) THEN {_R('t')} END"
_SHORT = {
    "kind": _R("k"), "entity": _R("e"), "entity_type": _R("y"), "category": f"coalesce({_R('c')}, CASE WHEN {_THING} THEN {_R('y')} WHEN {_NODE} THEN '{wire.TIME_NODE}' END)",
    "text": f"CASE WHEN {_NODE} OR {_THING} THEN {_R('e')} ELSE {_SPAN} END", "time": f"coalesce({_BARE}, CASE WHEN {_NODE} THEN {_R('e')} END)",
}
_LINE = lambda n: f"{_SHORT[n]} IS NULL OR regexp_matches({_SHORT[n]}, '\\S')"
_SHORT_ERROR = first_broken(
    [
        ("fields", f"len(list_filter(json_keys(x), lambda k: k NOT IN {(*wire.RECORD_KEYS, 's')})) = 0 AND len(list_filter(json_keys(x), lambda k: k <> 's' AND json_type(x, '$.' || k) NOT IN ('VARCHAR', 'NULL'))) = 0"),
        ("span", f"CASE WHEN {_NODE} OR {_THING} THEN x->>'$.s' IS NULL ELSE {_SPAN} IS NOT NULL END"),
        ("source", "regexp_matches(story, '\\S')"),
        ("kind", f"{_SHORT['kind']} IN {contracts.RECORD_KINDS}"),
        *[(n, _LINE(n)) for n in ("entity", "entity_type", "category", "text", "time")],
        ("category missing", f"{_SHORT['category']} IS NOT NULL"),
        ("text source", f"contains(story, {_SHORT['text']})"),
        *[(f"{n} source", f"{_SHORT[n]} IS NULL OR contains(story, {_SHORT[n]})") for n in ("entity", "time")],
        ("entity missing", f"{_SHORT['kind']} NOT IN ('entity', 'attribute', 'relation', 'timepoint') OR {_SHORT['entity']} IS NOT NULL"),
        ("entity_type missing", f"{_SHORT['kind']} <> 'entity' OR {_SHORT['entity_type']} IS NOT NULL"),
        ("time missing", f"{_SHORT['kind']} <> 'timepoint' OR {_SHORT['time']} IS NOT NULL"),
    ]
)


@query(f"""
WITH {spanned_ctes(SHORT_RAW)}, e AS (SELECT *, list_transform({_RECORDS}, lambda x: {_SHORT_ERROR}) AS bad, list_transform({_RECORDS}, lambda x: {_SHORT['text']}) AS texts, list_transform({_RECORDS}, lambda x: {_SHORT['time']}) AS times FROM s),
k AS (SELECT *, list_filter(range(1, len(bad) + 1), lambda i: bad[i] IS NULL) AS good FROM e),
g AS (SELECT *, {first_broken([("source", "regexp_matches(story, '\\S')"), ("records", keys(("records",)) + f" AND json_type(j, '$.records') = 'ARRAY' AND len({_RECORDS}) BETWEEN 1 AND 20"), ("all rejected", "len(good) > 0")])} AS error FROM k)
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN CASE WHEN len(good) < len(bad) THEN 'partial' ELSE 'complete' END END AS status, CASE WHEN error IS NULL THEN texts[good[1]] END AS text, CASE WHEN error IS NULL THEN times[good[1]] END AS time,
  CASE WHEN error IS NULL THEN array_to_string(list_filter(bad, lambda b: b IS NOT NULL), ',') ELSE '' END AS rejected FROM g
""")
def short_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one-letter keys: spans for texts, times that say there is none, nodes as their own text."""
    rows = spanned(spark, sf_dir, SHORT_RAW)
    rows = rows.select("conv_id", "turn", F.explode(F.array(wire.decoded_records(F.col("v"), F.col("story"), spans()))).alias("p"))
    first = F.get("p.records", 0)
    return rows.select("conv_id", "turn", "p.error", "p.status", first.text.alias("text"), first.time.alias("time"), F.coalesce(F.array_join(F.transform("p.rejected", lambda r: r.error), ","), F.lit("")).alias("rejected"))
