from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.functions import judging, rules, stats, text, wire
from plumbline.operators import checks, metrics, sequences


def one(spark, expr, **values):
    return spark.createDataFrame([Row(**values)]).select(expr.alias("x")).first().x


def test_tokens_of_mixed_scripts(spark):
    assert one(spark, text.tokenize(F.col("t")), t="左胸 A-12") == ["左", "胸", "左胸", "a", "12"]
    assert one(spark, text.tokenize(F.col("t")), t="ＡＢ") == ["ab"]


def test_spans_hold_their_offsets(spark):
    t = "  first, second。\n" + "x" * 400
    spans = one(spark, text.split_spans(F.col("t")), t=t)
    assert [s.id for s in spans] == ["S1", "S2", "S3", "S4", "S5"]
    assert all(t[s.start : s.stop] == s.text for s in spans) and [len(s.text) for s in spans[2:]] == [180, 180, 40]
    assert one(spark, text.clause_texts(F.col("t")), t=t) == [s.text for s in spans]
    assert one(spark, text.split_spans(F.col("t")), t=" \n ") == []


def test_digest_is_by_name_not_by_order(spark):
    d = spark.createDataFrame([(1, None)], "b int, a string")
    assert d.select(text.digest("a", "b")).first()[0] == d.select(text.digest("b", "a")).first()[0]


def test_tags(spark):
    h, t, f = F.col("h"), F.col("t"), F.col("f")
    row = {"h": ["人物", "安娜", "2063年"], "t": "她必须保密。", "f": "a/b.md"}
    assert one(spark, rules.domain(h, f), **row) == "character"
    assert one(spark, rules.scope(h), **row) == "安娜"
    assert one(spark, rules.dimension_tags(h, t, f), **row) == ["character_knowledge", "time", "world_rule"]
    assert one(spark, rules.polarity(t), **row) == ["restrictive"]


def test_failure_classes(spark):
    c = rules.retry_class(F.col("p"), F.col("e"), F.col("k"), F.col("r"))
    for e, r, want in [("x schema x", "", "EMPTY_OUTPUT"), ("x schema x", "r", "SCHEMA_VALIDATION_ERROR"), ("Truncated", "r", "TRUNCATED_OUTPUT"), ("?", "r", "OTHER")]:
        assert one(spark, c, p="", e=e, k="", r=r) == want
    assert one(spark, rules.audit_class(F.col("e"), F.lit(""), F.lit("r")), e="Expecting value") == "JSON_PARSE_ERROR"


def test_guard_downgrades_what_is_not_proven(spark):
    a = Row(same_subject=True, evidence_applicable=True, relation="direct_conflict", can_both_be_true=None, assumptions=["x"])
    d = spark.createDataFrame([("contradiction", a)], "v string, a struct<same_subject: boolean, evidence_applicable: boolean, relation: string, can_both_be_true: boolean, assumptions: array<string>>")
    g = d.select(judging.guard(F.col("v"), F.col("a")).alias("g")).first().g
    assert (g.verdict, g.model_verdict, g.guard_reason) == ("uncertain", "contradiction", "coexistence_not_ruled_out")


def test_repair_renames_and_keeps_bytes(spark):
    bad = '{"events":[{"mentalological_state":1}]}'
    r = one(spark, wire.repair(F.col("t")), t=bad)
    assert r.raw == '{"events":[{"mental_state":1}]}' and r.actions[0].to == "mental_state"
    kept = '{ "events" : [] }'
    assert one(spark, wire.repair(F.col("t")), t=kept).raw == kept
    assert one(spark, wire.leading_object(F.col("t")), t='{"a": 1} tail').rest == "tail"


def test_percentiles_and_sums(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    r = d.agg(stats.nearest_rank("x", 0.5).alias("a"), F.median("x").alias("b"), stats.linear("x", 0.95).alias("c"), stats.strict_sum("x").alias("d")).first()
    assert (r.a, r.b, round(r.c, 6), r.d) == (2.0, 2.5, 3.85, 10.0)
    assert d.union(spark.createDataFrame([(None,)], "x double")).agg(stats.strict_sum("x")).first()[0] is None


def test_greedy_windows(spark):
    sizes = [100, 90, 10, 10, 10, 10, 10, 10, 10, 10, 300, 1]
    want, n, chars, w = [], 0, 0, 0
    for s in sizes:
        if not n or n >= 8 or chars + s > 180:
            w, n, chars = w + 1, 0, 0
        n, chars = n + 1, chars + s
        want.append(w)
    assert one(spark, sequences.greedy_windows(F.col("s")), s=sizes) == want


def test_windows_carry_context(spark):
    spans = [Row(id=f"S{i}", text="x" * 100) for i in range(1, 4)]
    d = spark.createDataFrame([("d", spans)], "doc string, spans array<struct<id: string, text: string>>")
    got = [(r.target_ids, r.context_ids) for r in sequences.windows(d, "doc", "spans").orderBy("window_no").collect()]
    assert got == [(["S1"], []), (["S2"], ["S1"]), (["S3"], ["S1", "S2"])]


def test_one_to_one_matching_depends_on_order(spark):
    a = spark.createDataFrame([(1, 1, ["g1", "g2"]), (1, 2, ["g1"]), (1, 3, ["g2", "g3"])], "case_id long, alarm_id long, gold_ids array<string>")
    got = {r.alarm_id: r.matched for r in metrics.greedy_matches(a).collect()}
    assert got == {"1": "g1", "2": None, "3": "g2"}


def test_coverage_conflict(spark):
    spans = spark.createDataFrame([("d", "S1"), ("d", "S2"), ("d", "S3")], "doc string, id string")
    disp = spark.createDataFrame([("d", "S1", "event"), ("d", "S1", "event"), ("d", "S2", "event"), ("d", "S2", "ignored")], "doc string, id string, kind string")
    got = {r.id: r.kind for r in checks.coverage(spans, disp, ["doc", "id"]).collect()}
    assert got == {"S1": "event", "S2": "conflict", "S3": "uncovered"}
