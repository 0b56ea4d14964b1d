import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import shapes, wire
from plumbline.operators import lore, reports, reviews, story, traces
from plumbline.operators.story import Config

SPANS = [("S1", "Ann flies,"), ("S2", "she rests,"), ("S3", "Bob sleeps")]


def spans():
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("text")) for i, t in SPANS])


def test_windows_are_settled(spark):
    event = {"actors": ["Ann"], "event": "rests", "source_ids": ["S2"], "context_ids": [], "modality": "observed", "check_reason": "mechanism"}
    reply = {"events": [event, {**event, "source_ids": ["S1"]}], "ignored_spans": [{"source_id": "S1", "reason": "routine"}, {"source_id": "S2", "reason": "routine"}], "non_event_span_ids": ["S3", "S3", "S1"]}
    d = spark.createDataFrame([(json.dumps(reply),)], "raw string").select(F.from_json("raw", story.REPLY).alias("r"))
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    s = d.select(wire.settle_window(F.col("r.events"), F.col("r.ignored_spans"), F.col("r.non_event_span_ids"), spans(), ids("S1"), ids("S2", "S3")).alias("s"))
    got = s.first().s
    assert [(e.source_ids, e.context_ids) for e in got.events] == [(["S2"], ["S1"])] and got.ignored_spans == [] and got.non_event_span_ids == ["S3"]
    assert got.changes == ["actor_context_added", "context_event_removed", "context_disposition_removed", "duplicate_ignored_removed", "duplicate_non_event_removed"]
    assert s.select(wire.window_error(F.col("s"), spans(), ids("S1"), ids("S2", "S3"))).first()[0] is None
    assert s.select(wire.window_error(F.col("s"), spans(), ids("S1"), ids("S2", "S3", "S4"))).first()[0] == "uncovered"


def test_early_replies(spark):
    rows = ['{"Actors": "Ann", "event": "x", "explicit": true, "modality": "observed", "source_ids": ["S1"]}', "[1]"]
    d = spark.createDataFrame([(r,) for r in rows], "raw string").withColumn("v", shapes.parsed(F.col("raw")))
    a, b = d.select(wire.early_event(F.col("v")).alias("e")).collect()
    assert a.e.event.actors == ["Ann"] and a.e.event.conditions == [] and b.e.event is None
    assert a.e.changes == ["field_case_normalized:Actors", "actors_scalar_wrapped"] and a.e.defaulted == ["mental_state", "conditions", "context_ids"]
    envelopes = {'{"events": []}': None, '{"events": [{"source_ids": ["S1"]}], "non_event_span_ids": ["S1"]}': "both", '{"events": [], "non_event_span_ids": ["S9"]}': "non event scope", '{"events": [], "non_event_span_ids": ["S1", "S1"]}': "non event ids", '{"x": 1}': "fields"}
    d = spark.createDataFrame([(k,) for k in envelopes], "raw string").withColumn("v", shapes.parsed(F.col("raw")))
    assert {r.raw: r.e for r in d.select("raw", wire.early_envelope_error(F.col("v"), F.array(F.lit("S1"))).alias("e")).collect()} == envelopes


def test_budgets_and_times(spark):
    d = spark.createDataFrame([(1000,), (3000,), (4000,), (None,)], "n int")
    assert [r[0] for r in d.select(wire.output_budget(F.col("n"))).collect()] == [1536, 1096, None, 1536]
    t = spark.createDataFrame([(1.0, 1.5, 3.0), (1.0, None, 0.5)], "a double, b double, c double").select(traces.call_times(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()
    assert tuple(t[0].t) == (0.5, 1.5, 2.0, 500.0) and tuple(t[1].t) == (None, None, 0.0, None)
    steps = spark.createDataFrame([("x", 1), ("x", 3)], "k string, committed int")
    assert tuple(traces.commit_steps(steps, "k").first()) == ("x", 2, 4, 1, 2.0)
    assert {r.run: r.total for r in traces.measured_runs(spark.createDataFrame([(1, 9.0), (2, 1.0), (2, 2.0)], "run int, s double"), "run", 1, "s").collect()} == {2: 3.0}


def test_guarded_decisions_and_projections(spark):
    d = spark.createDataFrame([("ignore", "inferred", []), ("keep", "observed", ["unresolved_actor"]), ("keep", "observed", [])], "d string, m string, r array<string>")
    assert [r[0] for r in d.select(wire.guarded_decision(F.col("d"), F.col("m"), F.col("r"))).collect()] == ["review", "review", "keep"]
    p = spark.range(1).select(wire.judge_projection(F.lit("contradiction"), F.lit("y" * 100), F.array(F.lit("L1"))).alias("p")).first().p
    assert json.loads(p) == {"verdict": "contradiction", "citation_ids": ["L1"], "reason": "y" * 80}


def lean_models():
    def extractor(prompts):
        out = []
        for p in prompts:
            targets = json.loads(p)["targets"]
            known = [t for t in targets if "Ann" in t["text"]]
            events = [{"Actors": ["Ann"], "event": "Ann acts", "source_ids": [t["id"]], "context_ids": [], "modality": "observed", "check_reason": "mechanism"} for t in known]
            rest = [t["id"] for t in targets if "Ann" not in t["text"]]
            # The first reply leaves out the last span without a name; asked again, it names it and one too many.
            missing = rest[:-1] if known else [*rest, "S99"]
            out.append((json.dumps({"events": events, "ignored_span_ids": missing, "non_event_span_ids": []}), None))
        return out

    def judge(prompts):
        return [(json.dumps({"verdict": "contradiction", "evidence_ids": ["L1"]}), None) for _ in prompts]

    return extractor, judge


def test_lean_chain_recovers_what_was_left_out(spark):
    extractor, judge = lean_models()
    stories = spark.createDataFrame([("s1", "Ann flies, then rests, Bob sleeps")], "case_id string, text string")
    events, claims = story.extract(stories, extractor, protocol="lean")
    assert not story.coverage(stories, claims).first().complete
    events, claims = story.extract(stories, extractor, protocol="lean", recover=True)
    assert story.coverage(stories, claims).first().complete and events.where("error IS NULL").count() == 1
    e = events.where("error IS NULL").withColumn("event_id", F.lit("e1"))
    chunks = spark.createDataFrame([("c1", 0, ["人物", "Ann", "x"], "nobody"), ("c2", 1, ["人物", "Bob", "y"], "Ann flies then rests")], "chunk_id string, ord long, heading_path array<string>, text string")
    evidence = story.find_evidence(e, chunks, Config("bm25", k=1))
    assert [c.chunk_id for c in evidence.first().evidence] == ["c2"]
    r = story.judge(e.join(evidence, "event_id"), judge, contract="lean").first()
    assert (r.verdict, r.status, r.origin, r.citations) == ("contradiction", "ok", "model", ["c2"])
    assert story.judge(e.join(evidence, "event_id"), judge, contract="joint").first().error == "fields"
    assert story.review_template(e).first().label == "pending"
    assert [r.call_id for r in story.numbered(e, ["event_id"], last=4).collect()] == ["LLM-000005"]


def test_the_metadata_filter_is_honoured(spark):
    rows = [(f"c{i}", i, ["人物", "Ann" if i >= 30 else "Bob", "身体"], "Ann flies" if i < 3 else "心脏 text") for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ord long, heading_path array<string>, text string")
    meta = lore.metadata(chunks.select("chunk_id", F.lit("a.md").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "heading_path", F.lit("心脏").alias("text")))
    event = spark.createDataFrame([("e1", "s", json.dumps({"actors": ["Ann"], "event": "Ann flies", "modality": "observed", "check_reason": "mechanism", "source_ids": [], "context_ids": []}))], "event_id string, case_id string, raw string")
    e = event.select("event_id", "case_id", F.from_json("raw", wire.EVENT).alias("event"), F.array().cast("array<struct<id: string, text: string, start: int, stop: int>>").alias("spans"))
    found = lambda on: [c.chunk_id for c in story.find_evidence(e, chunks, Config("bm25", on, 3), metadata=meta if on else None).first().evidence]
    assert found(False) == ["c0", "c1", "c2"] and found(True) == ["c30", "c31", "c32"]
    with pytest.raises(ValueError, match="metadata"):
        story.find_evidence(e, chunks, Config("bm25", True, 3))


def test_queries_of_facts_and_reports(spark):
    f = spark.createDataFrame([("Ann", "flies", None, "Ann flies", "Ann flies", "noon")], "subject string, predicate string, object string, source_text string, context_text string, time string")
    assert f.select(story.fact_query(F.struct("*"))).first()[0] == "Ann flies\nnoon"
    findings = spark.createDataFrame([("contradiction", "model", "observed", None, "a", 1), ("uncertain", "program_no_evidence", "observed", None, "b", 2)], "verdict string, origin string, modality string, uncertainty_code string, text string, n int")
    text = reports.author_report("T", reports.sections(findings), "n", "text")
    assert "contradictions:\n1. a\n" in text and "possible_additions:\n1. b\n" in text and "confirmations:\nnone" in text
    assert reports.overview(reports.sections(findings).withColumn("g", F.lit(1)), "g").first().verdict == "contradiction"
    up, down = spark.createDataFrame([("c", "partial")], "case_id string, status string"), spark.createDataFrame([("c", "ok")], "case_id string, status string")
    assert reports.hidden_failures(down, up).count() == 1 and reports.hidden_failures(up, down).count() == 0
    bad = spark.createDataFrame([("c", 1, ["Ann"], "x", "observed", True, []), ("c", 1, [], " ", "sung", None, None)], "case_id string, event_id int, actors array<string>, event string, modality string, explicit boolean, conditions array<string>")
    assert {r.rule for r in reports.input_problems(bad).collect()} == {"id", "actors", "event", "modality", "explicit", "conditions"}
    m = reviews.mapping_problems(spark.createDataFrame([("c", "G1", "E1"), ("c", "G2", "E2")], "case_id string, gold_id string, event_id string"), spark.createDataFrame([("c", "G1")], "case_id string, gold_id string"), spark.createDataFrame([("c", "E2")], "case_id string, event_id string"))
    assert sorted((r.gold_id, r.rule) for r in m.collect()) == [("G1", "event"), ("G2", "gold")]


def test_replies_are_held_against_their_contract(spark):
    from plumbline.functions import contracts
    from plumbline.streaming import batching

    def model(prompts):
        good = json.dumps({"verdict": "一致", "evidence": ["E1"], "reason": "r"})
        return [(good if p == "good" else "no json", None) for p in prompts]

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")
    evidence = F.array(F.struct(F.lit("c").alias("id"), F.lit("t").alias("text")))
    got = {r.id: (r.error, r.attempt) for r in batching.ask(rows, model, lambda v: contracts.world_verdict_error(v, evidence)).collect()}
    assert got == {1: (None, 1), 2: ("fields", 2)}


def test_texts_are_encoded(spark):
    import numpy as np

    from plumbline.streaming import batching

    def encoder(texts):
        return np.array([[len(t), 3.0] for t in texts])

    rows = spark.createDataFrame([(1, "four"), (2, "")], "id long, t string")
    got = {r.id: r.embedding for r in batching.encode(rows.where("id = 1"), "t", encoder, 1).collect()}
    assert [round(x, 6) for x in got[1]] == [0.8, 0.6]
    assert len(batching.encode(rows, "t", encoder, prefix="q: ").collect()) == 2


def test_runs(spark, tmp_path):
    from plumbline.operators import metrics, runs

    cases = spark.createDataFrame([("b",), ("a",)], "case_id string")
    config = {"system": "candidate", "retrieval": "hybrid", "contract": "joint"}
    assert runs.run_identity("d", config, cases) == runs.run_identity("d", config, cases.orderBy("case_id")) != runs.run_identity("e", config, cases)
    with pytest.raises(ValueError, match="repeated case"):
        runs.run_identity("d", config, cases.union(cases))
    with pytest.raises(ValueError, match="no such system"):
        runs.run_identity("d", {**config, "retrieval": "dense"}, cases)
    path = f"file://{tmp_path}/manifest.json"
    assert [runs.ensure_manifest(spark, path, {"a": 1}), runs.ensure_manifest(spark, path, {"a": 1})] == [False, True]
    with pytest.raises(ValueError, match="another run"):
        runs.ensure_manifest(spark, path, {"a": 2})
    runs.enough_space(spark, f"file://{tmp_path}", 1)
    with pytest.raises(OSError):
        runs.enough_space(spark, f"file://{tmp_path}", 2**60)
    a = runs.arms(spark, batch=[1, 8], ngram=[2])
    assert sorted(r.arm for r in a.collect()) == ["batch1-ngram2", "batch8-ngram2"]
    assert runs.arm_table(a, spark.createDataFrame([("batch1-ngram2", 5)], "arm string, n int")).where("n IS NULL").count() == 1
    e = spark.createDataFrame([(1,), (2,)], "x int")
    out = runs.paired(e, {"r1": lambda d: d, "r2": lambda d: d.where("x = 1")}, {"j1": lambda d: d.withColumn("v", F.lit("a")), "j2": lambda d: d.withColumn("v", F.lit("b"))})
    assert {(r.retrieval, r.judge): r["count"] for r in out.groupBy("retrieval", "judge").count().collect()} == {("r1", "j1"): 2, ("r1", "j2"): 2, ("r2", "j1"): 1, ("r2", "j2"): 1}
    rows = spark.createDataFrame([("a", ("x", 1.0)), ("b", ("x", 2.0))], "case_id string, r struct<said: string, seconds: double>")
    ref = runs.quality_reference(rows, runs.semantic_digest(F.col("r"), "seconds"))
    assert ref.select("digest").distinct().count() == 1
    assert [n for n, _ in runs.admission_orders("t", ("a",), ("b",))] == ["alone", "first", "last", "other"]
    trace = lambda *v: spark.createDataFrame(list(enumerate(v)), "step int, token string")
    assert {(r.left, r.right): r.step for r in runs.divergences({"x": trace("a", "b"), "y": trace("a", "c"), "z": trace("a", "b")}, "step", "token").collect()} == {("x", "y"): 1, ("x", "z"): None, ("y", "z"): 1}
    results = spark.createDataFrame([("c", "c", "ok", 1), ("c", None, "error", 2)], "expected string, predicted string, status string, attempts int")
    assert tuple(metrics.judge_results(results).first()) == (2, 1, 1, 1, 0.5, 0.5, 0.5)
    p = metrics.performance(spark.createDataFrame([(1.0, 10, 2.0), (3.0, 10, 2.0)], "ttft double, output_tokens int, decode double"), spark.createDataFrame([(4.0,), (6.0,)], "seconds double"), 5.0).first()
    assert (p.ttft_median, p.decode_rate, p.latency_p95, p.stories_per_second) == (2.0, 5.0, 6.0, 0.4)
    schema = wire.event_schema()
    assert schema["required"] == ["events", "ignored_spans", "non_event_span_ids"] and schema["properties"]["events"]["items"]["additionalProperties"] is False


def test_commands(spark, tmp_path, capsys):
    from plumbline import cli

    (tmp_path / "lore").mkdir()
    (tmp_path / "lore" / "a.md").write_text("# 人物\n## 安娜\n### x\n\n安娜会飞。\n\n# other\n\nplain text", encoding="utf-8")
    folder = f"file://{tmp_path}/index"
    assert cli.main(["index", f"file://{tmp_path}/lore", folder, "--most", "100"]) == 0
    assert cli.main(["search", folder, "安娜", "-k", "1"]) == 0 and cli.main(["inspect", folder]) == 0
    said = capsys.readouterr().out
    assert "a.md:5" in said and "domain character: 1 (0.5)" in said

