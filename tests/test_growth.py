import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from oracle import SF
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import impacts, retrieval, reviews, scoring, traces
from plumbline.plans import ledgers, texts
from plumbline.sources import sync
from plumbline.streaming import stateful


def test_expected_candidates_makes_no_more_than_what_is_expected(spark):
    facts = spark.sql("SELECT id AS fact_id, array('e') AS entities, array(concat('d', id % 3)) AS dimensions, array() AS times FROM range(60)").selectExpr("fact_id", "CAST(array() AS array<string>) AS entities", "dimensions", "CAST(times AS array<string>) AS times")
    items = spark.sql("SELECT id AS item_id, CAST(array() AS array<string>) AS entities, array(concat('d', id % 4)) AS dimension_tags, CAST(array() AS array<string>) AS time_markers FROM range(200)")
    expected = facts.selectExpr("fact_id", "explode(array(fact_id % 5, 4L)) AS item_id")
    picked, some = retrieval.expected_candidates(facts, items, expected, 20)
    every, whole = retrieval.candidate_items(facts, items, 20)
    assert sorted(some.collect()) == sorted(whole.join(expected.distinct(), ["fact_id", "item_id"], "left_semi").collect()) and whole.count() == 60 * 50
    assert sorted(map(str, retrieval.filter_audit(picked, some, expected).collect())) == sorted(map(str, retrieval.filter_audit(every, whole, expected).collect()))


def test_log_problems_shuffle_ids_once(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "call_id string")
    found = traces.log_problems(rows("a", "a", "b", "c", None), rows("a", "x", "x", None, None), rows("b", "a", "y", None))
    assert str(found._jdf.queryExecution().executedPlan()).count("Exchange ") == 1
    got = sorted((r.log, r.call_id or "", r.problem) for r in found.collect())
    assert got == sorted(
        [("calls", "b", "missing"), ("calls", "c", "missing"), ("wires", "c", "missing"), ("calls", "x", "unknown"), ("calls", "x", "unknown"), ("wires", "y", "unknown")] + [("calls", "", "unknown")] * 2 + [("wires", "", "unknown")]
    )


def test_support_follows_each_reference_once(spark, monkeypatch):
    # A chain of 30 events, of which the last is kept, beside many that nobody refers to.
    events = spark.sql("SELECT 1L AS story_id, id AS event_id, array(id) AS source_ids, CASE WHEN id BETWEEN 1 AND 30 THEN array(id - 1) ELSE CAST(array() AS array<bigint>) END AS context_ids FROM range(3000)")
    said = events.selectExpr("story_id", "event_id", "CASE event_id WHEN 30 THEN 'keep' WHEN 3 THEN 'review' ELSE 'ignore' END AS decision")
    written, real = [], reviews.scratch

    def counted(rows, label):
        out = real(rows, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(reviews, "scratch", counted)
    got = {r.event_id: (r.decision, r.support_only, r.required_by) for r in reviews.keep_support(events, said).collect()}
    assert got[30] == ("keep", False, []) and got[3] == ("review", False, []) and got[2] == ("ignore", False, []) and len(got) == 3000
    assert all(got[i] == ("keep", True, [i + 1]) for i in range(4, 30))
    assert sum(written) < 1_000


def test_spans_are_few_objects_at_a_time():
    texts = pa.array(["word and word, " * 100, None, " ,x"] * 1_000)
    tracemalloc.start()
    found = text._spans_in_pieces(texts, 180)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0].as_py()[1] == {"id": "S2", "text": "word and word,", "start": 15, "stop": 29} and found[1].as_py() == [] and len(found) == 3_000
    assert peak < 10_000_000


def test_ledgers_read_lines_once(spark, monkeypatch):
    seen, real = [], ledgers.scratch
    monkeypatch.setattr(ledgers, "scratch", lambda rows, label: seen.append(label) or real(rows, label))
    for query in (ledgers.system_scores, ledgers.evidence_scores, ledgers.review_violations):
        assert "lineitem.parquet" not in query(spark, SF)._jdf.queryExecution().optimizedPlan().toString() + "".join(query(spark, SF).inputFiles())
    assert seen == ["lines"] * 6


def test_queries_of_a_block_are_scored_in_slices():
    v = np.eye(512)[np.arange(4_096) % 512] + np.eye(4_096, 512) * 0.5
    tracemalloc.start()
    found = pd.concat(retrieval._block_best(np.arange(4_096), v, np.arange(512), v[:512], None, 1, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["query_id"].tolist() == found["vec_id"].tolist() == list(range(512))
    assert peak < 30_000_000


def test_clauses_are_cut_once(spark, monkeypatch):
    plan = texts.span_split_native(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "Filter" not in plan and "regexp" not in plan
    seen, real = [], texts.scratch
    monkeypatch.setattr(texts, "scratch", lambda rows, label: seen.append(label) or real(rows, label))
    plan = texts.coverage_accounting(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert seen == ["spans"] and "split(" not in plan and "regexp" not in plan


def test_filtered_search_lists_no_candidates(spark, monkeypatch):
    kinds, words = ["a", "b", None], ["w0", "w1", "w2", "none"]
    docs = spark.createDataFrame([(i, " ".join([words[i % 4]] * (i % 7) + ["x"] * (i % 5)), kinds[i % 3]) for i in range(600)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "w0 w1", ["a"]), (2, "w2 gone", ["a", "b"]), (3, "gone", ["b"]), (4, "w1", ["c"])], "query_id long, text string, entities array<string>")
    none = F.array().cast("array<string>")
    facts = asked.select(F.col("query_id").alias("fact_id"), "entities", none.alias("dimensions"), none.alias("times"))
    items = docs.select(F.col("doc_id").alias("item_id"), F.array("lang").alias("entities"), none.alias("dimension_tags"), none.alias("time_markers"))
    _, allowed = retrieval.candidate_items(facts, items, 20)
    allowed = allowed.withColumnsRenamed({"fact_id": "query_id", "item_id": "doc"})
    want = retrieval.bm25_top_k(asked.where("query_id < 4"), docs, 5, allowed).unionByName(retrieval.bm25_top_k(asked.where("query_id = 4"), docs, 5))
    picked, some = retrieval.candidate_kinds(facts, items, 20)
    assert some.count() == 4
    monkeypatch.setattr(retrieval, "lexical_scores", None)
    got = retrieval.ranked_within(asked, docs, picked, some, retrieval.item_kind(F.array("lang"), none, none), 5)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect()) and got.count() == 20


def test_search_report_counts_terms_in_rows(spark, monkeypatch):
    tokens = spark.createDataFrame([(["b", "a", "b"],), ([],), (["c"],)], "t array<string>")
    assert [sorted(map(tuple, r[0])) for r in tokens.select(impacts.counted(F.col("t"))).collect()] == [[("a", 1), ("b", 2)], [], [("c", 1)]]
    docs = spark.createDataFrame([(i, " ".join(["x"] * (i % 4) + ["y"] * (i % 3) + ["z"])) for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "y x y"), (2, "gone"), (3, "")], "query_id long, text string")
    want = retrieval.top_k(retrieval.lexical_scores(asked, docs, 4), "query_id", "doc", F.col("score"), 4).select("query_id", "doc", "score", "rank", "terms")
    want = sorted(want.collect())
    plans, real = {}, impacts.scratch
    monkeypatch.setattr(impacts, "scratch", lambda rows, label: plans.setdefault(label, rows._jdf.queryExecution().executedPlan().toString()) and real(rows, label))
    monkeypatch.setattr(retrieval, "lexical_scores", None)
    got = retrieval.search_report(asked, docs, 4)
    assert sorted(got.select("query_id", "doc", "score", "rank", "matched_terms").collect()) == want
    assert {r.query_id: (r.query_tokens, r.candidates) for r in got.collect()} == {1: (3, 200), 2: (1, 200), 3: (0, 200)}
    assert "Aggregate" not in plans["postings"] and "hashpartitioning" not in plans["postings"]


def test_lineage_calls_for_state_twice_a_key():
    calls, state, timers = [], {}, []

    class Value:
        def get(self):
            calls.append("get")
            return state.get("v")

        def update(self, value):
            calls.append("update")
            state["v"] = value

        def __getattr__(self, name):
            raise AssertionError(name)

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            timers.append(at)

    class At:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    machine = stateful.Lineage(10)
    machine.init(Handle())
    rows = lambda *x: iter([Row(event_id=e, at=at, failed=f) for e, at, f in x])
    told = lambda found: [tuple(r) for r in found]
    assert told(machine.handleInputRows((1,), rows((3, 6, True), (1, 0, False), (2, 5, True)), None)) == [(1, 1, "first", "ok"), (2, 2, "follow_up", "open"), (3, 3, "repeat", "open")]
    assert calls == ["get", "update"] and timers == [15]  # one timer, for the earliest failure
    assert told(machine.handleExpiredTimer((1,), At(15), At(15))) == [(2, 2, "follow_up", "lost")] and timers == [15, 16]
    assert told(machine.handleInputRows((1,), rows((4, 16, False)), None)) == [(4, 4, "repeat", "ok"), (3, 3, "repeat", "recovered")]
    assert told(machine.handleExpiredTimer((1,), At(16), At(16))) == [] and timers == [15, 16] and calls == ["get", "update"] * 4


def test_sync_leaves_texts_where_they_lie(spark, tmp_path, monkeypatch):
    plans, real = [], sync.scratch
    monkeypatch.setattr(sync, "scratch", lambda rows, label: (label == "chunks" and plans.append(rows._jdf.queryExecution().executedPlan().toString())) or real(rows, label))
    encode = lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0)))
    run = lambda most, *files: monkeypatch.setattr(sync, "MOST_FILES", most) or sync.sync(spark.createDataFrame(files, "file string, text string"), str(tmp_path), lambda f: f.withColumn("n", F.lit(0)), encode, {})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run(9, ("a", "1"), ("b", "2"), ("c", "3"), ("d", None))
        run(9, ("a", "1"), ("b", "4"), ("c", "3"), ("e", "1"))
        run(1, ("a", "1"), ("b", "4"), ("c", "5"), ("e", "1"))
        assert all("Exchange hashpartitioning" not in p for p in plans)
        run(1, ("a", "6"), ("b", "4"), ("c", "7"), ("e", "1"))
        assert len(plans) == 4 and "Exchange hashpartitioning" in plans[3]
        assert sorted((r.file, r.text) for r in sync.load(spark, str(tmp_path)).collect()) == [("a", "6"), ("b", "4"), ("c", "7"), ("e", "1")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_states_deal_no_rows_by_case(spark):
    one = lambda schema, *rows: spark.createDataFrame(rows, schema)
    gold = one("case_id long, gold_id long, dimension string, expected string, relevant array<long>, sets array<array<long>>", (1, 1, "d", "contradiction", [1], [[1]]), (1, 2, "d", "consistent", [1], []), (2, 1, "d", "contradiction", [1], [[1]]))
    events = one("case_id long, event_id long", (1, 10), (1, 11), (2, 10))
    labels = one("case_id long, event_id long, label string", (1, 10, "valid_checkable"), (1, 11, "duplicate"))
    mapping = one("case_id long, gold_id long, event_id long, ord int", (1, 1, 10, 1), (1, 1, 11, 2), (1, 2, 11, 1), (2, 1, 10, 1), (2, 1, 12, 2))
    retrieved = one("case_id long, event_id long, status string, chunks array<long>", (1, 10, "ok", [1]), (2, 10, "ok", [2]))
    judged = one("case_id long, event_id long, status string, verdict string, origin string, ord int", (1, 10, "ok", "contradiction", "model", 1), (2, 10, "error", "uncertain", "model", 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        states = scoring.case_states(gold, events, labels, mapping, retrieved, judged, 3)
        plan = states._jdf.queryExecution().executedPlan().toString()
        got = {(r.case_id, r.gold_id): (r.mapped, r.retrieval_ready, r.retrieval_ok, r.predictions) for r in states.collect()}
        lines = ledgers._lines(spark, SF).join(ledgers.table(spark, SF, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        dealt = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, 1): ([10], True, True, ["contradiction"]), (1, 2): ([], False, True, []), (2, 1): ([10], True, False, [])}
    assert re.search(r"hashpartitioning\(case_id#\d+L, event_id", plan) and not re.search(r"hashpartitioning\(case_id#\d+L, \d+\)", plan)
    assert dealt.count("Exchange hashpartitioning(l_orderkey") == 1


def test_states_of_a_dealt_ledger_shuffle_facts_and_events_once(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, real = [], ledgers.scoring.failures
    monkeypatch.setattr(ledgers.scoring, "failures", lambda states, dead, reported: plans.append(states._jdf.queryExecution().executedPlan().toString()) or real(states, dead, reported))
    try:
        ledgers.failure_causes(spark, SF)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.clearCache()
    # The ledger itself is dealt by event (REPARTITION_BY_COL, shown with each reader of it); its readers deal nothing more by event.
    assert re.search(r"hashpartitioning\(case_id#\d+L, event_id#\d+L, \d+\), REPARTITION_BY_COL", plans[0])
    assert "ENSURE_REQUIREMENTS" in plans[0] and not re.search(r"hashpartitioning\(case_id#\d+L, event_id#\d+L, \d+\), ENSURE_REQUIREMENTS", plans[0])
    assert len(re.findall(r"hashpartitioning\(case_id#\d+L, gold_id#\d+L, \d+\), \w+", plans[0].split("Initial Plan")[0])) == 2


def test_states_and_failures_of_partly_labelled_cases(spark, monkeypatch):
    one = lambda schema, *rows: spark.createDataFrame(rows, schema)
    fact = lambda case, gold, expected="contradiction": (case, gold, "d", expected, [1], [[1], [2, 3]])
    gold = one("case_id long, gold_id long, dimension string, expected string, relevant array<long>, sets array<array<long>>", fact(1, 1), fact(2, 1), fact(3, 1), fact(3, 2), fact(4, 1), fact(5, 1), fact(5, 2, "consistent"))
    # Case 1 has a label on one event only, case 2 on no emitted one; 3 has none at all, so all its events count; 4 has no events.
    events = one("case_id long, event_id long", (1, 10), (1, 11), (2, 10), (3, 10), (3, 11), (5, 10))
    labels = one("case_id long, event_id long, label string", (1, 11, "valid_checkable"), (1, 11, "valid_checkable"), (2, 99, "valid_checkable"), (5, 10, "valid_checkable"))
    mapping = one("case_id long, gold_id long, event_id long, ord int", (1, 1, 10, 1), (1, 1, 11, 2), (2, 1, 10, 1), (3, 1, 11, 1), (3, 1, 10, 2), (3, 2, 10, 1), (5, 1, 10, 1), (5, 2, 10, 1), (5, 9, 10, 1))
    retrieved = one("case_id long, event_id long, status string, chunks array<long>", (1, 11, "error", [2, 3, 1]), (3, 10, "ok", [3, 4]), (3, 11, "ok", [2, 5]), (5, 10, "ok", [9, 9, 9, 1]))
    judged = one("case_id long, event_id long, status string, verdict string, origin string, ord int", (1, 11, "ok", "consistent", "m", 1), (3, 10, "ok", "contradiction", "m", 1), (3, 11, "error", "uncertain", "m", 2), (5, 10, "ok", None, "m", 1))
    reported = one("case_id long, gold_id long, found boolean", (3, 1, True), (3, 2, False), (9, 9, False))
    dead = one("case_id long", (4,), (4,))
    want = {
        (1, 1): ([11], False, True, ["consistent"]), (2, 1): ([], False, False, []), (3, 1): ([11, 10], True, False, ["contradiction"]), (3, 2): ([10], True, False, ["contradiction"]),
        (4, 1): ([], False, False, []), (5, 1): ([10], True, False, []), (5, 2): ([10], True, False, []),
    }
    for most in (scoring.MOST_CASES, -1):
        monkeypatch.setattr(scoring, "MOST_CASES", most)
        states = scoring.case_states(gold, events, labels, mapping, retrieved, judged, 3)
        assert {(r.case_id, r.gold_id): (r.mapped, r.retrieval_ready, r.retrieval_ok, r.predictions) for r in states.collect()} == want
        lost = {(r.case_id, r.gold_id): r.cause for r in scoring.failures(states, dead, reported).collect()}
        assert lost == {(1, 1): "judge_fn", (2, 1): "extraction_miss", (3, 1): "retrieval_miss", (3, 2): "retrieval_miss", (4, 1): "execution_failure", (5, 1): "retrieval_miss"}
        found = scoring.failures(states.withColumn("retrieval_ok", F.lit(True)), dead, reported)
        assert {(r.case_id, r.gold_id): r.cause for r in found.where("case_id = 3").collect()} == {(3, 2): "report_miss"}
