import pytest
from pyspark.sql import functions as F

from plumbline.operators import datasets, lore, reviews, scoring
from plumbline.sources import stores, tables
from plumbline.streaming import windows

CHUNKS = "chunk_id string, file string, heading_path array<string>, text string"


def test_entries_commit_against_a_revision(spark, tmp_path):
    store = stores.EntryStore(spark, f"file://{tmp_path}/entries")
    chunks = spark.createDataFrame([("c1", "a.md", ["x", "Ann", "skill"], "Ann flies"), ("c2", "a.md", ["Ann"], "no")], CHUNKS)
    proposed, known, revision = store.preview("Ann", "skill", "Ann swims\nwell", chunks, "2063年")
    assert revision == "empty" and [(r.source, r.same_category) for r in known.collect()] == [("c1", True)]
    first = store.commit(proposed, revision)
    with pytest.raises(stores.Conflict):
        store.commit(proposed, revision)
    with pytest.raises(ValueError, match="already stored"):
        store.commit(proposed, first)
    second, known, revision = store.preview("Ann", "home", "Ann lives here", chunks)
    assert revision == first and {r.category for r in known.collect()} == {"skill"}
    store.commit(second, first)
    assert [(r.entity, r.event_time) for r in store.read().orderBy("created_at").collect()] == [("Ann", "2063年"), ("Ann", None)]
    path = f"file://{tmp_path}/out.md"
    store.export(path)
    assert stores.read_text(spark, path) == stores.ENTRY_HEAD + "\n\n## Ann\n### skill\n\n    事件时间：2063年\n    Ann swims\n    well\n\n## Ann\n### home\n\n    Ann lives here\n"
    stores.replace_text(spark, path, "by hand")
    with pytest.raises(ValueError, match="by hand"):
        store.export(path)
    with pytest.raises(ValueError, match="broken entry"):
        store.preview("A\nB", "c", "t", chunks)
    assert not list((tmp_path / "entries").glob("*.lock*"))


def test_records_are_kept_all_or_none(spark, tmp_path):
    store = stores.WorldStore(spark, f"file://{tmp_path}/world")
    fields = "kind string, entity string, entity_type string, category string, text string, target string, time string, valid_from string, valid_until string"
    good = ("attribute", "Ann", None, "skill", "Ann flies", None, None, None, None)
    rows = spark.createDataFrame([good, ("rule", None, None, "law", "nobody swims", None, None, None, None)], fields)
    catalog = lore.catalog(spark.createDataFrame([("c1", "a.md", ["x", "Ann", "skill"], "t")], CHUNKS), spark.createDataFrame([], "id string, " + fields))
    proposed, known, revision = store.preview(rows, "Ann flies; nobody swims", catalog)
    assert [r.source for r in known.collect()] == ["c1"]
    store.commit(proposed, revision)
    assert store.read().count() == 2
    again, _, revision = store.preview(spark.createDataFrame([good, ("event", None, None, "e", "Ann", None, None, None, None)], fields), "Ann flies; nobody swims", catalog)
    with pytest.raises(ValueError, match="already stored"):
        store.commit(again, revision)
    assert store.read().count() == 2
    with pytest.raises(ValueError, match="broken record"):
        store.preview(rows, "another text", catalog)
    store.export(f"file://{tmp_path}/world.md")
    text = stores.read_text(spark, f"file://{tmp_path}/world.md")
    assert "## 世界规则\n### law\n\n    条目类型：rule\n    nobody swims\n" in text and "    主体：Ann\n" in text
    assert {(r.kind, r.label) for r in lore.catalog_names(spark.createDataFrame([("c", "f", ["2063年", "z"], "t")], CHUNKS), store.read()).collect()} == {("time", "2063年"), ("name", "Ann")}


def test_versions_have_manifests(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    tables.publish(spark.range(5), folder, "id", {"model": "a"})
    assert tables.load(spark, folder, {"model": "a"}).count() == 5
    with pytest.raises(ValueError, match="another configuration"):
        tables.load(spark, folder, {"model": "b"})
    spark.range(1).write.mode("append").parquet(tables.current(spark, folder))
    with pytest.raises(ValueError, match="manifest"):
        tables.load(spark, folder)
    tables.write_records(spark.range(3), f"file://{tmp_path}/rows")
    tables.write_records(spark.range(2), f"file://{tmp_path}/rows")
    assert tables.read_records(spark, f"file://{tmp_path}/rows", "id long", ["id"]).count() == 2
    tables.write_csv(spark.range(2).withColumn("x", F.lit("a")), f"file://{tmp_path}/csv", ["x"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["x"]
    assert tables.new_rows(spark.range(2), spark.range(5, 6).toDF("id"), ["id"]).count() == 2


def test_index_of_a_collection(spark, tmp_path):
    (tmp_path / "lore").mkdir()
    (tmp_path / "lore" / "a.md").write_text("# A\n\ntext", encoding="utf-8")
    unit = lambda c: c.withColumn("embedding", F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>"))
    folder = f"file://{tmp_path}/index"
    tables.build_index(spark, f"file://{tmp_path}/lore", folder, len, unit, {"model": "m"}, 100)
    assert [r.text for r in tables.load(spark, folder).collect()] == ["text"]
    with pytest.raises(ValueError, match="unit vector"):
        tables.build_index(spark, f"file://{tmp_path}/lore", folder, len, lambda c: c.withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0))), {}, 100)


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id long, v string")
    windows.append_new(rows(1, 2, 2), 0, path, ["id"])
    windows.append_new(rows(2, 3), 1, path, ["id"])
    windows.append_new(rows(2, 3), 1, path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_decisions_meet_what_is_pending(spark):
    ledger = spark.createDataFrame([(1, 1, "pending", []), (1, 2, "valid_checkable", [7])], "case_id long, event_id long, label string, gold_ids array<long>")
    gold = spark.createDataFrame([(1, 7)], "case_id long, gold_id long")
    say = lambda *rows: spark.createDataFrame(rows, "case_id long, event_id long, label string, gold_ids array<long>, note string")
    got = {r.event_id: (r.label, r.gold_ids, r.note) for r in reviews.decided(ledger, say((1, 1, "valid_checkable", [7], "seen")), gold).collect()}
    assert got == {1: ("valid_checkable", [7], "seen"), 2: ("valid_checkable", [7], None)}
    with pytest.raises(Exception, match="not pending"):
        reviews.decided(ledger, say((1, 1, "valid_checkable", [7], "seen"), (1, 2, "duplicate", [], "n")), gold).collect()
    for bad, why in [((1, 1, "odd", [], "n"), "label"), ((1, 1, "duplicate", [7], "n"), "invalid event"), ((1, 1, "duplicate", [], " "), "note"), ((1, 1, "valid_checkable", [8], "n"), "gold")]:
        with pytest.raises(Exception, match=why):
            reviews.decided(ledger, say(bad), gold).collect()
    with pytest.raises(Exception, match="undecided"):
        reviews.decided(ledger, say(), gold).collect()


def test_candidates_and_their_decisions(spark):
    c = spark.createDataFrame([("s", "F1"), ("s", "F2"), ("s", "F3")], "story_id string, id string")
    d = spark.createDataFrame([("s", "F1", True), ("s", "F2", False), ("s", "F2", True), ("s", "F9", True)], "story_id string, id string, keep boolean")
    states, issues = reviews.importance_review(c, d)
    assert {r.id: r.state for r in states.collect()} == {"F1": "kept", "F2": "pending", "F3": "pending"}
    assert {r.id: r.issue for r in issues.collect()} == {"F2": "repeated decision", "F3": "no decision", "F9": "unknown candidate"}


def test_resumed_runs_have_no_gaps(spark):
    cases = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "case_id string, ord int")
    done = lambda *ids: spark.createDataFrame([(i,) for i in ids], "case_id string")
    assert [r.case_id for r in reviews.prefix_done(cases, done("a")).collect()] and reviews.prefix_done(cases, done("a", "b")).first().case_id == "c"
    with pytest.raises(ValueError, match="first ones"):
        reviews.prefix_done(cases, done("b"))
    assert [r.k for r in reviews.unprefixed(spark.createDataFrame([("candidate:x",), ("base:y",)], "k string"), "k").collect()] == ["x"]


def test_gates(spark):
    row = lambda h, b, u: spark.createDataFrame([(h, b, u)], "hits int, hallucinated int, uncovered int")
    status = lambda c, pending=0: scoring.quality_gate(row(10, 2, 0), c, pending).first().status
    assert [status(row(9, 2, 0)), status(row(8, 2, 0)), status(row(10, 3, 0)), status(row(10, 2, 1)), status(row(10, 2, 0), 1)] == ["pass", "fail", "fail", "fail", "pending_review"]
    scores = spark.createDataFrame([(0.5, 1.0)], "recall double, precision double")
    assert scoring.lower_bound(scores, F.lit(False)).first().reviewed_lower_bound_recall == 0.5


def test_old_gold_is_upgraded(spark):
    old = spark.createDataFrame(
        [("c", "G1", "Ann", "flies", None, "location", "矛盾", ("Ann", 0, 3), [], ["x"], [["x"]]), ("c", "G2", "Bob", "sits", "here", "location", "不确定", ("Bob", 0, 3), [], [], None)],
        "case_id string, gold_id string, subject string, predicate string, object string, type string, verdict string, anchor struct<text: string, start: int, stop: int>, context_anchors array<struct<text: string, start: int, stop: int>>, evidence array<string>, sets array<array<string>>",
    )
    facts = datasets.upgraded_facts(old)
    assert {r.gold_id: (r.normalized_fact, r.reportable, r.sets) for r in facts.collect()} == {"G1": ("Annflies", True, [["x"]]), "G2": ("Bobsitshere", False, [])}
    found = datasets.conflict_findings(facts).collect()
    assert [(r.finding_id, r.gold_ids) for r in found] == [("F1", ["G1"])]
    assert datasets.finding_problems(datasets.conflict_findings(facts), facts).count() == 0
    story = "Ann" + "x" * 250
    cases = spark.createDataFrame([("c", "one_conflict", story, 253, ["physical_rule"]), ("d", "odd", "short", 9, ["taste"])], "case_id string, grp string, story string, character_count int, dimensions array<string>")
    ignored = spark.createDataFrame([("c", ("Ann", 0, 3), "p", "routine")], "case_id string, anchor struct<text: string, start: int, stop: int>, proposition string, reason string")
    bad = {(r.case_id, r.rule) for r in datasets.case_problems(cases, facts, datasets.conflict_findings(facts), ignored).collect()}
    assert bad == {("c", "ignored fact"), ("d", "length"), ("d", "character_count"), ("d", "group"), ("d", "dimensions")}
    chunks = spark.createDataFrame([("x",), ("y",)], "chunk_id string")
    curated = spark.createDataFrame([("Bobsitshere", ["y", "y"], "because")], "normalized_fact string, lore array<string>, rationale string")
    none = spark.createDataFrame([], "normalized_fact string, verdict string, rationale string")
    items = {r.fixture_id: (r.expected, r.lore, r.source) for r in datasets.oracle_items(facts, curated, none, chunks).collect()}
    assert items == {"OR-c-G1": ("矛盾", ["x"], "minimum_evidence_set"), "OR-c-G2": ("不确定", ["y"], "manual_curation")}
    with pytest.raises(Exception, match="no evidence"):
        datasets.oracle_items(facts, curated.limit(0), none, chunks).collect()
    odd = spark.createDataFrame([("f", "矛盾", ["a", "a"], ["b"]), ("g", "矛盾", ["a"], [])], "fixture_id string, expected string, lore array<string>, canonical array<string>")
    assert {(r.fixture_id, r.rule) for r in datasets.fixture_problems(odd, 2, 5).collect()} == {("f", "lore"), ("f", "canonical"), ("g", "evidence"), (None, "balance of 一致"), (None, "balance of 不确定")}
    assert datasets.distribution_problems(odd, "expected", {"矛盾": 2}).count() == 0
    short = spark.createDataFrame([("s", ["a。"])], "k string, s array<string>").select(datasets.built_story(F.col("s")).alias("t")).first().t
    assert len(short) >= 205 or len(short) >= len(datasets.STORY_HEAD + datasets.STORY_FILL + datasets.STORY_TAIL)


def test_metadata_of_a_collection(spark):
    c = spark.createDataFrame([("c1", "人物.md", 1, 2, ["人物", "安娜", "x"], "安娜与贝拉"), ("c2", "a.md", 1, 2, ["x", "贝拉", "y"], "2063年")], "chunk_id string, file string, start_line int, end_line int, heading_path array<string>, text string")
    items = lore.metadata(c)
    assert {r.chunk_id: (r.domain, r.entities, r.time_markers) for r in items.collect()} == {"c1": ("character", ["安娜", "贝拉"], []), "c2": ("other", ["贝拉"], ["2063年"])}
    assert lore.metadata_digest(items).first() == lore.metadata_digest(items.repartition(3)).first()
    assert {(r.chunk_id, r.problem) for r in lore.metadata_problems(items.where("chunk_id = 'c1'").union(items.where("chunk_id = 'c1'")), c).collect()} == {("c1", "twice"), ("c2", "missing")}
    words = spark.createDataFrame([("贝拉",), ("无",)], "word string")
    assert [(r.word, r.chunk_id) for r in lore.first_mentions(words, c.withColumn("ord", F.col("chunk_id"))).collect()] == [("贝拉", "c1")]
