from pyspark.sql import functions as F

from plumbline.operators import retrieval
from plumbline.plans import ranking


def test_dense_ties_keep_corpus_order(spark):
    v = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = retrieval.dense_top_k(v, q, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 1.0), (0, 0.0)]


def test_fusion_order_and_weight(spark):
    ranked = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc string, rank int")
    got = lambda **w: [r.doc for r in retrieval.fuse(ranked("abc"), ranked("bda"), 5, **w).orderBy("rank").collect()]
    assert got()[:2] == ["b", "a"]
    assert got(first_weight=4.0)[0] == "a"


def test_bm25_ranks_documents_without_a_match(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha", "beta", "gamma"])], "doc_id long, text string")
    q = spark.createDataFrame([(1, "gamma"), (2, "nothing")], "query_id long, text string")
    got = {(r.query_id, r["rank"]): (r.doc, r.score > 0) for r in retrieval.bm25_top_k(q, d, 3).collect()}
    assert [got[1, i] for i in (1, 2, 3)] == [(2, True), (0, False), (1, False)]
    assert [got[2, i] for i in (1, 2, 3)] == [(0, False), (1, False), (2, False)]


def test_filter_ladder(spark):
    none = []
    facts = spark.createDataFrame(
        [(1, "ann", none, "", ["space"], ["y1"]), (2, "zed", none, "", none, none), (3, None, none, "saw bob", none, none)],
        "fact_id long, subject string, actors array<string>, text string, dimensions array<string>, times array<string>",
    )
    items = spark.createDataFrame(
        [("c1", ["ann"], ["time"], none), ("c2", ["ann"], ["space"], ["y1"]), ("c3", ["bob"], ["space"], none), ("c4", none, none, none)],
        "item_id string, entities array<string>, dimension_tags array<string>, time_markers array<string>",
    )
    hinted = retrieval.filter_hints(facts, spark.createDataFrame([("ann",), ("bob",)], "name string"))
    got = lambda n: {r.fact_id: (r.level, r.fallback, r.candidates) for r in retrieval.select_candidates(hinted, items, n).collect()}
    assert got(1) == {1: ("entity+dimension+time", False, 1), 2: ("all", False, 4), 3: ("entity", False, 1)}
    assert got(3)[1] == ("entity|dimension", True, 3)


def test_retrieval_scores(spark):
    rows = spark.createDataFrame(
        [(["a"], ["a", "x"], ["a", "x"]), (["b", "c"], ["b", "x"], ["b", "c", "x"])], "expected array<string>, retrieved array<string>, candidates array<string>"
    )
    r = rows.agg(*retrieval.retrieval_scores(rows, 2)).first()
    assert (r.complete_recall, r.micro_recall, r.pool_recall, r.mrr) == (0.5, round(2 / 3, 6), 1.0, 1.0)
    assert rows.select(F.size("expected")).count() == 2


def test_cells_rank_beyond_the_nearest(spark):
    near = [(i, 1, [1.0, 0.0]) for i in range(1, 61)]
    far = [(100 + i, 2, [0.0, 1.0 - i / 100]) for i in range(6)]
    v = spark.createDataFrame([*near, *far, (0, 2, [1.0, 0.0]), (200, None, [1.0, 0.0]), (300, 2, None)], "vec_id long, label int, embedding array<float>")
    got = {r["filter"]: r for r in ranking.cells(v, v.where("vec_id = 0")).collect()}
    assert got["on"].mean_candidates == 7 and got["off"].mean_candidates == 68
    assert got["on"].complete_recall == 1 and got["on"].micro_recall == 1
    assert got["off"].complete_recall == 0 and got["off"].micro_recall == round(1 / 3, 6) and got["off"].pool_recall == 1
