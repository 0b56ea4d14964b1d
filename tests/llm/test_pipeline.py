import pytest
from oracle import SF, connect, same

import corpus_pipeline
from plumbline.llm import minhash, queries
from plumbline.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name], queries.ORACLES[name], spark, connect())


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents").cache()
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    one = corpus_pipeline.near_dedup(spark, docs.union(docs.limit(3)), SF).cache()
    assert one.columns == docs.columns and one.groupBy("doc_id").count().where("count > 1").count() == 0
    left = minhash.near_duplicates(one)
    assert left.where("NOT kept").count() == 0 and one.count() == minhash.near_duplicates(docs).where("kept").count()
    clean = corpus_pipeline.decontaminate(spark, docs, SF)
    assert clean.columns == docs.columns and queries.op6_decontamination(spark, SF).where("NOT contaminated").count() == clean.count()
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns
    counts = [r["count"] for r in corpus_pipeline.shard(spark, docs, SF).groupBy("shard").count().collect()]
    assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1


def test_one_row_of_each_group_stays(spark):
    long = lambda *last: " ".join([*(f"w{i}" for i in range(60)), *last])
    other = lambda *last: " ".join([*(f"v{i}" for i in range(60)), *last])
    rows = [(1, long("a")), (1, long("b")), (None, other("a")), (None, other("b")), (None, other("b")), (2, ""), (2, ""), (None, " ")]
    rows += [(3, "alone here"), (3, "alone here"), (None, "not " + long("c")), (5, None)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    words = [(r.doc_id, r.text) for r in kept if (r.text or "").strip()]
    assert len(words) == 3 and {r[0] for r in words} == {1, None, 3} and len([r for r in kept if not (r.text or "").strip()]) == 4


def test_run_goes_through_all_stages(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) > 100 and list(out.columns[:1]) == ["doc_id"]
    sizes = out.groupby("shard").size().reindex(range(corpus_pipeline.SHARDS), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    docs = {r.doc_id for r in table(spark, SF, "documents").collect()}
    assert set(out.doc_id) <= docs
    leaks = {r.doc_id for r in queries.op6_decontamination(spark, SF).where("contaminated").collect()}
    assert leaks and not leaks & set(out.doc_id)


ODD = [(1, None, None, None, None), (None, "", "", "", 0), (2, "word " * 60_000, "en", "src0", 7), (2, "word " * 60_000, "en", "src0", 7), (None, "one two", None, "src1", 1), (3, "\ud7ff é \x02", "xx", None, 1)]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    got = f(spark, docs, SF)
    assert stage == "sharding" or got.columns == docs.columns
    assert 0 < got.count() <= 2 * len(ODD)
    assert f(spark, docs.limit(0), SF).count() == 0
    clash = docs.withColumns({"row": docs.doc_id, "words": docs.text, "node": docs.doc_id, "size": docs.doc_id, "target": docs.doc_id, "hub": docs.doc_id, "component": docs.doc_id, "block": docs.doc_id})
    more = f(spark, clash, SF)
    assert more.count() == got.count() and (stage == "sharding" or more.columns == clash.columns)
