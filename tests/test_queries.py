import pytest
from oracle import SF, connect, same

from plumbline.functions.text import _spans_of
from plumbline.plans import catalog, texts, tracks


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name], spark, con)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_pairs_go_to_120(spark, tmp_path):
    spark.createDataFrame([(c, t) for c, n in ((1, 8), (2, 17)) for t in range(n)], "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = tracks.pair_checks(spark, str(tmp_path)).collect()
    assert sorted((r.first, r.second) for r in got if r.conv_id == 1) == [(a, b) for a in range(8) for b in range(a + 1, 8)]
    assert sorted((r.first, r.second) for r in got if r.conv_id == 2) == [(a, b) for a in range(17) for b in range(a + 1, 17)][:120]


def test_windows_of_whole_documents(spark, tmp_path):
    long = " ".join(f"clause {'x' * (i * 7 % 90)}," + ("\n" if i % 11 == 0 else "") for i in range(3000))
    rows = [(1, long), (2, "a, b. c"), (3, ""), (4, None), (5, "y" * 1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        spans, parts = [(s[0], len(s[1])) for s in _spans_of(text, 180)], []
        for name, size in spans:
            if not parts or len(parts[-1]) >= 8 or sum(n for _, n in parts[-1]) + size > 180:
                parts.append([])
            parts[-1].append((name, size))
        names = [s for s, _ in spans]
        for k, part in enumerate(parts):
            first = names.index(part[0][0])
            want.append((doc, k + 1, ",".join(s for s, _ in part), ",".join(names[max(0, first - 2) : first])))
    assert sorted(map(tuple, texts.greedy_windows(spark, str(tmp_path)).collect())) == want and len(want) > 700


def test_a_prefix_is_no_quote(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(30))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"see {text} end"), (2, text[:100] + " but goes on")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in texts.quote_grounding(spark, str(tmp_path)).collect()] == [1]
