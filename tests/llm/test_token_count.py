from hypothesis import given
from hypothesis import strategies as st

from plumbline.llm import token_count

PIECES = ["▁", "▁a", "▁ab", "▁abc", "a", "b", "ab", "abcd", "bcx", "cde", "é"]


def brute(word):
    at = total = 0
    while at < len(word):
        piece = max((p for p in PIECES if word.startswith(p, at)), key=len, default=None)
        total, at = (total + 1, at + len(piece)) if piece else (total + len(word[at].encode()), at + 1)
    return total


@given(st.text(alphabet="abcdexé日", max_size=40))
def test_counts_equal_greedy_segmentation(word):
    assert token_count.LongestMatch(PIECES).count("▁" + word) == brute("▁" + word)


def test_documents(spark, tmp_path):
    path = tmp_path / "pieces.txt"
    path.write_text("\n".join(PIECES), encoding="utf-8")
    long = "abcd " * 50_000
    d = spark.createDataFrame([(1, "abc  de\tx"), (2, None), (3, " \n"), (4, ""), (5, long), (5, long)], "doc_id long, text string").selectExpr("*", "7 AS n_words")
    got = [(r.doc_id, r.n_words, r.n_tokens) for r in token_count.count_tokens(d, str(path)).orderBy("doc_id").collect()]
    want = [(1, 3, sum(map(brute, ("▁abc", "▁de", "▁x")))), (2, 0, 0), (3, 0, 0), (4, 0, 0), *[(5, 50_000, 50_000 * brute("▁abcd"))] * 2]
    assert got == want
    assert token_count.count_tokens(d.limit(0), str(path)).count() == 0
