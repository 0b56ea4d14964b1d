"""Token counts, offsets and chunks that keep a budget."""

import pytest
from oracle import SF
from pyspark.sql import functions as F

from plumbline.functions import tokens
from plumbline.plans.base import table
from plumbline.sources import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_offsets_cover_texts(spark):
    texts = ["", None, "plain words, twice", "é ü \U0001f600 日本", "a\n\n b", "<|endoftext|> x"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in d.withColumn("o", tokens.offsets(F.col("text"), PATH)).collect():
        text, seen = r.text or "", [False] * len(r.text or "")
        for a, b in r.o:
            seen[a:b] = [True] * (b - a)
        assert all(seen) and (not r.o or (r.o[0].start, r.o[-1].stop) == (0, len(text)))
        assert len(r.o) + 2 == tokens.TokenCounter(PATH)(text)
    got = {r.id: (r.tokens, r.truncated, r.cut_at) for r in tokens.inspect(d, PATH, 5).collect()}
    assert got[0] == (2, False, 0) == got[1] and got[2] == (6, True, len("plain words,")) and got[5][1]
    asked = tokens.inspect(d.where("id = 2"), PATH, 5, prefix="find: ").first()
    assert asked.truncated and asked.tokens == tokens.TokenCounter(PATH)("find: plain words, twice") and asked.cut_at == len("plain")


def test_chunks_keep_the_budget(spark):
    d = table(spark, SF, "documents").where("text IS NOT NULL AND n_chars < 4000").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "text")
    counter = tokens.TokenCounter(PATH)
    made = corpus.chunks(d, counter, 200)
    told = tokens.inspect(made.select("file", "embedding_text", "text", F.col("tokens").alias("said")), PATH, 200, text="embedding_text")
    rows = told.agg(F.count("*").alias("n"), F.max("tokens").alias("most"), F.count_if("truncated").alias("cut"), F.count_if(F.col("tokens") != F.col("said")).alias("wrong")).first()
    assert rows.n > d.count() and rows.most <= 200 and (rows.cut, rows.wrong) == (0, 0)
