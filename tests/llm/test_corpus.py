import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontam, kneser_ney, mixing, sharding, substring

DOCS = "doc_id long, text string"


def brute_repeats(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("window", "anchor", "most"), [(12, 4, 2000), (12, 4, 3), (7, 1, 50)])
def test_repeats_equal_brute_force(spark, window, anchor, most):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("abcd"[: draw.randint(1, 4)]) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "a " * 50, "a " * 50, *["x y z " * 3 + "q w e r t y u i o p"] * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    d = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("x"))
    got = sorted(tuple(r) for r in substring.remove_repeats(d, window, anchor, most).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], window), strict=True))
    assert substring.remove_repeats(d.limit(0), window).count() == 0


@pytest.mark.parametrize("most", [100, 0])
def test_benchmark_windows_by_both_ways(spark, most):
    bench = spark.createDataFrame([(1, "A b, c d e"), (2, "c d e f"), (2, "c d e f"), (3, "Zz"), (4, None), (None, "é x"), (10, "b c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a B c D y"), (2, "zz-zz"), (3, None), (4, "..."), (5, "É X é x"), (5, "q"), (5, "q"), (6, "pad " * 3_000 + "c d e")], DOCS).withColumn("words", F.lit(1))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.report(docs, bench, 3, most).collect()))
    assert got == [(1, 6, 4, 2, True), (2, 2, 2, 1, True), (3, 0, 0, 0, False), (4, 0, 0, 0, False), (5, 1, 0, 0, False), (5, 1, 0, 0, False), (5, 4, 2, 0, True), (6, 3_003, 3, 2, True)]
    assert sorted(r.doc_id for r in decontam.remove_documents(docs, bench, window=3, most_hashes=most).collect()) == [3, 4, 5, 5]
    clean = {r.doc_id: r.clean for r in decontam.remove_spans(docs.where("doc_id = 1"), bench, window=3, most_hashes=most).collect()}
    assert clean == {1: "x y"}
    assert decontam.report(docs.limit(0), bench).count() == 0
    assert decontam.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_texts_are_split_once(spark):
    bench = spark.createDataFrame([(1, "b c d"), (2, "q")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "pad " * 200_000 + "b c d " * 500, "w", 1, 2)], "doc_id long, text string, words string, hits int, clean int")
    splits = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    assert splits(decontam.hits(docs.select("doc_id", "text"), bench, 3)) == splits(decontam.remove_spans(docs, bench, 3).where("length(clean) > 0")) == 2
    spans, left = decontam.remove_spans(docs, bench, 3), decontam.remove_documents(docs.unionByName(docs.withColumn("text", F.lit("pad"))), bench, 3)
    assert spans.columns == docs.columns and left.columns == docs.columns and [r.words for r in left.collect()] == ["w"]
    assert spans.first().clean.split() == ["pad"] * 200_000


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in free}
        target |= {s: most * sizes[s] for s in full}
        rest -= sum(most * sizes[s] for s in full)
        free -= full
    return target


def test_mix_meets_its_targets(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "b", "é", None, "c"]) if i % 3 else "a", " ".join(["w"] * int(draw.paretovariate(1) * 3))) for i in range(600)]
    rows += [(1000, "d", None), (1001, "e", ""), (1002, "a", "w " * 5000), (3, rows[3][1], rows[3][2])]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x"))
    got = mixing.mix(d).select("doc_id", "source", "size", "target", "source_size", "copies").collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = fill(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and r.source_size == sizes[s] and 0 <= r.copies <= 2 for r in own)
        assert abs(sum(r.copies * r["size"] for r in own) - want[s]) <= 0.01 * want[s] + 2
    again = mixing.mix(d.repartition(3)).select("doc_id", "source", "size", "target", "source_size", "copies").collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)
    assert mixing.expand(mixing.mix(d)).count() == sum(r.copies for r in got)
    assert mixing.mix(d.limit(0)).count() == 0


def test_shards_are_even_and_keep_links(spark):
    rows = [(i, f"text {i % 40}" if i < 160 else f"own {i}") for i in range(700)] + [(9000 + i, "hot") for i in range(300)] + [(None, None), (None, ""), (5, "é")]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS).withColumn("hub", F.lit(1)), 7).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(7)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(v == list(range(len(v))) for v in by.values())
    places = {}
    for r in got:
        if r.doc_id is not None and r.doc_id < 160:
            places.setdefault(r.doc_id % 40, set()).add(r.shard)
    assert sum(len(p) == 1 for p in places.values()) >= 36
    assert {r["size"] for r in got if r.doc_id is None} == {8}
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), 3).count() == 0


def kn(counts, order):
    """Interpolated modified Kneser-Ney by definition, on dictionaries."""
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1

    def cut(k, n):
        m = [sum(v == i for v in levels[k].values()) for i in range(5)]
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else 0.5
        i = min(n, 3)
        est = i - (i + 1) * y * m[i + 1] / m[i] if m[i] else 0.5 * i
        return min(max(est, 0.1), 0.95 * i)

    def p(g):
        k = len(g)
        near = {x: n for x, n in levels[k].items() if x[:-1] == g[:-1]}
        if not near:
            return p(g[1:])
        total, back = sum(near.values()), sum(cut(k, n) for n in near.values())
        own = max(0, near[g] - cut(k, near[g])) if g in near else 0
        return own / total + back / total * (p(g[1:]) if k > 1 else 1 / (len(near) + 1))

    return p


def test_model_equals_definition(spark):
    import math

    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "cats and dogs sat"]
    d = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    counts = kneser_ney.count_grams(d, 3)
    rows = {r.gram: r.n for r in counts.collect()}
    want = {}
    for t in texts:
        s = kneser_ney.START * 2 + t + kneser_ney.END
        for i in range(2, len(s)):
            want[s[i - 2 : i + 1]] = want.get(s[i - 2 : i + 1], 0) + 1
    assert rows == want
    grams = [*list(want)[:20], "thx", "xth", "qqq", kneser_ney.START * 2 + "z"]
    got = {r.gram: r.bits for r in kneser_ney.bits(spark.createDataFrame([("en", g) for g in grams], "lang string, gram string"), kneser_ney.train(counts, 3)).collect()}
    p = kn(want, 3)
    assert all(abs(got[g] + math.log2(p(g))) < 1e-9 for g in grams)


def test_classifier_keeps_clean_text(spark):
    draw = random.Random(2)
    syllables = ["the", "an", "er", "in", "on", "tion", "ly"]
    prose = lambda n: " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(80), "en") for i in range(200)] + [(500 + i, prose(60).upper().replace(" ", "!! "), "en") for i in range(20)]
    rows += [(600, None, "en"), (601, "", "en"), (602, "???", "xx"), (603, "the", None), (1, rows[1][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit(0))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(0, 1, 0), (510, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert len(got) == len(rows) - 1
    assert all(got[i].accepted for i in [*range(200), 600, 601, 602, 603]) and not any(got[500 + i].accepted for i in range(20))
    assert got[602].perplexity is None and got[1].perplexity > 1
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0
    assert kneser_ney.classify(docs, labels.limit(0)).where("NOT accepted").count() == 0


def test_odd_trusted_text_opens_no_gate(spark):
    draw = random.Random(4)
    prose = lambda syllables, n: " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 3))) for _ in range(n))
    en, de = ["the", "an", "er", "in", "on", "tion", "ly"], ["ich", "ung", "ver", "ge", "st", "ein"]
    rows = [(i, prose(en, 80), "en") for i in range(300)] + [(1000 + i, prose(de, 80), "de") for i in range(30)]
    rows += [(1500, prose(de, 40) + " " + prose(en, 80), "de")] + [(2000 + i, prose(de, 60) + " " + prose(en, 60), "de") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:331]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.accepted for r in kneser_ney.classify(docs, labels).collect()}
    assert not any(got[2000 + i] for i in range(10)) and not got[1500]
    assert sum(not got[i] for i in range(300)) <= 6 and all(got[1000 + i] for i in range(30))


def test_equal_blocks_are_scored(spark):
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(1, "same text", "en")] * 2, 2), "doc_id long, text string, lang string")
    assert docs.rdd.getNumPartitions() == 2
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(docs, labels).collect()
    assert len(got) == 2 and all(r.accepted for r in got) and got[0].perplexity == got[1].perplexity
