import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import components, grid_join, minhash


class Roots(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def brute(rows, width):
    roots, sets = Roots(), [(i, sets_of(t, width)) for i, t in rows]
    for n, (i, s) in enumerate(sets):
        roots.find(i)
        for j, t in sets[:n]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                roots.join(i, j)
    return sorted((i, len(s), roots.find(i), roots.find(i) == i) for i, s in sets)


def test_near_duplicates_equal_brute_force(spark):
    draw, rows = random.Random(5), []
    for group in range(12):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(3, 90))]
        for _ in range(draw.randrange(1, 14)):
            words = list(base)
            for _ in range(draw.randrange(0, 1 + len(words) // 12)):
                words[draw.randrange(len(words))] = f"x{draw.randrange(5000)}"
            rows.append((len(rows), draw.choice([" ", "\n "]).join(words).upper() if draw.random() < 0.3 else " ".join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \t", "one", "One", "É", "é", "two words"])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    got = sorted(tuple(r) for r in minhash.near_duplicates(d, width=2).drop("row").collect())
    assert got == brute(rows, 2)


def test_repeats_nulls_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z"), (3, "q " * 30_000), (4, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), (r.component_id or -1), r.kept) for r in minhash.near_duplicates(d, width=2).collect())
    assert got == [(-1, -1, True), (-1, 1, False), (1, 1, True), (1, 1, True), (3, 3, True), (4, 4, True)]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_many_null_ids(spark):
    draw, texts = random.Random(9), []
    for _ in range(1_000):
        words = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(["x", *words[1:]])]  # 58 of 60 pairs of words are common
    d = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    names = d.selectExpr("xxhash64(doc_id, text) AS row", "text")
    got = {r.text: (r.component, r.n_shingles) for r in minhash.near_duplicates(d, width=2, named=True).join(names, "row").collect()}
    assert len(got) == 2_000 and all(got[a] == got[b] and got[a][1] == 59 for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert len({c for c, _ in got.values()}) == 1_000


def test_signatures_in_pieces(monkeypatch):
    s = minhash.shingles(" ".join(f"w{i * 7919 % 1_000_003}" for i in range(300_000)).encode(), 2)
    a, b, step = minhash._constants()
    v = s[:, None] * a + b
    v ^= v >> np.uint64(32)
    assert (minhash._signature(s) == (v * step).min(axis=0)).all() and len(s) > 4 * minhash.PIECE


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1040)] + [(5, 5), (2, 9), (9, 4), (4, 2)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = Roots()
    for a, b in links:
        want.join(a, b)
    assert got == {x: want.find(x) for x in list(want) if x != 5}


def test_vectors_equal_brute_force(spark):
    draw, rows = np.random.default_rng(3), []
    for label in (1, 2):
        for _ in range(40):
            base = draw.normal(size=16)
            for _ in range(int(draw.integers(1, 6))):
                rows.append((len(rows), (base + draw.normal(size=16) * draw.choice([0, 0.05, 0.2])).astype(np.float32).tolist(), label))
    rows += [(len(rows) + i, v, x) for i, (v, x) in enumerate([(rows[0][1], 1), (rows[0][1], None), (None, 1), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([None] * 16, 1), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("x"))
    roots, links = Roots(), dict.fromkeys(range(len(rows)), 0)
    ok = [(i, np.array(v, dtype=np.float64), x) for i, v, x in rows if x is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i, _, _ in rows:
        roots.find(i)
    for n, (i, u, x) in enumerate(ok):
        for j, v, y in ok[:n]:
            if x == y and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                roots.join(i, j)
                links[i] += 1
                links[j] += 1
    got = sorted(tuple(r) for r in grid_join.near_duplicates(d, block=16).collect())
    assert got == [(i, links[i], roots.find(i), roots.find(i) == i) for i in range(len(rows))]
    assert grid_join.near_duplicates(d.limit(0)).count() == 0


def test_a_cluster_of_unlinked_texts_costs_a_link_a_text(spark, monkeypatch):
    draw, base, texts = random.Random(3), [f"w{i}" for i in range(200)], []
    for i in range(400):
        words = list(base)
        for k in draw.sample(range(200), 5):
            words[k] = f"x{i}y{k}"
        texts.append((i, " ".join(words)))
    sent, real = [], minhash.components

    def counted(links):
        links = minhash.store(links, "counted")
        sent.append(links.distinct().count())
        return real(links)

    monkeypatch.setattr(minhash, "components", counted)
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(d, width=5).drop("row").collect())
    assert got == brute(texts, 5)
    assert sum(sent) <= 2 * len(texts)


def test_join_sides_are_sent_by_measured_sizes_only(spark):
    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(key)
    from plumbline.llm.common import measured_joins

    measured_joins(lambda rows: seen.append((spark.conf.get(key), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold"))))(spark.range(1))
    assert seen == [("-1", before)] and spark.conf.get(key) == before and minhash.MOST_IDS <= 500_000


def test_tables_of_one_node_are_read_once(spark, monkeypatch):
    made = []
    for module in (minhash, components):
        real = module.store

        def seen(rows, label, real=real):
            if "explode" in rows._jdf.queryExecution().optimizedPlan().toString():
                made.append(label)
            out = real(rows, label)
            if label == "mh-shared":
                assert out.count() == out.join(out.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").count()
            return out

        monkeypatch.setattr(module, "store", seen)
    d = spark.sql("SELECT id AS doc_id, concat_ws(' ', transform(sequence(1, 40), i -> concat('w', i + 1000 * (id % 150)))) || ' end' || id AS text FROM range(200)")
    assert minhash.near_duplicates(d, width=2).where("kept").count() == 150
    assert made == ["mh-shared"]
