"""The registered queries against plain re-computations, on whole small tables."""

import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from oracle import SF
from pyspark.sql import functions as F
from test_corpus import fill, kn
from test_near import Roots, brute
from tokenizers import Tokenizer

from plumbline.llm import kneser_ney, queries
from plumbline.llm.common import table


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality(spark, tmp_path):
    import random

    draw, en, de = random.Random(7), ["the", "an", "er", "in"], ["ich", "ung", "ver"]
    prose = lambda parts, n: " ".join(draw.choice(parts) + draw.choice(parts) for _ in range(n))
    rows = [(i, prose(en, draw.randint(1, 30)), "en") for i in range(60)] + [(100 + i, prose(de, 12), "de") for i in range(25)]
    rows += [(200, "QXZ !! | ## 77 " * 9, "en"), (201, None, "en"), (202, "x\ufdd0\x02y", "de"), (203, "the", None), (204, "", ""), (205, "zz", "fr")]
    labels = [(r[0], 1, 0) for r in rows[:80]] + [(3, 0, 0), (5, 1, 1), (200, 0, 0)]
    d, y = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    y.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op2_quality(spark, str(tmp_path)).collect()}
    fold = {r.doc_id: r.f for r in y.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(kneser_ney.HELD_OUT)).alias("f")).collect()}
    good = {i for i, _, _ in labels[:80]} - {3, 5}

    def grams(text):
        s = kneser_ney.START * 2 + (text or "").replace(kneser_ney.START, "\ufffd") + kneser_ney.END
        return [s[i - 2 : i + 1] for i in range(2, len(s))]

    models, score = {}, {}
    for lang in ("en", "de"):
        counts = Counter(g for i, t, x in rows if x == lang and i in good and fold[i] for g in grams(t))
        models[lang] = kn(counts, 3)
    for i, t, lang in rows:
        if lang in models:
            g = grams(t)
            score[i] = (lang, len(g), -sum(math.log2(models[lang](x)) for x in g))
    held = [i for i in good if not fold[i]]
    mean = {x: sum(score[i][2] for i in held if score[i][0] == x) / sum(score[i][1] for i in held if score[i][0] == x) for x in models}
    cell = lambda i: math.ceil((score[i][2] + 200 * mean[score[i][0]]) / (score[i][1] + 200) * 2000)
    rank = lambda values, p: sorted(values)[max(0, math.ceil(p * len(values)) - 1)]
    median = {x: rank([cell(i) for i in held if score[i][0] == x], 0.5) for x in models}
    spread = rank([cell(i) - median[score[i][0]] for i in held], min(1 - kneser_ney.TAIL, (len(held) - 1.5) / len(held)))
    for i, _, lang in rows:
        r = got[i]
        if i not in score:
            assert (r.perplexity, r.threshold, r.accepted, r.lang) == (None, None, True, lang)
            continue
        _, n, bits = score[i]
        limit = (median[lang] + spread) / 2000 + kneser_ney.MARGIN
        assert r.n == n and abs(r.perplexity - 2 ** (bits / n)) < 1e-6 * r.perplexity
        most = limit + 200 * (limit - mean[lang]) / n
        assert abs(math.log2(r.threshold) - min(most, 1000)) < 1e-3 and (r.accepted == (bits / n <= most) or abs(bits / n - most) < 1e-3)
    assert not got[200].accepted and sum(not got[i].accepted for i in good) <= 4


def test_links_of_vectors(spark, tmp_path):
    draw, rows = np.random.default_rng(11), []
    for label in (1, 2, None):
        hot = draw.normal(size=24)
        for _ in range(150):  # one large group, many of it equal
            rows.append((hot + draw.normal(size=24) * draw.choice([0, 0, 0.02, 0.12]), label))
        for _ in range(25):
            base = draw.normal(size=24)
            rows += [(base + draw.normal(size=24) * 0.1, label) for _ in range(4)]
    rows = [(i, v.astype(np.float32).tolist(), x) for i, (v, x) in enumerate(rows)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    roots, links = Roots(), dict.fromkeys(range(len(rows)), 0)
    for i, _, _ in rows:
        roots.find(i)
    for label in (1, 2):
        ids = [i for i, _, x in rows if x == label]
        u = np.array([rows[i][1] for i in ids], dtype=np.float64)
        u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1)), strict=True):
            roots.join(ids[a], ids[b])
            links[ids[a]] += 1
            links[ids[b]] += 1
    got = sorted(tuple(r) for r in queries.op3_embedding_dedup(spark, str(tmp_path)).collect())
    assert got == [(i, links[i], roots.find(i), roots.find(i) == i) for i in range(len(rows))] and sum(links.values()) > 5_000


def test_mix(spark, docs):
    size = {r.doc_id: len(words(r.text)) for r in docs}
    per = Counter()
    for r in docs:
        per[r.source] += size[r.doc_id]
    want, taken = fill(dict(per)), Counter()
    got = queries.op4_mixing(spark, SF).collect()
    source = {r.doc_id: r.source for r in docs}
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and abs(r.target - want[s]) < 1e-6 * want[s] and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 for s in per)


def test_near_duplicates(spark, docs):
    got = sorted(tuple(r) for r in queries.op5_near_dedup(spark, SF).collect())
    assert got == brute([(r.doc_id, r.text) for r in sorted(docs)], 2) and sum(not r[3] for r in got) > 5


def test_shards(spark, docs):
    got = queries.op8_sharding(spark, SF).collect()
    text = {r.doc_id: r.text for r in docs}
    assert sorted(r.doc_id for r in got) == sorted(text)
    shards, where = {s: [] for s in range(queries.SHARDS)}, {}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        shards[r.shard].append(r.slot)
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    counts = [len(v) for v in shards.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert all(r.cut == (len(where[text[r.doc_id]]) > 1) for r in got)


def test_token_ids(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op9_shards(spark, SF).collect()) == want


def test_token_counts(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    longest, known = max(map(len, pieces)), {}

    def count(word):
        at = total = 0
        while at < len(word):
            n = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in pieces), 0)
            total, at = (total + 1, at + n) if n else (total + len(word[at].encode()), at + 1)
        return total

    for r in queries.op10_token_counts(spark, SF).collect():
        w = words(next(d.text for d in docs if d.doc_id == r.doc_id))
        for x in set(w) - set(known):
            known[x] = count("\u2581" + x)
        assert (r.n_words, r.n_tokens) == (len(w), sum(known[x] for x in w))
