"""Exact deduplication, tokenizer alignment and the prefix trie against plain re-computations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from oracle import SF, connect, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import alignment, fingerprints, prefix_trie, queries
from plumbline.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_prefix_trie"])
def test_equals_sql(spark, name):
    same(queries.QUERIES[name], queries.ORACLES[name], spark, connect())


def test_residues_compose():
    draw = random.Random(1)
    for _ in range(50):
        data = bytes(draw.randrange(256) for _ in range(draw.randint(0, 90)))
        cut = draw.randint(0, len(data))
        whole = [sum(x * pow(b, i, p) for i, x in enumerate(data)) % p for b, p in zip(fingerprints.BASES, fingerprints.PRIMES, strict=True)]
        assert fingerprints.residues(data) == fingerprints.residues(data, chunk=7) == whole
        left, right = fingerprints.residues(data[:cut]), fingerprints.residues(data[cut:], cut, 5)
        assert [(x + y) % p for x, y, p in zip(left, right, fingerprints.PRIMES, strict=True)] == whole


# Small moduli make different texts of one length share fingerprints, so that comparison has to part them.
@pytest.mark.parametrize(("chunk", "huge", "primes"), [(fingerprints.CHUNK, fingerprints.HUGE, fingerprints.PRIMES), (4, 8, (3, 5)), (3, 30, (2, 3))])
def test_exact_duplicates(spark, monkeypatch, chunk, huge, primes):
    monkeypatch.setattr(fingerprints, "PER_SALT", 5)
    draw = random.Random(2)
    texts = ["".join(draw.choice("ab \t\n") for _ in range(draw.randint(0, 5))) for _ in range(60)]
    texts += [None, "", None, " ", "\n\n", *["copy of\tone " * 9] * 40, "copy of one " * 9, "copy of  one " * 9, "ü x" * 50, "ü\x0bx" * 50, "u" * 4, "u" * 5]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(3, "same"), (3, "same"), (None, "same"), (None, "lone"), (None, "lone")]
    d = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit(1), "row": F.lit("x"), "f": F.lit(2), "n": F.lit(0)}).repartition(5)
    got = fingerprints.exact_duplicates(d, chunk, huge, primes).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        want += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert fingerprints.exact_duplicates(d.limit(0)).count() == 0


def brute_groups(text, a, b):
    """Ids of both sides on the whole text, cut where tokens of both end; None if a side does not give the text back."""
    odd = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 255 and x != 173)]
    shown = {chr(256 + i): x for i, x in enumerate(odd)} | {chr(x): x for x in range(256) if x not in odd}
    left = a.encode(" " + text, add_special_tokens=False)
    ids_b = b.encode(text)
    bytes_a = [bytes(shown[c] for c in t) for t in left.tokens]
    bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends = []
    for side in (bytes_a, bytes_b):
        total = 0
        ends.append([total := total + len(x) for x in side])
    both = set(ends[0]) & set(ends[1])
    cut = []
    for ids, at in zip((left.ids, ids_b), ends, strict=True):
        runs = [[]]
        for i, x in zip(ids, at, strict=True):
            runs[-1].append(i)
            if x in both:
                runs.append([])
        cut.append([tuple(r) for r in runs[:-1]])
    groups = list(zip(*cut, strict=True))
    return groups


def brute_align(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    cut = [(i, brute_groups(t, a, b) if t else None) for i, t in rows]
    pairs = Counter((g[0][-1], g[1][-1]) for _, gs in cut for g in gs or [])
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    out = []
    for i, gs in cut:
        if gs is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        counts = [(pairs[g[0][-1], g[1][-1]], top[g[1][-1]]) for g in gs]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(gs), sum(n == t for n, t in counts), sum(n for n, _ in counts), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def test_alignment_of_documents(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_alignment(spark, SF).collect())) == sorted(brute_align(rows))


@pytest.mark.parametrize("parts", [alignment.HOT_PARTS, 20])
def test_alignment_of_odd_texts(spark, monkeypatch, parts):
    monkeypatch.setattr(alignment, "HOT_PARTS", parts)
    draw = random.Random(4)
    odd = [" ", "  ", "   x", "x ", "x  ", "a\n b", "a \n  b", "\t", "▁", "a▁b", "<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk>", "<0x41>", "  x", "x  y", "　 z", "é e", "\x00 a", "\x1c b", "\x85 c d", "don't 'll 's", "​ x ​ y", "\U0001f600 \U0001f600\U0001f600", "日本語 テキスト", "12 345  6", "--- ...  !!", "a" * 3000, "a  b " * 2000]
    pieces = ["a", "Wort", " ", "  ", "\n", "\t", "'s", "9", "é", "́", "‍", "ß", "…", " ", "x1", "<s>"]
    odd += ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 14))) for _ in range(150)]
    rows = [*enumerate(odd), (7, "x "), (None, "x y"), (None, None), (900, ""), (901, None), (902, "x y"), (902, "x y")]
    d = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit("r"), "g": F.lit(1), "groups": F.lit(2)})
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, alignment.align(d, A, B).collect()), key=key) == sorted(brute_align(rows), key=key)
    assert alignment.align(d.limit(0), A, B).count() == 0


def test_words_stand_for_their_texts():
    both, draw, seen = alignment.TwoTokenizers(A, B), random.Random(3), 0
    pool = ["a", "Wort", "don't", "x1", "\n", "\t", "é", "…", "ß", "9", "'s", "--", "naïve", "\n\n", "the"]
    for _ in range(1_000):
        text = "".join(draw.choice(pool) + draw.choice(["", " ", " "]) for _ in range(draw.randint(1, 12)))
        words = both.words_of(text)
        if words is not None:
            both.learn(set(words))
            assert both.align(text, words) == both.align(text)
            seen += 1
    both._groups = lambda piece, of=both._groups: None if "odd" in piece else of(piece)  # a side that does not give a word back
    both.learn({"even", "odd"})
    assert both.align("even odd", ["even", "odd"]) == (0, 0, 0, "", {}) and both.align("even", ["even"])[2] > 0
    assert seen > 50 and both.words_of("two  spaces") is None and both.words_of("end ") is None


def brute_trie(rows):
    own, mark = defaultdict(list), lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, mark(role, text), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(int(c / 5) * 5, [])[:h]) + tuple(turns[h:])
    nodes = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if made[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]) if p in kids else 0, leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_trie(spark, parts):
    from plumbline.llm.common import setting

    draw, rows = random.Random(parts), []
    for c in [*range(-9, 70), 1000, 1003, 2004]:
        for t in range(draw.choice([1, 2, 3, 5, 9, 14])):
            said = draw.choice(["hi", "yes", "ü", None]) if draw.random() < 0.8 else f"t{draw.randint(0, 50)}"
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "assistant", None, ""]) if t > 3 else "user", said))
    rows += [(100 + i, t, "user", "hot") for i in range(150) for t in range(12)] + [(None, 1, "user", "x"), (5000, 0, "user", "x"), (5000, 0, "user", "x")]
    rows += [(6000, t, "user", f"long {t % 7}") for t in range(300)]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"path": F.lit(1), "depth": F.lit(2)}).repartition(3)
    with setting(spark, "spark.sql.shuffle.partitions", str(parts)):
        got = sorted((tuple(r) for r in prefix_trie.prefix_trie(d).collect()), key=str)
        assert prefix_trie.prefix_trie(d.limit(0)).count() == 0
    assert got == sorted(brute_trie(rows), key=str)


def test_unary_nodes_come_from_edges(spark):
    d = spark.createDataFrame([(0, t, "user", f"n{t}") for t in range(40)], "conv_id long, turn int, role string, text string")
    edges = prefix_trie.compressed(prefix_trie.rebuilt(d)).collect()
    assert sorted((e.depth, len(e.saved), e.n_children) for e in edges) == [(0, 1, 1), (40, 40, 0)]
