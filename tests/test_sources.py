import pytest
from pyspark.sql import functions as F

from plumbline.operators import relations
from plumbline.sources import corpus, tables
from plumbline.streaming import batching


def test_chunks_are_located(spark, tmp_path):
    text = "﻿# A\n\nfirst sentence。second。third sentence is longer。\n\n```\n# no heading\n```\n## B #\nlast"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.md").write_text(text, encoding="utf-8")
    (tmp_path / "skip.json").write_text("{}")
    files = corpus.read_files(spark, str(tmp_path))
    assert [r.file for r in files.collect()] == ["x/one.md"]
    plain = files.first().text
    rows = corpus.chunks(files, len, 32).orderBy("start").collect()
    assert all(plain[r.start : r.stop] == r.text and r.tokens <= 32 for r in rows)
    assert rows[0].headings == ["A"] and rows[-1].headings == ["A", "B"] and rows[-1].text == "last"
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert corpus.digests(spark, str(tmp_path)).count() == 1 and corpus.digests(spark, str(tmp_path), every=True).count() == 2
    made = corpus.identity(corpus.digests(spark, str(tmp_path)), {"k": "v"}).first()
    assert list(made.files) == ["x/one.md"] and len(made.sha256) == 64


def brute_chunks(file, source, count, most):
    """Chunks by the written rules: paragraphs line by line, pieces by trying every end."""
    import hashlib
    import re

    rows, path, run, at, fenced = [], [], None, 0, False
    marks = r"[。！？!?；;][”’\"」』]*|\n"

    def cut(start, end):
        titles = [t for _, t in path]
        prefix = " > ".join(titles) + "\n" if titles else ""
        size = lambda a, b: count(prefix + source[a:b])
        a = start
        while a < end:
            ends = [a + m.end() for m in re.finditer(marks, source[a:end])]
            good = [e for e in ends if size(a, e) <= most]
            b = end if size(a, end) <= most else max(good) if good else next((e - 1 for e in range(a + 1, end + 1) if size(a, e) > most), end)
            text = source[a:b]
            name = hashlib.sha256(f"{file}\0{a}\0{b}\0{text}\0{titles}".encode()).hexdigest()[:20]
            rows.append((name, text, a, b, source.count("\n", 0, a) + 1, source.count("\n", 0, b - 1) + 1, titles, size(a, b)))
            if b == end:
                return
            inner = [a + m.end() for m in re.finditer(marks, source[a:b])]
            after = re.search(r"[。！？!?；;]|\n", source[b:end])
            back = inner[-2] if len(inner) > 1 and inner[-1] == b else b
            a = back if a < back < b and size(back, b + after.end() if after else end) <= most else b

    for line in source.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        head = None if fenced or not file.endswith(".md") else re.match(r"^\s{0,3}(#{1,6})\s+(.+?)\s*$", bare)
        if head or not bare.strip():
            if run:
                cut(*run)
            run = None
            if head:
                path[:] = [x for x in path if x[0] < len(head[1])] + [(len(head[1]), re.sub(r"\s+#+\s*$", "", head[2]))]
        else:
            run = (run[0] if run else at, at + len(bare))
        fenced ^= file.endswith(".md") and bool(re.match(r"^\s{0,3}(`{3,}|~{3,})", bare))
        at += len(line)
    if run:
        cut(*run)
    return rows


def test_chunks_equal_the_rules(spark):
    import random

    draw = random.Random(5)
    bits = ["# A\n", "## B ##\n", "### C\n", "#nope\n", "```\n", "~~~x\n", "\n", "  \n", "one。two！”three\n", "a b c d e f g h\n", "long" * 12 + "\n", "end；" * 6 + "\n", " ## D\n", "x\x0by\u2028z\n", "。。\n", "word"]
    files = [(f"f{i}.{'md' if i % 4 else 'txt'}", "".join(draw.choice(bits) for _ in range(draw.randint(0, 25)))) for i in range(60)]
    got = {}
    for r in corpus.chunks(spark.createDataFrame(files, "file string, text string"), len, 40).collect():
        got.setdefault(r.file, []).append((r.chunk_id, r.text, r.start, r.stop, r.start_line, r.stop_line, r.headings, r.tokens))
    want = {f: rows for f, t in files if (rows := brute_chunks(f, t, len, 40))}
    assert {f: sorted(rows, key=lambda x: x[2:4]) for f, rows in got.items()} == {f: sorted(rows, key=lambda x: x[2:4]) for f, rows in want.items()}
    with pytest.raises(Exception, match="headings fill"):
        corpus.chunks(spark.createDataFrame([("a.md", "# " + "h" * 50 + "\ntext")], "file string, text string"), len, 40).collect()


def test_publish_and_load(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    d = spark.range(10).withColumn("v", F.col("id") * 2)
    first = tables.publish(d, folder, "id")
    assert tables.publish(d.where("id < 3"), folder, "id") != first
    assert tables.load(spark, folder).count() == 3
    with pytest.raises(ValueError):
        tables.publish(d.union(d), folder, "id")


def test_records_reject_repeats(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    tables.write_records(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), path)
    with pytest.raises(ValueError):
        tables.read_records(spark, path, "k int, v string", ["k"])
    assert tables.read_records(spark, path, "k int, v string", ["k", "v"]).count() == 2


def test_only_failed_rows_are_called_again(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(prompts):
        seen.add(len(prompts))
        return [(p.upper(), None) if p != "bad" else (None, "failed") for p in prompts]

    d = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, prompt string").coalesce(1)
    got = {r.id: (r.reply, r.error, r.attempt) for r in batching.call_model(d, model).collect()}
    assert got == {1: ("A", None, 1), 2: (None, "failed", 2), 3: ("C", None, 1)} and seen.value == 4


def test_slots(spark):
    r = spark.createDataFrame([(1, i, 0.0, 2.0) for i in range(3)], "run long, id long, arrival double, seconds double")
    s = batching.slot_summary(batching.slots(r, 2), 2).first()
    assert (s.makespan, s.utilisation, s.waited_max) == (4.0, 0.75, 2.0)


def test_a_wrong_correction_is_an_error(spark):
    rows = spark.createDataFrame([(1, "s", "old")], "k int, s string, label string")
    fix = lambda s: spark.createDataFrame([(1, s, "new")], "k int, s string, label string")
    assert relations.correct(rows, fix("s"), "k", "s", "label").first().label == "new"
    with pytest.raises(Exception, match="correction does not match"):
        relations.correct(rows, fix("t"), "k", "s", "label").collect()
