"""What changes: impact-ordered search, index sync, archives, keyed streams, stages that resume."""

import json
import math
import os
import random
import sys
import zipfile
from collections import Counter

import numpy as np
import pytest
from oracle import SF, connect, plain
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline.operators import impacts, retrieval
from plumbline.plans import tracks
from plumbline.plans.base import table
from plumbline.sources import archives, stores, sync
from plumbline.streaming import batching, ledger, stateful

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not find the tests


def brute_bm25(docs, asked, k, ones=False):
    words = {d: t.split() for d, t in docs}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean, out = sum(map(len, words.values())) / len(words), {}
    for q, terms in asked:
        scored = []
        for d, ws in words.items():
            tf, s = Counter(ws), 0.0
            for t in terms:
                if tf[t]:
                    s += 1.0 if ones else math.log1p((len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ws) / mean))
            scored.append((-round(s, 6), d))
        out[q] = [(d, -s) for s, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("ones", [False, True])
def test_impact_search_equals_brute_force(spark, block, ones):
    draw = random.Random(block)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i * 3, " ".join(draw.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=draw.randint(0, 40)))) for i in range(250)]
    docs += [(1_000 + i, docs[5][1]) for i in range(12)]  # ties
    asked = [(q, draw.sample(vocabulary, draw.randint(1, 6)) + ["none"]) for q in range(40)] + [(90, ["none"]), (91, [])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = impacts.build(d, block=block)
    q = spark.createDataFrame(asked, "query_id long, terms array<string>")
    got = {}
    for r in retrieval._ranked(index, q, d, 4, "doc_id", ones).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc, r.score))
    assert {q: [(d, s) for _, d, s in sorted(v)] for q, v in got.items()} == brute_bm25(docs, asked, 4, ones)
    most = impacts.search(index, q, 4, ones).withColumn("p", F.spark_partition_id()).groupBy("p", "query_id").count().agg(F.max("count")).first()[0]
    assert most <= 4
    small = impacts.build(d, spark.createDataFrame([("w3",), ("w9",)], "term string"), block=block)
    assert {r.term for r in small.select("term").distinct().collect()} == {"w3", "w9"}


def test_blocks_are_skipped():
    best = impacts.Best(2, ones=False)
    asked = [{"query_id": 1, "terms": ["a", "b"], "floor": 0.0}]
    block = lambda *w: (["a"], np.array([max(w)]), np.array([0, len(w)]), np.arange(len(w)) + 10 * best.walked, np.array(w))
    best.block(*block(5.0, 4.0, 1.0), asked)
    best.block(*block(3.0, 2.0), asked)  # cannot reach the second best
    best.block(*block(4.0, 0.5), asked)  # can tie with it
    assert (best.walked, best.skipped) == (2, 1) and [tuple(x.tolist()) for x in best.held[1]] == [(5.0, 4.0), (0, 1)]
    best.block(*block(6.0), [{"query_id": 2, "terms": ["a"], "floor": 7.0}])
    assert best.skipped == 2


def lengths(texts):
    return np.array([[1, len(t), t.count("x")] for t in texts], dtype=float)


def test_sync_follows_its_source(spark, tmp_path):
    folder, calls = f"{tmp_path}/index", f"{tmp_path}/calls"
    os.mkdir(calls)
    cut = lambda files: files.select("file", F.posexplode(F.split("text", "\n")).alias("n", "text"))

    def told(texts):
        for t in texts:
            with open(f"{calls}/{abs(hash(t))}-{os.getpid()}-{random.random()}", "w") as f:
                f.write(t)
        return lengths(texts)

    def run(files, encoder=told, config=None):
        for f in os.listdir(calls):
            os.remove(f"{calls}/{f}")
        d = spark.createDataFrame(list(files.items()), "file string, text string")
        out = sync.sync(d, folder, cut, lambda rows: batching.encode(rows, "text", encoder), config or {"model": "m"})
        return out, sorted(open(f"{calls}/{f}").read() for f in os.listdir(calls))

    def rows():
        return sorted((r.file, r.n, r.text, [round(x, 5) for x in r.embedding]) for r in sync.load(spark, folder).collect())

    def rebuilt(files):
        v = lambda t: [round(float(np.float32(x)), 5) for x in (lengths([t])[0] / np.sqrt((lengths([t])[0] ** 2).sum()))]
        return sorted((f, n, t, v(t)) for f, text in files.items() for n, t in enumerate((text or "").split("\n") if text is not None else []))

    with pytest.raises(ValueError, match="no index"):
        sync.load(spark, folder)
    files = {"a": "one\ntwo x", "b": "two x\nthree", "c": "four"}
    out, asked = run(files)
    assert rows() == rebuilt(files) and asked == ["four", "one", "three", "two x"] and out["encoded"] == 4
    files = {"a": "one\ntwo x", "b": "three\nfive\none", "d": "four\nsix"}
    out, asked = run(files)
    assert rows() == rebuilt(files) and asked == ["five", "six"] and out["changes"] == {"added": 1, "changed": 1, "removed": 1, "same": 1}
    assert len(out["segments"]) == 2 and run(files) == (out, [])
    with pytest.raises(ValueError, match="another configuration"):
        run(files, config={"model": "other"})
    told_ = sync.compact(spark, folder)
    assert rows() == rebuilt(files) and len(told_["segments"]) == 1
    files["e"] = "seven"
    assert run(files)[1] == ["seven"] and rows() == rebuilt(files)

    d = spark.createDataFrame([("z", "new")], "file string, text string")
    before = rows()
    with pytest.raises(stores.Conflict):

        def late(rows):
            made = batching.encode(rows, "text", lengths)
            stores.replace_text(spark, f"{folder}/CURRENT", told_["version"])
            return made

        sync.sync(d, folder, cut, late, {"model": "m"})
    assert rows() != before and {r[0] for r in rows()} == {"a", "b", "d"}


def test_archives(spark, tmp_path):
    lines = "\n".join(json.dumps({"k": i, "t": "é" * i}) for i in range(5)).encode()
    for name, files in {"one": [("a/x.jsonl", lines), ("a/y.txt", b"plain")], "two": [("z.jsonl", lines + b"\n\n")]}.items():
        (tmp_path / f"{name}.zip").write_bytes(archives.pack(files))
    found = archives.members(spark, str(tmp_path), partBytes=1)
    assert found.rdd.getNumPartitions() == 3 and {(r.member, r["size"]) for r in found.collect()} == {("a/x.jsonl", len(lines)), ("a/y.txt", 5), ("z.jsonl", len(lines) + 2)}
    rows = archives.json_rows(archives.members(spark, f"file:{tmp_path}", memberGlob="*.jsonl"), "k int, t string")
    assert sorted((r.line, r.k, len(r.t)) for r in rows.collect()) == sorted([(i + 1, i, i) for i in range(5)] * 2)
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        archives.json_rows(archives.members(spark, str(tmp_path), memberGlob="*.txt"), "k int").collect()
    data = bytearray((tmp_path / "one.zip").read_bytes())
    data[data.index(b"plain") if b"plain" in data else 70] ^= 255
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.zip").write_bytes(data)
    (bad / "no.zip").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no archive|x.zip"):
        archives.members(spark, str(bad)).collect()
    got = {(r.archive.rsplit("/", 1)[1], r.error) for r in archives.members(spark, str(bad), strict=False).collect()}
    assert ("no.zip", "unreadable") in got and ("x.zip", "unreadable") in got


def test_frozen_snapshots(spark, tmp_path):
    import hashlib

    digest = lambda b: hashlib.sha256(b).hexdigest()

    def freeze(name, files, listed=None, archive=None, manifest=None):
        (tmp_path / name).mkdir()
        data = archives.pack(files)
        (tmp_path / name / "snapshot.zip").write_bytes(data)
        told = {"format_version": 2, "files": listed or {n: digest(b) for n, b in files}, "archive_sha256": archive or digest(data)}
        (tmp_path / name / "manifest.json").write_text(manifest or json.dumps(told))

    files = [("a.py", b"1"), ("b/c.md", "é".encode())]
    freeze("good", files)
    freeze("hash", files, {"a.py": digest(b"2"), "b/c.md": digest("é".encode()), "gone": digest(b"")})
    freeze("more", [*files, ("../up", b"x"), ("new", b"y")], {n: digest(b) for n, b in files})
    freeze("archive", files, archive="0" * 64)
    freeze("none", files, manifest='{"files": 3}')
    freeze("broken", files, manifest="{")
    (tmp_path / "lost").mkdir()
    (tmp_path / "lost" / "manifest.json").write_text(json.dumps({"files": {"a": digest(b"")}, "archive_sha256": "1"}))
    got = {r.freeze: (r.status, r.files, r.archive_ok, r.changed) for r in archives.verify(spark, str(tmp_path)).collect()}
    assert got["good"] == ("ok", 2, True, [])
    assert got["hash"] == ("error", 3, True, ["archive:hash:a.py", "archive:missing:gone"])
    assert got["more"] == ("error", 2, True, ["archive:unexpected:new", "archive:unsafe:../up"])
    assert got["archive"] == ("error", 2, False, [])
    assert got["none"] == ("error", 0, False, ["manifest:invalid_files"]) == got["broken"]
    assert got["lost"] == ("error", 1, False, ["archive:missing:a"])
    assert len(zipfile.ZipFile(tmp_path / "good" / "snapshot.zip").namelist()) == 2


def test_lineage_goes_on_after_a_restart(spark, tmp_path):
    events = table(spark, SF, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    days = F.dayofmonth("ts")

    def arrive(i, rows):
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        stateful.write_lineage(stream, f"{tmp_path}/out", "user_id", "event_type = 'error'")

    arrive(0, events.where(days <= 7))
    arrive(1, events.where(days.between(8, 15)))
    run()
    first = spark.read.parquet(f"{tmp_path}/out/rows").count()
    arrive(2, events.where(days > 15))
    run()
    run()  # nothing new
    told = spark.read.parquet(f"{tmp_path}/out/rows")
    assert 0 < first < told.count() == told.distinct().count()
    want = plain(connect().execute(tracks.ORACLES["attempt_lineage"]).df())
    assert plain(stateful.settled(told).toPandas()) == want


def test_a_stage_asks_each_job_once(spark, tmp_path):
    jobs = spark.createDataFrame([(i, f"prompt {i}", "x") for i in range(60)], "id long, prompt string, job_kind string").repartition(4)
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(breaks):
        def answer(prompts):
            for p in prompts:
                with open(f"{calls}/{os.getpid()}-{random.random()}", "w") as f:
                    f.write(p)
            if any(p.endswith(breaks) for p in prompts):
                raise MemoryError("full")
            return [p.upper() for p in prompts]

        return answer

    asked = lambda: Counter((calls / f).read_text() for f in os.listdir(calls))
    with pytest.raises(ledger.Stopped):
        ledger.run_stage(jobs, model(("17", "33")), f"{tmp_path}/stage", "run", batch=1, batch_jobs=25)
    before = asked()
    assert 0 < len(before) < 60 and set(before.values()) == {1}
    stopped = {r.job for r in ledger.ledger(spark, f"{tmp_path}/stage").where("state = 'failed'").collect()}
    got = ledger.run_stage(jobs, model(("nothing",)), f"{tmp_path}/stage", "run", batch=4, batch_jobs=25)
    rows = {r.id: r for r in got.collect()}
    assert {i: r.reply for i, r in rows.items()} == {i: f"PROMPT {i}" for i in range(60)} and rows[3].job_kind == "x" and all(r.error is None for r in rows.values())
    assert sorted(asked().values()) == [1] * (60 - len(stopped)) + [2] * len(stopped) and 1 <= len(stopped) <= 2
    again = ledger.run_stage(jobs, model(("",)), f"{tmp_path}/stage", "run")
    assert again.where("reply IS NULL").count() == 0 and sum(asked().values()) == 60 + len(stopped)
    with pytest.raises(ValueError, match="another run"):
        ledger.run_stage(jobs, model(("",)), f"{tmp_path}/stage", "other")
    lost = None
    while lost is None:  # jobs behind the one that failed in its task are asked by the next run
        try:
            lost = ledger.run_stage(jobs.where("id < 3"), model(("1",)), f"{tmp_path}/lost", "run", batch=1, attempts=1, batch_jobs=100)
        except ledger.Stopped:
            pass
    told = {r.id: (r.reply, r.error, r.attempt) for r in lost.collect()}
    assert told[1] == (None, "MemoryError: full", 1)
