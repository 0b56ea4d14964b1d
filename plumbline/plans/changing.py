"""Queries over what changes: indexes that follow their sources, archives, streams with keyed state, stages that resume."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import documents
from plumbline.plans.base import registry, table
from plumbline.session import shared_dir
from plumbline.sources import archives, sync
from plumbline.streaming import batching, ledger, stateful

QUERIES, ORACLES, query = registry()
CHUNK = 1_000


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _windows(files: DataFrame) -> DataFrame:
    """file, n, text: pieces of CHUNK characters."""
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / CHUNK).cast("int")
    each = files.where("text IS NOT NULL").select("file", "text", F.explode(F.sequence(F.lit(0), last)).alias("n"))
    return each.select("file", "n", F.substring("text", F.col("n") * CHUNK + 1, F.lit(CHUNK)).alias("text"))


def _vowels(texts: list[str]) -> np.ndarray:
    """A stand-in for an encoder: one and the counts of three letters."""
    return np.array([[1, t.count("a"), t.count("e"), t.count("i")] for t in texts], dtype=float)


@query(f"""
WITH old AS (SELECT doc_id, CASE WHEN lang = 'en' THEN text || ' ' || source ELSE text END AS text FROM documents WHERE lang <> 'fr' AND text IS NOT NULL),
new AS (SELECT doc_id, text FROM documents WHERE lang <> 'es' AND text IS NOT NULL),
cut AS (SELECT doc_id, n, substr(text, n * {CHUNK} + 1, {CHUNK}) AS t FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0) // {CHUNK})) AS n FROM new)),
held AS (SELECT DISTINCT substr(text, n * {CHUNK} + 1, {CHUNK}) AS t FROM (SELECT text, unnest(generate_series(0, greatest(length(text) - 1, 0) // {CHUNK})) AS n FROM old)),
v AS (SELECT doc_id, n, t, length(t) - length(replace(t, 'a', '')) AS a, length(t) - length(replace(t, 'e', '')) AS e, length(t) - length(replace(t, 'i', '')) AS i FROM cut)
SELECT doc_id AS file, CAST(n AS INTEGER) AS n, round(CAST(a / sqrt(1 + a * a + e * e + i * i) AS FLOAT), 5) AS a, round(CAST(e / sqrt(1 + a * a + e * e + i * i) AS FLOAT), 5) AS e, t NOT IN (SELECT t FROM held) AS encoded,
  (SELECT count(DISTINCT t) FROM cut WHERE t NOT IN (SELECT t FROM held)) AS encoded_texts
FROM v
""")
def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of one snapshot of the documents brought up to date with another: French texts are added, Spanish ones removed, English ones changed at
    their ends. The index equals a rebuild, and only texts that the old one lacked are encoded."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "lang", "text", "source")
    old = docs.where("lang <> 'fr'").select("file", F.when(F.col("lang") == "en", F.concat_ws(" ", "text", "source")).otherwise(F.col("text")).alias("text"))
    folder, encode = _place(spark, "index"), lambda rows: batching.encode(rows, "text", _vowels)
    first = sync.sync(old.where("text IS NOT NULL"), folder, _windows, encode, {"encoder": "vowels"})
    told = sync.sync(docs.where("lang <> 'es' AND text IS NOT NULL").select("file", "text"), folder, _windows, encode, {"encoder": "vowels"})
    rows = sync.load(spark, folder, {"encoder": "vowels"})
    # A chunk of a document that did not change stands in the first segment; its text was there before.
    new = F.col("encoded") & ~F.col("segment").isin(first["segments"])
    vector = [F.round(F.get("embedding", F.lit(i)), 5).alias(c) for i, c in ((1, "a"), (2, "e"))]
    return rows.select("file", "n", *vector, new.alias("encoded"), F.lit(told["encoded"]).cast("long").alias("encoded_texts"))


@query("SELECT lang, source, count(*) AS n, count(text) AS texts, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, count(DISTINCT md5(text)) AS different FROM documents GROUP BY lang, source")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into archives of JSON lines and read back through the archive source."""
    folder = _place(spark, "archives")
    archives.write_archives(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), folder, member_rows=200)
    found = archives.members(spark, folder, archiveGlob="part-*", memberGlob="*.jsonl")
    rows = archives.json_rows(found, "doc_id long, lang string, source string, text string")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_distinct(F.md5("text")).alias("different"))


def _arrivals(events: DataFrame, folder: str, number: Column, files: int) -> DataFrame:
    """Write events as files that arrive one after another, by ``number``, and read them as a stream of one file at a time."""
    for i in range(files):
        # The files' times are their order.
        events.where(number == i).coalesce(1).write.parquet(f"{folder}/arrived={i}")
    return events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed FROM events),
w AS (SELECT *, lag(failed) OVER p AS before_failed, row_number() OVER p AS attempt_no,
  min(CASE WHEN NOT failed THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ok FROM e WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(attempt_no AS INTEGER) AS attempt_no, CASE WHEN before_failed IS NULL THEN 'first' WHEN before_failed THEN 'repeat' ELSE 'follow_up' END AS cost_class,
  CASE WHEN NOT failed THEN 'ok' WHEN epoch_ms(next_ok) - epoch_ms(ts) <= 6 * 3600000 THEN 'recovered' ELSE 'lost' END AS outcome FROM w
""")
def stream_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of users over a stream of events in four files, with keyed state; a failure is given six hours to recover."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = _place(spark, "lineage")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()  # one row
    edges = [span["a"] + (span["b"] - span["a"]) * i / 4 for i in (1, 2, 3)]
    stream = _arrivals(events, f"{folder}/arrivals", sum((F.col("ts") >= F.lit(e)).cast("int") for e in edges), 4)
    stateful.write_lineage(stream, folder, "user_id", "event_type = 'error'", "6 hours")
    return stateful.settled(spark.read.parquet(f"{folder}/rows"))


FILES = 6

# The rule of late rows: a file's rows count in windows that end after the watermark which the file before the last one left.
ARRIVAL_SQL = f"""
WITH span AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
e AS (SELECT epoch_us(ts) AS t, event_type, least({FILES - 1}, (epoch_us(ts) - a) * {FILES} // (b - a + 1) + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END) AS f FROM events, span),
marks AS (SELECT f, max(max(t)) OVER (ORDER BY f) - 600000000 AS mark FROM e GROUP BY f),
w AS (SELECT e.*, t // 3600000000 * 3600000000 AS start, coalesce(mark, 0) AS mark FROM e LEFT JOIN marks ON marks.f = e.f - 2),
kept AS (SELECT start, event_type, count(*) AS n FROM w WHERE start + 3600000000 > mark GROUP BY ALL)
SELECT CAST(make_timestamp(start) AS VARCHAR) AS start, event_type, n, CASE WHEN start + 3600000000 <= (SELECT max(mark) FROM marks) THEN 'closed' ELSE 'open' END AS state FROM kept
UNION ALL SELECT NULL, NULL, count(*), 'late' FROM w WHERE start + 3600000000 <= mark
"""


@query(ARRIVAL_SQL)
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of events that arrive in six files, one in seven of them two files late: windows are appended when the watermark closes them, and late
    rows are counted."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    span = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()  # one row
    at = F.expr(f"(unix_micros(ts) - {span['a']}) * {FILES} div {span['b'] - span['a'] + 1}") + F.when(F.col("event_id") % 7 == 0, 2).otherwise(0)
    folder = _place(spark, "append")
    stream = _arrivals(events, f"{folder}/arrivals", F.least(F.lit(FILES - 1), at), FILES)
    stateful.write_windows(stream, folder, "1 hour", "10 minutes", "event_type")
    out = stateful.window_report(spark, folder, events, "event_type")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _strict(prompts: list[str]) -> list[str]:
    """A stand-in for a model that one prompt in some fifty breaks at the first try."""
    if any(hashlib.md5(p.encode()).hexdigest() < "05" for p in prompts):
        raise ValueError("out of memory")
    return _lenient(prompts)


def _lenient(prompts: list[str]) -> list[str]:
    return [f"{len(p)} {hashlib.md5(p.encode()).hexdigest()}" for p in prompts]


@query("""
SELECT conv_id * 1000 + turn AS id, length(text) || ' ' || md5(text) AS reply, CAST(NULL AS VARCHAR) AS error, count(*) OVER () AS asked FROM conversations WHERE text IS NOT NULL
""")
def resumed_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model stage over all turns that stops at the first prompts it cannot take and goes on in a second run: every turn is answered once, and asked
    once but for those that stopped it."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    jobs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"))
    folder, identity = _place(spark, "stage"), "turns"
    try:
        ledger.run_stage(jobs, _strict, folder, identity, batch=1, batch_jobs=1_000_000)
    except ledger.Stopped:
        pass
    done = ledger.run_stage(jobs, _lenient, folder, identity)
    told = ledger.ledger(spark, folder)
    asked = told.groupBy("job").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "failed").alias("failed"))
    counted = asked.agg(F.sum(F.col("n") - F.col("failed")).alias("asked"))
    return done.select("id", "reply", "error").join(F.broadcast(counted))  # one row


REPORT_SQL = """
WITH g AS (SELECT lang, count(*) AS n, count(text) AS texts, avg(length(text)) AS mean FROM documents GROUP BY lang),
s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) AS p FROM documents GROUP BY source),
e AS (SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS high, row_number() OVER (ORDER BY count(*) DESC, event_type) AS p FROM events GROUP BY event_type),
t AS (SELECT count(*) AS n, count(text) AS texts FROM documents)
SELECT 0 AS section, 0 AS part, 0 AS place, '# The collection' AS line
UNION ALL SELECT 0, 1, 0, printf('%d documents, %d with a text (%.2f%%).', n, texts, 100.0 * texts / n) FROM t
UNION ALL SELECT 1, 0, 0, '## By language' UNION ALL SELECT 1, 1, 0, '| Language | Documents | Texts | Mean length |' UNION ALL SELECT 1, 1, 1, '|---|---:|---:|---:|'
UNION ALL SELECT 1, 1, 1 + row_number() OVER (ORDER BY lang NULLS FIRST), printf('| %s | %d | %d/%d | %.4f |', coalesce(lang, 'N/A'), n, texts, n, mean) FROM g
UNION ALL SELECT 2, 0, 0, '## By source' UNION ALL SELECT 2, 1, p, printf('- %s: %d', coalesce(source, 'N/A'), n) FROM s
UNION ALL SELECT 3, 0, 0, '## Events' UNION ALL SELECT 3, 1, p, printf('%d. %s: %d, high %d', p, event_type, n, high) FROM e
UNION ALL SELECT 3, 2, 1, '- none'
"""


@query(REPORT_SQL)
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report document over documents and events, line by line."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    by = lambda k: d.groupBy(k).agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.avg(F.length("text")).alias("mean"))
    all_ = d.agg(F.count("*").alias("n"), F.count("text").alias("texts"))
    kinds = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high")).withColumn("fewer", -F.col("n"))
    none = e.where("event_type IS NULL").groupBy("event_type").agg(F.count("*").alias("n"))
    name = documents.words("event_type")
    report = documents.Document(
        "The collection",
        (
            documents.Section("By language", (documents.Table(by("lang"), (("Language", documents.words("lang"), False), ("Documents", documents.whole("n"), True), ("Texts", documents.share("texts", "n"), True), ("Mean length", documents.number("mean"), True)), ("lang",)),)),
            documents.Section("By source", (documents.Items(by("source"), F.concat(documents.words("source"), F.lit(": "), documents.whole("n")), ("source",)),)),
            documents.Section("Events", (documents.Items(kinds, F.concat(name, F.lit(": "), documents.whole("n"), F.lit(", high "), documents.whole("high")), ("fewer", "event_type"), numbered=True), documents.Items(none, name, ("event_type",)))),
        ),
        intro=(documents.Note((documents.whole("n"), " documents, ", documents.whole("texts"), " with a text (", documents.percent(F.col("texts") / F.col("n")), ")."), all_),),
    )
    return documents.lines(spark, report)
