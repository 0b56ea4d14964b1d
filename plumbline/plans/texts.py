"""Queries for text functions, spans, coverage, digests and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import callable, rules, text as fn, wire
from plumbline.functions.shapes import let
from plumbline.operators import checks, relations, retrieval, sequences
from plumbline.plans.base import registry, table
from plumbline.sources.scratch import scratch

QUERIES, ORACLES, query = registry()

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"
SPANS = """
raw AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\r\\n，,。！？!?；;]+[，,。！？!?；;]?') AS c FROM documents
), clause AS (
  SELECT doc_id, i, trim(c[i], ' ' || chr(9) || chr(11) || chr(12)) AS t FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM raw)
), spans AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n, substr(t, j * 180 + 1, 180) AS span
  FROM (SELECT doc_id, i, t, unnest(generate_series(0, (length(t) - 1) // 180)) AS j FROM clause WHERE t <> '')
)"""


@query(f"""
SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_terms, CAST(len(list_distinct({TOKENS})) AS BIGINT) AS n_distinct,
  md5(array_to_string({TOKENS}, ' ')) AS terms_md5 FROM documents
""")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", fn.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query(f"""
WITH p AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, n GROUP BY term
""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_statistics(table(spark, sf_dir, "documents"))


@query(f"""WITH {SPANS}
SELECT doc_id, count(*) AS n_spans, CAST(max(length(span)) AS INTEGER) AS longest, md5(string_agg(span, chr(10) ORDER BY n)) AS spans_md5
FROM spans GROUP BY doc_id""")
def span_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", fn.split_spans(F.col("text")).alias("s")).where(F.size("s") > 0)
    parts = F.transform("s", lambda x: x.text)
    return s.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.array_max(F.transform(parts, lambda x: F.length(x))).alias("longest"), F.md5(F.array_join(parts, "\n")).alias("spans_md5"))


@query(f"""WITH {SPANS}
SELECT doc_id, count(*) AS n_spans, md5(string_agg(span, chr(10) ORDER BY n)) AS spans_md5 FROM spans GROUP BY doc_id""")
def span_split_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As rows of a generator, clauses are not computed again in a filter.
    told = lambda s: F.when(F.size(s) > 0, F.array(F.struct(F.size(s).cast("long").alias("n_spans"), F.md5(F.array_join(s, "\n")).alias("spans_md5"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(let(fn.clause_texts(F.col("text")), told)))


@query(f"""WITH RECURSIVE {SPANS},
z AS (SELECT doc_id, n, length(span) AS c FROM spans),
r AS (SELECT doc_id, n, CAST(1 AS BIGINT) AS w, CAST(1 AS BIGINT) AS k, c FROM z WHERE n = 1
  UNION ALL SELECT z.doc_id, z.n, r.w + (r.k >= 8 OR r.c + z.c > 180)::INT, CASE WHEN r.k >= 8 OR r.c + z.c > 180 THEN 1 ELSE r.k + 1 END, CASE WHEN r.k >= 8 OR r.c + z.c > 180 THEN z.c ELSE r.c + z.c END
  FROM r JOIN z ON z.doc_id = r.doc_id AND z.n = r.n + 1)
SELECT doc_id AS doc, CAST(w AS INTEGER) AS window_no, string_agg('S' || n, ',' ORDER BY n) AS targets,
  concat_ws(',', CASE WHEN min(n) > 2 THEN 'S' || (min(n) - 2) END, CASE WHEN min(n) > 1 THEN 'S' || (min(n) - 1) END) AS context FROM r GROUP BY doc_id, w""")
def greedy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of spans for whole documents, one window row each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), fn.span_sizes(F.col("text")).alias("sizes"))
    ids = F.transform("sizes", lambda _, i: F.concat(F.lit("S"), i + 1))
    w = sequences.windows_of(docs, "doc", ids, F.col("sizes"))
    return w.select("doc", "window_no", F.array_join("target_ids", ",").alias("targets"), F.array_join("context_ids", ",").alias("context"))


@query(f"""WITH RECURSIVE {SPANS},
z AS (SELECT doc_id, n, length(span) AS c FROM spans),
r AS (SELECT doc_id, n, CAST(1 AS BIGINT) AS w, CAST(1 AS BIGINT) AS k, c FROM z WHERE n = 1
  UNION ALL SELECT z.doc_id, z.n, r.w + (r.k >= 8 OR r.c + z.c > 180)::INT, CASE WHEN r.k >= 8 OR r.c + z.c > 180 THEN 1 ELSE r.k + 1 END, CASE WHEN r.k >= 8 OR r.c + z.c > 180 THEN z.c ELSE r.c + z.c END
  FROM r JOIN z ON z.doc_id = r.doc_id AND z.n = r.n + 1)
SELECT doc_id AS doc, CAST(w AS INTEGER) AS window_no, count(*) AS n_spans, CAST(min(n) AS INTEGER) AS first FROM r GROUP BY doc_id, w""")
def sql_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """greedy_windows() in SQL text, by table functions that cut texts and number windows."""
    callable.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("sql_windows_documents")
    return spark.sql("""
        WITH s AS (SELECT doc_id AS key, CAST(substr(s.id, 2) AS INT) AS place, length(s.text) AS size FROM sql_windows_documents, LATERAL clause_spans(text, 180) s),
        w AS (SELECT * FROM greedy_windows(TABLE(SELECT key, place, size FROM s) PARTITION BY key ORDER BY (place), 8, 180))
        SELECT key AS doc, window AS window_no, count(*) AS n_spans, min(place) AS first FROM w GROUP BY key, window
    """)


@query(f"""WITH {SPANS},
d AS (SELECT doc_id, n, CASE WHEN n % 7 = 0 THEN 'none' WHEN n % 11 = 0 AND length(span) >= 20 THEN 'clash' WHEN length(span) < 20 THEN 'ignored' WHEN span LIKE '%.%' THEN 'event' ELSE 'non_event' END AS kind FROM spans)
SELECT doc_id, count(*) AS targets, count(*) FILTER (kind = 'event') AS event, count(*) FILTER (kind = 'ignored') AS ignored,
  count(*) FILTER (kind = 'non_event') AS non_event, count(*) FILTER (kind = 'none') AS uncovered, count(*) FILTER (kind = 'clash') AS conflict,
  count(*) FILTER (kind IN ('none', 'clash')) = 0 AS complete FROM d GROUP BY doc_id""")
def coverage_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents with a disposition by rule; every seventh is left out, and longer ones at every eleventh place have two."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.clause_texts(F.col("text"))).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("n"), "text")
    kind = F.when(F.length("text") < 20, "ignored").when(F.contains("text", F.lit(".")), "event").otherwise("non_event")
    second = F.when((F.col("n") % 11 == 0) & (F.length("text") >= 20), "ignored")
    kinds = F.when(F.col("n") % 7 != 0, F.array_compact(F.array(kind, second)))
    s = scratch(s.select("doc_id", "n", kinds.alias("kinds")), "spans")
    d = s.select("doc_id", "n", F.explode("kinds").alias("kind"))
    return checks.coverage_summary(checks.coverage(s.select("doc_id", "n"), d, ["doc_id", "n"]), "doc_id")


@query("""
WITH u AS (SELECT sha256(text) AS s, doc_id, lang, count(*) OVER (PARTITION BY sha256(text), doc_id % 2) AS c FROM documents),
old AS (SELECT s, lang || '-label' AS label FROM u WHERE doc_id % 2 = 0 AND c = 1)
SELECT doc_id, CASE WHEN c = 1 THEN coalesce(label, 'pending') ELSE 'pending' END AS label FROM u LEFT JOIN old USING (s) WHERE doc_id % 2 = 1
""")
def reuse_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents take the labels of even ones with the same text, where that is unique."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("signature"), F.concat("lang", F.lit("-label")).alias("label"))
    return relations.reuse_labels(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "signature", "label").select("doc_id", "label")


@query("""
SELECT lang, sha256(text) AS signature, min(doc_id) AS first, array_to_string(list(doc_id ORDER BY doc_id), ',') AS members, count(*) AS n
FROM documents GROUP BY lang, sha256(text)
""")
def dedupe_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("signature"))
    return relations.by_identity(d, ["lang", "signature"], "doc_id", "doc_id").withColumn("members", F.array_join("members", ","))


@query("""
WITH a AS (SELECT doc_id, md5(text) AS m FROM documents WHERE doc_id % 5 <> 0),
b AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS m FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
  CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' WHEN a.m = b.m THEN 'same' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.doc_id = b.doc_id
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of documents against a later one in which some are gone, new or changed."""
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("m"))
    new = d.where("doc_id % 7 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("m"))
    return relations.reconcile(old, new, "doc_id", "m", ("same", "changed", "removed", "added"))


@query("""
SELECT event_id, CAST(k AS INTEGER) AS k, repaired, array_to_string(list_sort(list_filter(json_keys(repaired), lambda x: x <> 'key')), ',') AS unknown
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CASE WHEN event_id % 2 = 0 THEN replace(props, '"k":', '"key":') ELSE props END AS repaired FROM events)
""")
def wire_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of even events with a misspelled key put right; odd ones keep every byte."""
    e = table(spark, sf_dir, "events")
    repaired = F.when(F.col("event_id") % 2 == 0, wire.rename_key(F.col("props"), "k", "key")).otherwise(F.col("props"))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), repaired.alias("repaired")).withColumn(
        "unknown", F.array_join(wire.unknown_keys(F.col("repaired"), ("key",)), ",")
    )


@query("""
SELECT event_id, rule FROM (
  SELECT event_id, unnest([CASE WHEN value > 10 THEN 'value' END, CASE WHEN event_type = 'error' THEN 'type' END,
    CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) >= 50 THEN 'k' END]) AS rule FROM events) WHERE rule IS NOT NULL
""")
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int").k
    return checks.violations(table(spark, sf_dir, "events"), "event_id", {"value": F.col("value") <= 10, "type": F.col("event_type") != "error", "k": k < 50})


@query("""
WITH r AS (SELECT event_id, ['未覆盖的target_spans', 'valid json expected', '输出上限', 'source_id无效', 'schema', 'else'][CAST(event_id % 6 + 1 AS INTEGER)] AS error,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'raw' END AS raw, event_id % 13 = 0 AS judge FROM events),
c AS (SELECT CASE WHEN judge THEN 'BATCH_ROW_RETRY' WHEN error LIKE '未覆盖%' THEN 'MISSING_TARGET_COVERAGE' WHEN raw = '' THEN 'EMPTY_OUTPUT'
  WHEN error LIKE 'valid%' THEN 'JSON_PARSE_ERROR' WHEN error = '输出上限' THEN 'TRUNCATED_OUTPUT' WHEN error LIKE 'source%' THEN 'INVALID_FIELD_OR_REFERENCE'
  WHEN error = 'schema' THEN 'SCHEMA_VALIDATION_ERROR' ELSE 'OTHER' END AS category FROM r),
names AS (SELECT unnest(['JSON_PARSE_ERROR', 'SCHEMA_VALIDATION_ERROR', 'MISSING_TARGET_COVERAGE', 'EMPTY_OUTPUT', 'TRUNCATED_OUTPUT', 'INVALID_FIELD_OR_REFERENCE', 'BATCH_ROW_RETRY', 'OTHER']) AS category)
SELECT category, count(c.category) AS n FROM names LEFT JOIN c USING (category) GROUP BY category
""")
def retry_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure texts by turns, classed and counted in all classes."""
    from plumbline.operators.metrics import buckets

    said = F.array(*[F.lit(x) for x in ("未覆盖的target_spans", "valid json expected", "输出上限", "source_id无效", "schema", "else")])
    e = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 13 == 0, "judge").otherwise("extractor").alias("component"),
        F.get(said, (F.col("event_id") % 6).cast("int")).alias("error"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise("raw").alias("raw"),
    )
    c = e.select(rules.call_retry_class(F.col("component"), F.lit(""), F.col("error"), F.lit(""), F.col("raw")).alias("category"))
    return buckets(c, "category", rules.RETRY_CLASSES)


@query("""
SELECT page_id, ['character', 'angel', 'history', 'technology', 'other'][CAST(page_id % 5 AS INTEGER) + 1] AS domain, CASE WHEN page_id % 3 = 0 THEN 'Ann' WHEN page_id % 3 = 1 THEN NULL ELSE 'Bob' END AS scope,
  array_to_string(list_sort(list_concat(CASE WHEN page_id % 2 = 0 THEN ['character_knowledge'] ELSE ['causality'] END, CASE WHEN page_id % 5 = 2 OR page_id % 3 = 1 THEN ['time'] ELSE [] END)), ',') AS dimensions,
  CASE WHEN page_id % 2 = 0 THEN 'negative' ELSE 'affirmative' END AS polarity FROM pages
""")
def reference_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, scope, dimensions and polarity of chunks with made headings and texts."""
    i = F.col("page_id")
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), (at % len(names)).cast("int"))
    h = F.array(pick(("人物 a", "天使 b", "历史", "技术", "x"), i), pick(("Ann", "2063年", " Bob "), i), F.lit("c"))
    t = pick(("她不知道", "因此"), i)
    p = table(spark, sf_dir, "pages").select("page_id", h.alias("h"), t.alias("t"), F.lit("a/b.md").alias("f"))
    h, t, f = F.col("h"), F.col("t"), F.col("f")
    return p.select("page_id", rules.domain(h, f).alias("domain"), rules.scope(h).alias("scope"), F.array_join(rules.dimension_tags(h, t, f), ",").alias("dimensions"), F.array_join(rules.polarity(t), ",").alias("polarity"))


@query("""
WITH q AS (SELECT item_id, text AS quote FROM benchmark)
SELECT item_id AS quote_id, doc_id FROM q JOIN documents ON contains(text, quote) WHERE quote <> ''
""")
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a benchmark text word for word."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return checks.quoted_in(q, table(spark, sf_dir, "documents"), "doc_id")


@query("""
WITH t AS (SELECT conv_id, CAST(turn + (turn >= 3)::INT AS BIGINT) AS start, CAST(turn + (turn >= 3)::INT + 1 AS BIGINT) AS stop, role FROM conversations),
g AS (SELECT *, start - row_number() OVER (PARTITION BY conv_id ORDER BY start) AS k FROM t)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY min(start)) AS island, min(start) AS start, max(stop) AS stop, string_agg(role, '' ORDER BY start) AS text
FROM g GROUP BY conv_id, k
""")
def touching_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as spans that touch but for a gap before the fourth, merged into islands."""
    at = F.col("turn") + (F.col("turn") >= 3).cast("long")
    t = table(spark, sf_dir, "conversations").select("conv_id", at.alias("start"), (at + 1).alias("stop"), "role")
    return sequences.islands(t, "conv_id", "start", "stop", "role")
