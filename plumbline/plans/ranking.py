"""Queries for retrieval, fusion, filters and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import tokenize
from plumbline.operators import retrieval
from plumbline.plans.base import registry, table

QUERIES, ORACLES, query = registry()
K = 5

BM25 = """
tok AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS t FROM documents),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT doc, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark),
sc AS (SELECT query_id, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s, count(*) AS shared
  FROM qt JOIN tf USING (term) JOIN df USING (term), size GROUP BY query_id, doc),
every AS (SELECT item_id AS query_id, doc_id AS doc, round(coalesce(s, 0), 6) AS score, CAST(coalesce(shared, 0) AS DOUBLE) AS shared
  FROM benchmark CROSS JOIN documents LEFT JOIN sc ON sc.query_id = item_id AND sc.doc = doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank,
  row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc) AS shared_rank FROM every)"""
DENSE = """
q AS (SELECT vec_id AS query_id, label AS query_label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dense AS (SELECT query_id, query_label, vec_id, label, round(list_dot_product(q.v, e.v), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q.v, e.v), 6) DESC, vec_id) AS rank FROM q, e)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT query_id, doc, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_top_k(_queries(spark, sf_dir), table(spark, sf_dir, "documents"), K)


@query(f"WITH {BM25} SELECT query_id, doc, shared AS score, shared_rank AS rank FROM ranked WHERE shared_rank <= 5")
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.overlap_top_k(_queries(spark, sf_dir), table(spark, sf_dir, "documents"), K)


@query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dense WHERE rank <= 5")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all."""
    v = table(spark, sf_dir, "embeddings")
    return retrieval.dense_top_k(v, v.where("vec_id % 100 = 0"), K)


@query(f"""WITH {BM25},
f AS (SELECT query_id, doc, CASE WHEN rank <= 20 THEN rank END AS a, CASE WHEN shared_rank <= 20 THEN shared_rank END AS b FROM ranked WHERE rank <= 20 OR shared_rank <= 20),
r AS (SELECT query_id, doc, a AS first_rank, b AS second_rank, round(coalesce(1 / (60.0 + a), 0) + coalesce(1 / (60.0 + b), 0), 12) AS score FROM f)
SELECT * FROM (SELECT query_id, doc, score, first_rank, second_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(first_rank, second_rank), doc) AS rank FROM r) WHERE rank <= 5
""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of BM25 and term overlap, each 20 deep."""
    q, d = _queries(spark, sf_dir), table(spark, sf_dir, "documents")
    return retrieval.fuse(*retrieval.lexical_rankings(q, d, 20), K)


@query("""
WITH f AS (SELECT event_id AS fact_id, CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'xx' ELSE 'fr' END AS e,
  CASE WHEN event_id % 3 = 0 THEN 'src' || (event_id % 25) END AS d FROM events),
m AS (SELECT fact_id, e IN ('en', 'de', 'fr', 'es') AS has_e, d IS NOT NULL AS has_d,
  (SELECT count(*) FROM documents WHERE lang = e AND source = d) AS both_n, (SELECT count(*) FROM documents WHERE lang = e) AS e_n,
  (SELECT count(*) FROM documents WHERE source = d) AS d_n, (SELECT count(*) FROM documents WHERE lang = e OR source = d) AS any_n,
  (SELECT count(*) FROM documents) AS n FROM f),
l AS (SELECT *, CASE WHEN has_e AND has_d AND both_n >= 20 THEN 'entity+dimension' WHEN has_e AND has_d AND any_n >= 20 THEN 'entity|dimension'
  WHEN has_e AND NOT has_d AND e_n >= 20 THEN 'entity' WHEN has_d AND NOT has_e AND d_n >= 20 THEN 'dimension' ELSE 'all' END AS level FROM m)
SELECT fact_id, level, CASE WHEN has_e AND has_d THEN level <> 'entity+dimension' WHEN has_e OR has_d THEN level = 'all' ELSE FALSE END AS fallback,
  CASE level WHEN 'entity+dimension' THEN both_n WHEN 'entity|dimension' THEN any_n WHEN 'entity' THEN e_n WHEN 'dimension' THEN d_n ELSE n END AS candidates FROM l
""")
def metadata_filter_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with a language as entity and a source as dimension, over documents as items."""
    d = table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    items = d.select(F.col("doc_id").alias("item_id"), F.array("lang").alias("entities"), F.array("source").alias("dimension_tags"), none.alias("time_markers"))
    lang = F.get(F.array(*[F.lit(x) for x in ("en", "de", "xx", "fr")]), (F.col("event_id") % 4).cast("int"))
    source = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("src"), F.col("event_id") % 25))
    facts = table(spark, sf_dir, "events").select(F.col("event_id").alias("fact_id"), lang.alias("subject"), none.alias("actors"), F.lit("").alias("text"), F.array_compact(F.array(source)).alias("dimensions"), none.alias("times"))
    facts = retrieval.filter_hints(facts, d.select(F.col("lang").alias("name")).distinct())
    return retrieval.select_candidates(facts, items, 20)


WHOLE = f"""WITH {DENSE},
whole AS (SELECT query_id, vec_id, rank, same, row_number() OVER (PARTITION BY query_id, same ORDER BY rank) AS same_rank
  FROM (SELECT *, coalesce(label = query_label, FALSE) AS same FROM dense WHERE score IS NOT NULL))"""


def _cell_sql(pool: str) -> str:
    return f"""
SELECT round(avg(CASE WHEN hits = n_exp THEN 1 ELSE 0 END), 6) AS complete_recall, round(sum(hits) / sum(n_exp), 6) AS micro_recall,
  round(avg(CASE WHEN pool_hits = n_exp THEN 1 ELSE 0 END), 6) AS pool_recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(n_pool), 6) AS mean_candidates
FROM (SELECT query_id, count(*) FILTER (is_exp) AS n_exp, count(*) FILTER (is_exp AND pool_rank <= 5) AS hits, count(*) FILTER (is_exp AND in_pool) AS pool_hits,
  min(pool_rank) FILTER (is_exp AND pool_rank <= 5) AS first, count(*) FILTER (in_pool) AS n_pool
  FROM (SELECT *, same AND same_rank <= 3 AS is_exp, {pool} AS in_pool, CASE WHEN {pool} THEN row_number() OVER (PARTITION BY query_id, {pool} ORDER BY rank) END AS pool_rank FROM whole) GROUP BY query_id)"""


@query(WHOLE + _cell_sql("TRUE"))
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of dense retrieval over all vectors; expected are the three nearest of all with the query's label."""
    return retrieval_matrix(spark, sf_dir).where("filter = 'off'").drop("filter")


@query(WHOLE + f" SELECT 'off' AS filter, * FROM ({_cell_sql('TRUE')}) UNION ALL SELECT 'on', * FROM ({_cell_sql('same')})")
def retrieval_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense cells of the matrix: all vectors are ranked, or all that the label filter leaves; expected are the three nearest of all with the query's label."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0")
    return cells(v, q)


def cells(v: DataFrame, q: DataFrame) -> DataFrame:
    """A row of metrics for each filter over vectors and queries (vec_id, label, embedding)."""
    v, q = v.where("embedding IS NOT NULL"), q.where("embedding IS NOT NULL")
    named = q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    sizes = v.groupBy("label").agg(F.count("*").alias("m"))
    n = sizes.agg(F.sum("m").alias("n"))
    ids = lambda rows, name: rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x.vec_id).alias(name))
    inside = retrieval.dense_top_k(v, q, K, within="label").join(v.select("vec_id", "label"), "vec_id")
    expected = inside.where("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x.vec_id).alias("expected"), F.collect_set("label").alias("labels"))
    none = F.array().cast("array<long>")
    out = []
    for on in (False, True):
        found = ids(inside if on else retrieval.dense_top_k(v, q, K), "retrieved")
        rows = named.join(expected, "query_id", "left").join(found, "query_id", "left").join(sizes, F.col("own") == F.col("label"), "left").join(F.broadcast(n))
        rows = rows.withColumns({"expected": F.coalesce("expected", none), "retrieved": F.coalesce("retrieved", none)})
        pool = F.coalesce(F.forall("labels", lambda x: x == F.col("own")), F.lit(True)) if on else F.lit(True)
        count = F.coalesce("m", F.lit(0)) if on else F.col("n")
        out.append(rows.agg(*retrieval.retrieval_scores(rows, K, pool, count)).select(F.lit("on" if on else "off").alias("filter"), "*"))
    return out[0].unionByName(out[1])


@query("""
WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM benchmark)
SELECT item_id AS query_id, CAST(len(regexp_extract_all(lower(b.text), '[a-z0-9_]+')) AS BIGINT) AS query_tokens, CAST(len(t) AS BIGINT) AS distinct_terms FROM t JOIN benchmark b USING (item_id)
""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _queries(spark, sf_dir).withColumn("t", tokenize(F.col("text")))
    return q.select("query_id", F.size("t").cast("long").alias("query_tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_terms"))
