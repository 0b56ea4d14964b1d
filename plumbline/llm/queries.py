"""The registered queries; each reads its rows back from its operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from plumbline.llm import alignment, chat, decontam, fingerprints, grid_join, kneser_ney, minhash, mixing, prefix_trie, sharding, sstable, substring, token_count
from plumbline.llm.common import table

PROBE = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like the template's own marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    done = chat.format_conversations(turns.unionByName(probe))
    back = done.withColumns({"back": chat.read_turns(F.col("formatted")), "learned": chat.read_learned(F.col("segments"))})
    digest = F.array_join(F.transform("back", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), w AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), 'start') AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS from_end,
         replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS esc
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + 4 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
    ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c')) END + 2 + 9) AS BIGINT) AS formatted_chars,
  bool_and((before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user'))
    AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM w GROUP BY conv_id
"""

def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and decision for each document."""
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels."""
    return grid_join.near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT x AS vec_id, any_value(coalesce(n, 0)) AS n_links, min(y) AS component_id, min(y) = x AS kept FROM reach LEFT JOIN n ON a = x GROUP BY x
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of word pairs are similar by 80 % or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("row")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM d),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c ON x = doc_id
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), spots AS (
  SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hits AS (
  SELECT r, i, s.n, item_id FROM spots s JOIN wins USING (win)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without runs of 35 words that occur elsewhere."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT r, i, hash(w[i:i+34]) AS h, md5(array_to_string(w[i:i+34], ' ')) AS m
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h, m) AS c FROM starts) WHERE c > 1
), gone AS (
  SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM rep
), words AS (
  SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS p FROM d)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

SHARDS = 24


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards whose row counts differ by one at most."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as sorted shards and read back."""
    folder = sstable.write_token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return sstable.read_token_shards(spark, folder)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of those with equal texts up to white space."""
    return fingerprints.exact_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, over all documents."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


# crc32 by its bitwise rule, since DuckDB has no such function; each node meets the nodes above it by (conversation, depth).
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS i, x, b FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL)
), bits AS (
  SELECT DISTINCT c, 0 AS k, CAST(4294967295 AS BIGINT) AS crc FROM t
  UNION ALL
  SELECT c, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM (SELECT c, k, CASE WHEN k % 8 = 0 THEN xor(crc, CAST(ascii(substr(CAST(c AS VARCHAR), k // 8 + 1, 1)) AS BIGINT)) ELSE crc END AS v FROM bits WHERE k < 8 * length(CAST(c AS VARCHAR)))
), h AS (
  SELECT c, xor(crc, 4294967295) % 9 AS h FROM bits WHERE k = 8 * length(CAST(c AS VARCHAR))
), raw AS (
  SELECT h.c, 0 AS own, i, x, b FROM h JOIN t ON t.c = h.c - h.c % 5 AND i <= h
  UNION ALL SELECT h.c, 1, i, x, b FROM h JOIN t ON t.c = h.c AND i > h
), seq AS (
  SELECT c, row_number() OVER w AS d, b, string_agg(x, '') OVER (w ROWS UNBOUNDED PRECEDING) AS p FROM raw WINDOW w AS (PARTITION BY c ORDER BY own, i)
), all_at AS (
  SELECT c, d, b, p FROM seq UNION ALL SELECT c, 0, 0, '' FROM h
), deepest AS (
  SELECT c, max(d) AS d FROM all_at GROUP BY c
), node AS (
  SELECT p, d, any_value(b) AS b, min(c) AS c, count(*) AS n FROM all_at GROUP BY p, d
), up AS (
  SELECT y.p, a.p AS above FROM node y JOIN all_at a ON a.c = y.c AND a.d <= y.d
), below AS (
  SELECT y.p, count(*) AS kids, y.d FROM node y JOIN node k ON k.d = y.d + 1 AND left(k.p, 32 * y.d) = y.p GROUP BY y.p, y.d
), sums AS (
  SELECT above AS p, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * b) AS saved FROM up JOIN node USING (p) LEFT JOIN below USING (p) GROUP BY above
), ends AS (
  SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM all_at JOIN deepest USING (c, d) GROUP BY p
)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, (SELECT m.c FROM node m WHERE m.d = node.d - 1 AND m.p = left(node.p, 32 * (node.d - 1))) AS parent_conv_id,
  n AS n_convs, coalesce(kids, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM node LEFT JOIN below USING (p) JOIN sums USING (p) LEFT JOIN ends USING (p)
"""

QUERIES = {
    "op1_chat": op1_chat,
    "op2_quality": op2_quality,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_mixing": op4_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_shards": op9_shards,
    "op10_token_counts": op10_token_counts,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_alignment": op12_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_chat": OP1_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op5_near_dedup": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
