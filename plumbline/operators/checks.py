"""Constraint checks: rows that break a rule, coverage of spans, quotes, keys and partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.lookup import inside


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: one row for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def call_rules() -> dict[str, Column]:
    """What a trace row must satisfy: token sums, phases that add up, first token at the end of the first phase."""
    c = F.col
    phases = c("prefill").isNotNull() & c("decode").isNotNull()
    none = c("prefill").isNull() & c("decode").isNull() & c("ttft").isNull()
    return {
        "compute_tokens": c("compute_tokens") == c("input_tokens") + c("padded_tokens"),
        "phases_sum": none | (phases & (F.abs(c("prefill") + c("decode") - c("total")) <= 1e-6)),
        "first_token": none | (phases & (F.abs(c("ttft") - c("prefill") * 1000) <= 1e-3)),
        "error_text": (c("status") != "error") | c("error").isNotNull(),
        "batch": c("batch_size") >= 1,
    }


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_empty(problems: DataFrame, message: str) -> None:
    """Raise if there is a problem; reads until the first one."""
    found = problems.limit(1).collect()
    if found:
        raise ValueError(f"{message}: {found[0].asDict()}")


def coverage(spans: DataFrame, dispositions: DataFrame, keys: list[str]) -> DataFrame:
    """spans with ``kind``: what each span came to, or uncovered; conflict if it came to two things.

    Only events may claim a span more than once.
    """
    d = dispositions.groupBy(*keys).agg(F.count("*").alias("__n"), F.collect_set("kind").alias("__kinds"))
    only = F.get("__kinds", 0)
    fine = (F.size("__kinds") == 1) & ((F.col("__n") == 1) | (only == "event"))
    kind = F.when(F.col("__kinds").isNull(), "uncovered").when(fine, only).otherwise("conflict")
    return spans.join(d, keys, "left").withColumn("kind", kind).drop("__n", "__kinds")


def coverage_summary(covered: DataFrame, group: str) -> DataFrame:
    """Counts by kind and whether a group is complete."""
    n = lambda k: F.count_if(F.col("kind") == k)
    g = covered.groupBy(group).agg(F.count("*").alias("targets"), *[n(k).alias(k) for k in ("event", "ignored", "non_event", "uncovered", "conflict")])
    return g.withColumn("complete", (F.col("uncovered") == 0) & (F.col("conflict") == 0))


def quoted_in(quotes: DataFrame, texts: DataFrame, text_key: str, words: int = 3) -> DataFrame:
    """quote_id, text_key: which texts hold a quote verbatim.

    All but the first and last word of a quote stand as whole words in any text that holds it, so quotes and texts meet
    on up to ``words`` of those and only then are compared. Quotes without such a word are found by an automaton in one pass.
    """
    inner = F.split("quote", r"\s+")
    q = quotes.where("quote <> ''").withColumn("w", F.slice(inner, 2, F.greatest(F.lit(0), F.least(F.size(inner) - 2, F.lit(words)))))

    def runs(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        # get() is direct; slice() inside a lambda would copy all words for each place
        return F.transform(starts, lambda i: F.xxhash64(F.array(*[F.get("w", i - 1 + j) for j in range(n)])))

    # The words are a column of their own, or each place would split the text again.
    keys = F.array_distinct(F.concat(*[runs(n) for n in range(1, words + 1)]))
    spots = texts.select(text_key, F.split("text", r"\s+").alias("w")).select(text_key, F.explode(keys).alias("key"))
    near = spots.join(q.where(F.size("w") > 0).select("quote_id", F.xxhash64("w").alias("key")), "key").select("quote_id", text_key).distinct()
    sure = near.join(quotes.select("quote_id", "quote"), "quote_id").join(texts.select(text_key, "text"), text_key).where(F.contains("text", "quote"))
    few = q.where(F.size("w") == 0).select("quote_id", "quote")
    short = inside(texts, text_key, "text", few, "quote").join(few, "quote")
    return sure.select("quote_id", text_key).unionByName(short.select("quote_id", text_key).distinct())


def partition_errors(all_: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """key, problem: rows that the parts miss, hold twice or add."""
    union = reduce(lambda a, b: a.unionByName(b), [p.select(key, F.lit(name).alias("part")) for name, p in parts.items()])
    held = union.groupBy(key).agg(F.count("*").alias("n"))
    both = all_.select(key, F.lit(True).alias("known")).join(held, key, "full")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "twice")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def unit_vectors(vectors: DataFrame, dim: int, tolerance: float = 1e-5) -> DataFrame:
    """Ids of vectors of another length or norm."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return violations(vectors, "vec_id", {"dim": F.size("embedding") == dim, "unit_norm": F.abs(norm - 1) <= tolerance})
