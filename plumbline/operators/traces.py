"""Calls and attempts: reconciliation, cost classes, retries, field costs, comparisons of logs.

calls: call_id, story_id, component, status, input_tokens, output_tokens, prefill, decode, total, batch_size, is_retry.
attempts: case_id, window_id, pos (from 1), attempt, purpose, status, error, error_type, raw_output, call_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.stats import ratio, strict_sum
from plumbline.operators.checks import repeated_keys

# Purposes of attempts, kinds of calls.
COVERAGE, RECOVERY = "recover_missing_targets", ("recover_missing_targets", "recover_disposition")
EXTRACT = "extract_checkable_events"
GROUPS = ("initial", "retry", "coverage", "unknown")
COSTS = ("effective_cost", "recovery_cost", "pure_waste")
OUTCOMES = ("initial_success", "initial_failure", "format_retry_success", "format_retry_failure", "recovery_success", "recovery_failure")
AUDIT_CLASSES = (
    "JSON_PARSE_ERROR",
    "TOP_LEVEL_SCHEMA_ERROR",
    "EVENT_FIELD_ERROR",
    "INVALID_REFERENCE_OR_DISPOSITION",
    "MISSING_TARGET_COVERAGE",
    "EMPTY_OUTPUT",
    "TRUNCATED_OUTPUT",
    "INVALID_ENUM_OR_TYPE",
    "OTHER",
)
SUMMARY_CHARS = 300


def link_problems(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """call_id, problem: calls that no attempt names, attempts that name no call or one that another names, repeated calls."""
    a = attempts.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("a"))
    c = calls.groupBy("call_id").agg(F.count("*").alias("c"))
    both = a.join(c, "call_id", "full")
    problem = (
        F.when(F.col("call_id").isNull() | (F.col("call_id") == ""), "no call_id")
        .when(F.col("c") > 1, "repeated call")
        .when(F.col("a").isNull(), "no attempt")
        .when(F.col("c").isNull(), "no call")
        .when(F.col("a") > 1, "several attempts")
    )
    return both.select("call_id", problem.alias("problem")).where("problem IS NOT NULL")


def linked_calls(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """calls with case_id, window_id, attempt, operation, and what became of the attempt; calls without one have nulls."""
    a = attempts.select("call_id", "case_id", "window_id", "pos", F.coalesce("attempt", "pos").alias("attempt"), F.coalesce("purpose", F.lit(EXTRACT)).alias("operation"), F.col("status").alias("attempt_status"), F.col("error").alias("attempt_error"))
    return calls.join(a.where("call_id IS NOT NULL"), "call_id", "left")


def extractor_audit(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """calls with cost_class, outcome, failure_class, recovered_by_later, final_status and the beginning of the raw output.

    An attempt's outcome depends on whether one of its window failed before it; what a failed one cost is waste, even if a later one made up for it.
    """
    window = Window.partitionBy("case_id", "window_id").orderBy("pos")
    before, after = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(1, Window.unboundedFollowing)
    ok, failed = F.col("status") == "ok", F.col("status") == "error"
    a = attempts.withColumns(
        {
            "purpose": F.coalesce("purpose", F.lit(EXTRACT)),
            "failed_before": F.coalesce(F.max(failed).over(before), F.lit(False)),
            "ok_later": F.coalesce(F.max(ok).over(after), F.lit(False)),
            "any_ok": F.max(ok).over(Window.partitionBy("case_id", "window_id")),
        }
    )
    recovery = F.col("purpose").isin(*RECOVERY)
    kind = F.when(recovery, "recovery").when(F.col("failed_before"), "format_retry").otherwise("initial")
    a = a.select(
        "call_id", "case_id", "window_id", "pos", "purpose", "error", F.col("status").alias("attempt_status"),
        F.when(failed, COSTS[2]).when(recovery, COSTS[1]).otherwise(COSTS[0]).alias("cost_class"),
        F.concat(kind, F.when(failed, "_failure").otherwise("_success")).alias("outcome"),
        F.when(~ok, rules.audit_class(F.col("error"), F.coalesce("error_type", F.lit("")), F.col("raw_output"))).alias("failure_class"),
        (failed & F.col("ok_later")).alias("recovered_by_later"),
        F.when(F.col("any_ok"), "ok").otherwise("error").alias("final_status"),
        F.length(F.coalesce("raw_output", F.lit(""))).alias("raw_length"),
        F.substring(F.coalesce("raw_output", F.lit("")), 1, SUMMARY_CHARS).alias("raw_summary"),
    )
    return calls.drop("status", "error").join(a, "call_id")


def cost_buckets(audited: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """key, calls, stories, windows, token and time sums, share of all time, recovered calls: for every name, also those without rows."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = audited.groupBy(key).agg(
        F.count("*").alias("calls"), F.countDistinct("case_id").alias("stories"), F.countDistinct(F.struct("case_id", "window_id")).alias("windows"), zero("input_tokens").cast("long").alias("input_tokens"),
        zero("output_tokens").cast("long").alias("output_tokens"), zero("prefill").alias("prefill"), zero("decode").alias("decode"), zero("total").alias("total"), F.count_if("recovered_by_later").alias("recovered"),
    )
    every = audited.sparkSession.createDataFrame([(n,) for n in names], f"{key} string")
    whole = F.broadcast(audited.agg(F.sum("total").alias("__all")))
    out = every.join(g, key, "left").fillna(0).join(whole)
    return out.withColumn("time_share", ratio(F.col("total"), F.col("__all"))).drop("__all")


def not_closed(audited: DataFrame) -> DataFrame:
    """Calls that are in none of the cost classes, or in several rows: the classes then don't add up to the whole."""
    stray = audited.where(~F.coalesce(F.col("cost_class").isin(*COSTS), F.lit(False))).select("call_id")
    return stray.unionByName(repeated_keys(audited, ["call_id"]).select("call_id"))


def retry_audit(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """call_id, case_id, component, category, kind of each repeated call, from the failure before it.

    A call of the judge repeats rows of a batch; an extractor's repeat is told by what the attempt before it in its window said.
    """
    w = Window.partitionBy("case_id", "window_id").orderBy("pos")
    last = {f"p_{c}": F.lag(c).over(w) for c in ("error", "error_type")} | {"p_raw_output": F.lag("raw_output", 1, "no attempt before").over(w)}
    a = attempts.withColumns(last).where("call_id IS NOT NULL").select("call_id", "case_id", "purpose", *last)
    rows = calls.where("is_retry").join(a, "call_id")
    category = rules.call_retry_class(F.col("component"), F.coalesce("purpose", F.lit("")), F.col("p_error"), F.coalesce("p_error_type", F.lit("")), F.col("p_raw_output"))
    kind = F.when(F.col("component") == "judge", "judge_row_retry").when(category == "MISSING_TARGET_COVERAGE", "coverage_recovery").otherwise("failed_attempt")
    return rows.select("call_id", "case_id", "component", category.alias("category"), kind.alias("kind"), "input_tokens", "output_tokens", "total")


def call_groups(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """category, calls and sums of calls by why they were made; a sum is null as soon as one value is missing.

    A call that several attempts name, that served a batch, or whose story differs from its attempt's can't be told and is unknown.
    """
    purpose = F.when(F.col("purpose") == COVERAGE, "coverage").when(F.col("attempt") == 1, "initial").when(F.col("attempt").isNotNull(), "retry").otherwise("unknown")
    a = attempts.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("refs"), F.first("case_id").alias("case_id"), F.first(purpose).alias("category"))
    rows = calls.join(a, "call_id", "left")
    sure = (F.col("refs") == 1) & (F.col("batch_size") == 1) & F.col("story_id").eqNullSafe(F.col("case_id"))
    rows = rows.withColumn("category", F.when(F.coalesce(sure, F.lit(False)), F.col("category")).otherwise("unknown"))
    valid = lambda c: F.when(F.col(c) >= 0, F.col(c))
    g = rows.groupBy("category").agg(F.count("*").alias("calls"), *[strict_sum(valid(c)).alias(c) for c in ("total", "prefill", "decode", "input_tokens", "output_tokens")])
    every = calls.sparkSession.createDataFrame([(n,) for n in GROUPS], "category string")
    empty = lambda c: F.when(F.col("calls").isNull(), F.lit(0)).otherwise(F.col(c)).alias(c)
    return every.join(g, "category", "left").select("category", F.coalesce("calls", F.lit(0)).alias("calls"), *[empty(c) for c in ("total", "prefill", "decode", "input_tokens", "output_tokens")])


def log_problems(attempts: DataFrame, calls: DataFrame, wires: DataFrame) -> DataFrame:
    """log, call_id, problem: attempts without a call or a wire row (call_id), and calls and wires that no attempt names."""
    count = lambda rows, name: rows.select("call_id", *[F.lit(int(n == name)).alias(n) for n in ("a", "c", "w")])
    every = reduce(DataFrame.unionByName, [count(rows.where("call_id IS NOT NULL"), name) for rows, name in ((attempts, "a"), (calls, "c"), (wires, "w"))])
    # All logs meet in one sum by id; no side is sorted or held whole beside another.
    held = every.groupBy("call_id").agg(*[F.sum(n).alias(n) for n in ("a", "c", "w")])

    def rows(log: str, n: str) -> Column:
        row = lambda problem: F.struct(F.lit(log).alias("log"), F.lit(problem).alias("problem"))
        return F.when((F.col("a") > 0) & (F.col(n) == 0), F.array(row("missing"))).when(F.col("a") == 0, F.array_repeat(row("unknown"), F.col(n).cast("int"))).otherwise(F.array_repeat(row("unknown"), 0))

    found = held.select("call_id", F.explode(F.concat(rows("calls", "c"), rows("wires", "w"))).alias("x")).select("x.log", "call_id", "x.problem")
    nameless = [log.where("call_id IS NULL").select(F.lit(name).alias("log"), "call_id", F.lit("unknown").alias("problem")) for log, name in ((calls, "calls"), (wires, "wires"))]
    return reduce(DataFrame.unionByName, nameless, found)


def field_costs(payloads: DataFrame, fields: list[str], tokens) -> DataFrame:
    """component, field, calls, tokens, mean: what the fields of JSON payloads (component, raw) cost by a token counter.

    ``tokens`` gives a column of counts for a column of texts; fields are paths, and a payload without one has no part in it.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.try_variant_get(F.try_parse_json("raw"), f"$.{f}", "variant")).alias("text")) for f in fields])
    rows = payloads.select("component", F.explode(each).alias("x")).select("component", "x.*").where("text IS NOT NULL").withColumn("n", tokens(F.col("text")))
    return rows.groupBy("component", "field").agg(F.count("*").alias("calls"), F.sum("n").cast("long").alias("tokens"), F.round(F.avg("n"), 6).alias("mean"))


def call_times(begun: Column, first: Column, ended: Column) -> Column:
    """struct(prefill, decode, total, ttft_ms) of a call from its three stamps in seconds; none is negative, unknown ones are null."""
    span = lambda a, b: F.greatest(F.lit(0.0), b - a)
    return F.struct(
        F.when(first.isNotNull(), span(begun, first)).alias("prefill"), F.when(first.isNotNull(), span(first, ended)).alias("decode"), span(begun, ended).alias("total"), F.when(first.isNotNull(), span(begun, first) * 1000).alias("ttft_ms")
    )


def commit_steps(steps: DataFrame, key: str) -> DataFrame:
    """key, steps, tokens, tokens_per_step, multi_token_steps of decoding steps (key, committed)."""
    g = steps.groupBy(key).agg(F.count("*").alias("steps"), F.sum("committed").cast("long").alias("tokens"), F.count_if(F.col("committed") > 1).alias("multi_token_steps"))
    return g.withColumn("tokens_per_step", ratio(F.col("tokens"), F.col("steps")))


def run_summary(rows: DataFrame, calls: DataFrame, arm: str) -> DataFrame:
    """Per arm: stories by status, calls, strict token and time sums, average batch, rates, first-token percentiles by rank."""
    s = rows.groupBy(arm).agg(F.count("*").alias("stories"), *[F.count_if(F.col("status") == x).alias(x) for x in ("ok", "partial", "error")])
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ttft)")
    c = calls.groupBy(arm).agg(
        F.count("*").alias("calls"), F.round(F.avg("batch_size"), 6).alias("average_batch"), strict_sum("input_tokens").cast("long").alias("input_tokens"), strict_sum("output_tokens").cast("long").alias("output_tokens"),
        F.round(strict_sum("total"), 6).alias("seconds"), ratio(F.sum("output_tokens"), F.sum("decode")).alias("decode_rate"), rank(0.5).alias("ttft_p50"), rank(0.95).alias("ttft_p95"),
    )
    return s.join(c, arm, "left")


def measured_runs(rows: DataFrame, run: str, warm_up: int, value: str) -> DataFrame:
    """run, total: sums of a measure by run, without the first ``warm_up`` runs; medians and peaks are taken over these."""
    return rows.where(F.col(run) > warm_up).groupBy(run).agg(F.round(F.sum(value), 6).alias("total"), F.max(value).alias("peak"), F.count("*").alias("n"))
