"""Metrics: classification, detection, extraction, funnels, attribution, cost profiles, tables of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import nearest_rank, prf, ratio
from plumbline.operators.scoring import take_in_turn
from plumbline.operators.sequences import numbered


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """gold, predicted, n; a missing prediction is counted as such."""
    return rows.groupBy(F.col(gold).alias("gold"), F.coalesce(F.col(predicted), F.lit("missing")).alias("predicted")).agg(F.count("*").alias("n"))


def class_scores(table: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """label, support, tp, fp, fn, precision, recall, f1 from a confusion table; missing predictions count as misses."""
    per = table.select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), "gold", "predicted", "n")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    is_gold, is_pred = F.col("gold") == F.col("label"), F.col("predicted") == F.col("label")
    g = per.groupBy("label").agg(count(is_gold).alias("support"), count(is_gold & is_pred).alias("tp"), count(~is_gold & is_pred).alias("fp"), count(is_gold & ~is_pred).alias("fn"))
    return g.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(scores: DataFrame, supported_only: bool) -> DataFrame:
    """accuracy and macro_f1. Over supported classes only, or over all with zero where a class has no score."""
    value = F.coalesce("f1", F.lit(0.0))
    rows = scores.where("support > 0") if supported_only else scores
    return rows.agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.round(F.avg(value), 6).alias("macro_f1"))


def detection(gold: DataFrame, alarms: DataFrame, how: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of conflicts, by one of four definitions that are not comparable.

    gold: case_id, gold_id, conflict; alarms: case_id, alarm_id, gold_id (nullable), in order of alarm_id.
    cover: a conflict is found if any alarm maps to it, an alarm that maps to none is false. finding: alarms are
    counted, each right or false, and a conflict is missed if no alarm maps to it. per_gold: false are gold facts without
    conflict that an alarm maps to, so unmapped alarms go uncounted. one_to_one: each conflict takes its first alarm, all
    further and unmapped ones are false.
    """
    m = alarms.join(gold, ["case_id", "gold_id"], "left").withColumn("right", F.coalesce("conflict", F.lit(False)))
    hit = m.where("right").select("case_id", "gold_id").distinct().withColumn("hit", F.lit(True))
    g = gold.join(hit, ["case_id", "gold_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    base = g.agg(F.count_if(F.col("conflict") & F.col("hit")).alias("found"), F.count_if(F.col("conflict") & ~F.col("hit")).alias("fn"))
    false = m.agg(F.count_if(~F.col("right")).alias("wrong"), F.count_if("right").alias("hits"), F.count(F.lit(1)).alias("alarms"))
    if how == "per_gold":
        false = m.where("conflict = false").select("case_id", "gold_id").distinct().agg(F.count("*").alias("fp"))
    out = base.join(F.broadcast(false))  # one row each
    tp, fp = {"cover": ("found", "wrong"), "finding": ("hits", "wrong"), "per_gold": ("found", "fp"), "one_to_one": ("found", "alarms - found")}[how]
    out = out.select(F.expr(tp).alias("tp"), F.expr(fp).alias("fp"), "fn")
    return out.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def greedy_matches(alarms: DataFrame) -> DataFrame:
    """case_id, alarm_id, matched: each alarm in order takes the smallest gold_id of its list that is still free.

    alarms: case_id, alarm_id, gold_ids. What one alarm may take depends on those before it in its case.
    """
    rows = alarms.select("case_id", F.col("alarm_id").cast("string").alias("alarm_id"), F.col("alarm_id").alias("ord"), F.array_sort("gold_ids").alias("may"))
    return take_in_turn(rows).withColumnRenamed("taken", "matched")


def funnel(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """stage_no, stage, eligible, passed, rate: each stage's denominator is what passed the one before."""
    alive, parts = F.lit(True), []
    for i, (name, ok) in enumerate(stages):
        ok = F.coalesce(ok, F.lit(False))
        parts.append(F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.count_if(alive).alias("eligible"), F.count_if(alive & ok).alias("passed")))
        alive = alive & ok
    out = rows.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("r")).select("r.*")
    return out.withColumn("rate", ratio(F.col("passed"), F.col("eligible")))


def first_failure(stages: list[tuple[str, Column]]) -> Column:
    """Name of the first stage that does not hold; ``none`` if all do."""
    out = F.lit("none")
    for name, ok in reversed(stages):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def error_ids(errors: DataFrame, order: list[str], prefix: str = "AT") -> DataFrame:
    """errors with error_id AT-0001, AT-0002, ... in the order of construction."""
    return numbered(errors, order, "__n").withColumn("error_id", F.format_string(f"{prefix}-%04d", "__n")).drop("__n")


def cost_profile(calls: DataFrame, component: str) -> DataFrame:
    """Per component: calls, retries, tokens, seconds, rates, and the percentiles of the first token by their own rules.

    calls: component, is_retry, input_tokens, padded_tokens, output_tokens, prefill, decode, total, ttft.
    """
    everything = F.sum(F.sum("total")).over(Window.partitionBy())
    return calls.groupBy(F.col(component).alias("component")).agg(
        F.count("*").alias("calls"),
        F.count_if("is_retry").alias("retry_calls"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("padded_tokens").cast("long").alias("padded_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.round(F.sum("total"), 4).alias("total_seconds"),
        ratio(F.sum("input_tokens"), F.sum("prefill")).alias("prefill_rate"),
        ratio(F.sum("output_tokens"), F.sum("decode")).alias("decode_rate"),
        F.round(F.median("ttft"), 6).alias("ttft_p50"),
        F.round(nearest_rank("ttft", 0.95), 6).alias("ttft_p95"),
        F.round(F.max("ttft"), 6).alias("ttft_max"),
        ratio(F.sum("total"), everything).alias("time_share"),
    )


def buckets(rows: DataFrame, category: str, names: tuple[str, ...], *sums: str) -> DataFrame:
    """category, n and sums for every name, also those without rows."""
    g = rows.groupBy(category).agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums])
    every = rows.sparkSession.createDataFrame([(n,) for n in names], f"{category} string")
    return every.join(g, category, "left").fillna(0, ["n", *sums])


def stratified_round_robin(rows: DataFrame, label: str, stratum: str, order: str, most: int) -> DataFrame:
    """rows with place: up to ``most`` of each label, one of each stratum in turn, in order inside a stratum."""
    turn = F.row_number().over(Window.partitionBy(label, stratum).orderBy(order))
    place = F.row_number().over(Window.partitionBy(label).orderBy("turn", stratum))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).withColumn("place", place).where(F.col("place") <= most)


def repeats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, least, greatest, mean and deviation of a measure over repeated runs."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.round(F.median(v), 6).alias("median"),
        F.min(v).alias("least"),
        F.max(v).alias("greatest"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.stddev(v), 6).alias("deviation"),
    )


def deltas(rows: DataFrame, key: str, side: str, value: str, base: str, other: str) -> DataFrame:
    """key, base, other, delta, relative: two systems side by side, null where one is missing."""
    of = lambda s: F.max(F.when(F.col(side) == s, F.col(value)))
    g = rows.groupBy(key).agg(of(base).alias("base"), of(other).alias("other"))
    diff = F.col("other") - F.col("base")
    return g.select(key, "base", "other", F.round(diff, 6).alias("delta"), ratio(diff, F.col("base")).alias("relative"))


def by_sets(rows: DataFrame, sets: list[tuple[str, ...]], *measures: Column) -> DataFrame:
    """Measures overall and by each set of columns in one pass; ``level`` tells which columns a row is by."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    level = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    return grouped.agg(F.coalesce(F.nullif(level, F.lit("")), F.lit("all")).alias("level"), *measures)


def judge_results(rows: DataFrame) -> DataFrame:
    """One row over results (expected, predicted, status, attempts): accuracy, parse failures and retries; failures stay in the denominators."""
    ok = F.col("status") == "ok"
    s = rows.agg(F.count("*").alias("facts"), F.count_if(ok & (F.col("expected") == F.col("predicted"))).alias("correct"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failures"), F.count_if(F.col("attempts") > 1).alias("retried"))
    return s.select("*", *[ratio(F.col(a), F.col("facts")).alias(b) for a, b in (("correct", "accuracy"), ("failures", "parse_failure_rate"), ("retried", "retry_rate"))])


def performance(calls: DataFrame, stories: DataFrame, wall_seconds: float) -> DataFrame:
    """One row: median first token, output rate weighted by time, story latency by rank, stories a second.

    calls: ttft, output_tokens, decode; stories: seconds.
    """
    c = calls.agg(F.round(F.median("ttft"), 6).alias("ttft_median"), ratio(F.sum("output_tokens"), F.sum("decode")).alias("decode_rate"))
    t = stories.agg(F.count("*").alias("stories"), F.round(F.median("seconds"), 6).alias("latency_median"), F.round(nearest_rank("seconds", 0.95), 6).alias("latency_p95"))
    return c.join(F.broadcast(t)).withColumn("stories_per_second", ratio(F.col("stories"), F.lit(wall_seconds)))
