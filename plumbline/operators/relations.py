"""Joins: overlaps, pairs, nearest earlier rows, lineage, reconciliation and reuse by signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of rows with one key whose closed intervals [start, stop] (numbers) overlap.

    Intervals are entered in all buckets of ``width`` that they touch and meet by equality; a pair is
    taken in the bucket where the later of the two begins, so once. No pair of rows is tested that
    shares no bucket. left and right: key, id, start, stop; gives key, left_id, right_id.
    """
    enter = lambda d, n: d.select(key, F.col("id").alias(f"{n}_id"), F.col("start").alias(f"{n}_a"), F.col("stop").alias(f"{n}_b")).withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col(f"{n}_a") / width), F.floor(F.col(f"{n}_b") / width)))
    )
    met = enter(left, "left").join(enter(right, "right"), [key, "bucket"])
    owner = F.floor(F.greatest("left_a", "right_a") / width) == F.col("bucket")
    return met.where(owner & (F.col("left_a") <= F.col("right_b")) & (F.col("right_a") <= F.col("left_b"))).select(key, "left_id", "right_id")


def ordered_pairs(rows: DataFrame, group: str, order: str, most: int, batch: int) -> DataFrame:
    """group, first, second, pair_no, batch_no, unprocessed: pairs of a group's rows in order, the first ``most`` of a group.

    Pair numbers follow the order of first and second; ``unprocessed`` is how many pairs of the group are beyond ``most``. Rows that
    cannot reach the first ``most`` pairs never meet.
    """
    w = Window.partitionBy(group).orderBy(order)
    rows = rows.select(group, F.col(order).alias("at")).withColumn("pos", F.row_number().over(w.orderBy("at")))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(group)))
    # pairs before (i, j): those of the i - 1 earlier rows, then j - i - 1
    before = F.col("i") - 1
    number = (before * F.col("n") - before * F.col("i") / 2 + F.col("j") - F.col("i")).cast("long")
    a = rows.select(group, F.col("at").alias("first"), F.col("pos").alias("i"), "n").where(F.col("pos") <= most)
    b = rows.select(group, F.col("at").alias("second"), F.col("pos").alias("j"))
    pairs = a.join(b, group).where(F.col("i") < F.col("j")).withColumn("pair_no", number).where(F.col("pair_no") <= most)
    beyond = F.greatest((F.col("n") * (F.col("n") - 1) / 2).cast("long") - most, F.lit(0)).alias("unprocessed")
    return pairs.select(group, "first", "second", "pair_no", F.floor((F.col("pair_no") - 1) / batch).alias("batch_no"), beyond)


def nearest_before(rows: DataFrame, group: str, order: list[str], is_mark: Column, value: Column, name: str) -> DataFrame:
    """rows with ``name``: the value of the closest earlier row of the group that is marked."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(is_mark, value), ignorenulls=True).over(w))


def lineage(attempts: DataFrame, group: str, order: list[str], failed: Column) -> DataFrame:
    """attempts with the attempt before, whether it failed, whether a later one succeeded, and what the attempt cost for.

    cost_class: first, repeat (after a failure) or follow_up; outcome: ok, recovered (failed, a later one is ok) or lost.
    """
    w = Window.partitionBy(group).orderBy(*order)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    out = attempts.withColumn("failed", failed)
    out = out.withColumns({"before_failed": F.lag("failed").over(w), "later_ok": F.coalesce(F.max(~F.col("failed")).over(later), F.lit(False)), "attempt_no": F.row_number().over(w)})
    cost = F.when(F.col("before_failed").isNull(), "first").when(F.col("before_failed"), "repeat").otherwise("follow_up")
    outcome = F.when(~F.col("failed"), "ok").when(F.col("later_ok"), "recovered").otherwise("lost")
    return out.withColumns({"cost_class": cost, "outcome": outcome})


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str, names: tuple[str, str, str, str]) -> DataFrame:
    """key, state of two keyed tables: names for same, different, only left and only right."""
    a, b = left.select(key, F.col(value).alias("__a"), F.lit(True).alias("__l")), right.select(key, F.col(value).alias("__b"), F.lit(True).alias("__r"))
    same, other, gone, new = names
    state = F.when(F.col("__r").isNull(), gone).when(F.col("__l").isNull(), new).when(F.col("__a").eqNullSafe(F.col("__b")), same).otherwise(other)
    return a.join(b, key, "full").select(key, state.alias("state"))


def reuse_labels(new: DataFrame, old: DataFrame, signature: str, label: str, pending: str = "pending") -> DataFrame:
    """new with ``label`` from old rows of the same signature, if it is unique on both sides; else ``pending``."""
    once = lambda d: d.withColumn("__n", F.count("*").over(Window.partitionBy(signature)))
    known = once(old).where("__n = 1").select(signature, F.col(label).alias("__label"))
    out = once(new.drop(label)).join(known, signature, "left")
    return out.withColumn(label, F.when(F.col("__n") == 1, F.coalesce("__label", F.lit(pending))).otherwise(pending)).drop("__n", "__label")


def correct(rows: DataFrame, corrections: DataFrame, key: str, signature: str, label: str) -> DataFrame:
    """rows with corrected labels; a correction whose signature differs, or which is there twice, is an error."""
    c = corrections.groupBy(key).agg(F.first(signature).alias("__s"), F.first(label).alias("__new"), F.count("*").alias("__n"))
    joined = rows.join(c, key, "left")
    fine = F.col("__n").isNull() | ((F.col("__n") == 1) & F.col("__s").eqNullSafe(F.col(signature)))
    message = F.concat(F.lit("correction does not match: "), F.col(key).cast("string"))
    value = F.when(fine, F.coalesce("__new", label)).otherwise(F.raise_error(message))
    return joined.withColumn(label, value).drop("__s", "__new", "__n")


def by_identity(rows: DataFrame, identity: list[str], order: str, member: str) -> DataFrame:
    """One row for each identity in first-seen order: its columns, first place, members in order and their number."""
    g = rows.groupBy(*identity).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(member).alias("m")))).alias("x"))
    return g.select(*identity, "first", F.transform("x", lambda s: s.m).alias("members"), F.size("x").cast("long").alias("n"))


def pending(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a finished row: what a resumed run still has to do."""
    return jobs.join(done.select(*keys), keys, "left_anti")


def proposals(left: DataFrame, right: DataFrame, group: str, score: Column, top: int) -> DataFrame:
    """For each left_id the best right_ids of its group with a positive score: higher scores first, then smaller ids."""
    order = Window.partitionBy(group, "left_id").orderBy(F.desc("score"), "right_id")
    pairs = left.join(right, group).withColumn("score", score).where("score > 0")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select(group, "left_id", "right_id", "score", "place")
