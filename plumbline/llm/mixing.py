"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import drop, small_enough, store, word_count

# Fixed values of the query contract.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
NEWTON_STEPS, TOLERANCE, REPAIRS = 80, 1e-10, 6
#: Columns that a mix adds.
MADE = ("size", "source_size", "target", "copies")
#: Rows of the class table up to which it is broadcast; beyond, the join is shuffled.
MOST_BROADCAST = 500_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target: words wanted from each source.

    Sources by code point, null last, take the weights in turn and share ``share`` of all
    words; a target stops at ``most`` times its source's size, and what is left over is shared
    again by weight. That is filling to one level per weight: with sources in the order
    of the level at which they are full, the level is the largest one that the rest allows.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    full = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * float(share) - before) / rest
    full = full.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    full = full.withColumn("level", F.max(fits).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return full.select("source", "source_size", "n_docs", target.alias("target"))


def solve_tilts(sizes: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """wanted with ``tilt``: the dual solution of entropy balancing for each source.

    Rates closest to one in relative entropy under the token constraint and the bound are
    min(most, exp(tilt * size / mean size)). All duals are solved together: each Newton step is one
    join and one sum over the table of (source, size, number of documents); a step that leaves the
    bracket becomes a bisection. Sources that are wanted in full have a null tilt.
    """
    top = math.log(most)
    sizes = sizes.where("size > 0")
    span = sizes.groupBy("source").agg(F.min("size").alias("least"))
    state = wanted.join(span, wanted.source.eqNullSafe(span.source), "left").drop(span.source)
    mean = F.col("source_size") / F.col("n_docs")
    full = (F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-12)) | (F.col("source_size") == 0)
    up = F.col("target") > F.col("source_size")
    state = state.withColumns(
        {
            "mean": mean,
            "tilt": F.when(~full, F.lit(0.0)),
            # Below zero every rate is under exp(tilt * least / mean), which bounds the root from below.
            "low": F.when(up, F.lit(0.0)).otherwise(F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size")) * mean / F.col("least")),
            "high": F.when(up, F.lit(top) * mean / F.col("least")).otherwise(F.lit(0.0)),
            "off": F.lit(1.0),
        }
    )
    state = store(state.drop("least"), "tilts")
    for _ in range(NEWTON_STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(top)))
        words = F.col("size") * F.col("n")
        open_rate = F.when(F.col("tilt") * x < top, words * x * rate).otherwise(0.0)
        s = sizes.withColumnRenamed("source", "__s")
        got = (
            s.join(state.select("source", "mean", "tilt").where("tilt IS NOT NULL"), F.col("__s").eqNullSafe(F.col("source")))
            .groupBy("__s")
            .agg(F.sum(words * rate).alias("value"), F.sum(open_rate).alias("slope"))
        )
        new = state.join(got, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        low = F.when(F.col("value") < F.col("target"), F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(F.col("value") < F.col("target"), F.col("high")).otherwise(F.least("high", "tilt"))
        off = F.coalesce(F.abs(F.col("value") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0))
        new = new.withColumns({"low": low, "high": high, "off": off})
        step = F.col("tilt") - F.try_divide(F.col("value") - F.col("target"), F.col("slope"))
        inside = step.isNotNull() & (step > F.col("low")) & (step < F.col("high"))
        moved = F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
        new = new.withColumn("tilt", F.when(F.col("off") <= TOLERANCE, F.col("tilt")).otherwise(moved)).drop("value", "slope")
        last, state = state, store(new, "tilts")
        drop(last)
        if not state.where(F.col("off") > TOLERANCE).limit(1).count():
            break
    else:
        raise RuntimeError(f"tilts did not settle in {NEWTON_STEPS} steps")
    return state.drop("low", "high", "off")


def _classes(sizes: DataFrame, tilts: DataFrame, most: float) -> DataFrame:
    """source, size, n, copies: whole copies of all documents of a source and size together.

    Running sums of the rates, longest documents first, are rounded, so each prefix is
    within half a copy; a few repairs then move copies of the size that fits what a source
    is still short of or has too much.
    """
    t = tilts.withColumnRenamed("source", "__s")
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(most)))))
    classes = sizes.join(t, F.col("source").eqNullSafe(F.col("__s"))).withColumn("rate", F.col("n") * rate)
    upto = F.sum("rate").over(Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    classes = classes.withColumn("upto", upto)
    copies = (F.round("upto") - F.round(F.col("upto") - F.col("rate"))).cast("long")
    limit = F.floor(F.col("n") * float(most))
    classes = classes.withColumn("copies", F.greatest(F.lit(0), F.least(copies, limit)))
    classes = store(classes.select("source", "size", "n", "target", "copies", limit.alias("limit")), "mix-classes")
    for _ in range(REPAIRS):
        short = classes.groupBy(F.col("source").alias("__s")).agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
        near = classes.where("size > 0").join(short, F.col("source").eqNullSafe(F.col("__s")))
        room = F.when(F.col("short") > 0, F.col("limit") - F.col("copies")).otherwise(F.col("copies"))
        move = F.least(room, F.greatest(F.lit(1), F.floor(F.abs("short") / F.col("size"))))
        near = near.withColumn("move", move).where((F.col("move") > 0) & (F.col("size") < 2 * F.abs("short")))
        left = F.abs(F.abs("short") - F.col("move") * F.col("size"))
        pick = F.min_by(F.struct("size", F.signum("short").cast("long") * F.col("move")), F.struct(left, F.col("size")))
        picked = near.groupBy("__s").agg(pick.alias("p")).select("__s", F.col("p.size").alias("__size"), F.col("p.col2").alias("__move"))
        at = F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__size"))
        new = classes.join(picked, at, "left").withColumn("copies", F.col("copies") + F.coalesce("__move", F.lit(0))).drop("__s", "__size", "__move")
        last, classes = classes, store(new, "mix-classes")
        drop(last)
    return classes


def _cuts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """classes with ``base`` copies for each document and ``cut``: hashes up to it get one more.

    The cut is the k-th smallest hash of a class. Counts by the top byte of the hash find the
    byte that holds it, and only rows of that byte are ranked.
    """
    c = classes.withColumns({"base": F.floor(F.col("copies") / F.col("n")), "extra": F.col("copies") % F.col("n")})
    need = c.where("extra > 0").select(F.col("source").alias("__s"), F.col("size").alias("__size"), "extra")
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__size"))
    rows = rows.withColumn("byte", F.shiftright("h", 56))
    counts = rows.groupBy("source", "size", "byte").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("byte").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).join(need, same)
    place = counts.where("upto >= extra AND upto - m < extra").select("__s", "__size", F.col("byte").alias("__byte"), (F.col("extra") - F.col("upto") + F.col("m")).alias("k"))
    inside = rows.join(place, same & (F.col("byte") == F.col("__byte")))
    ranked = inside.withColumn("rn", F.row_number().over(Window.partitionBy("source", "size", "byte").orderBy("h")))
    cut = ranked.where("rn = k").select("__s", "__size", F.col("h").alias("cut"))
    return c.join(cut, same, "left").select("source", "size", "base", "cut")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs with size (words), source_size, target (its source's) and copies (how often to take it).

    copies * size is near target for each source, and no document is taken more than
    ``most`` times. Which documents of a size get the odd copy is settled by a hash of doc_id, so
    reruns agree and repeated rows share one fate. A null text has size 0; documents without words
    are taken as the rates fall and count nothing. A null source is a source, the last. An
    empty table gives no rows. Columns of docs with the names of results are replaced.
    """
    docs = docs.drop(*MADE)
    sized = docs.withColumns({"size": word_count(F.col("text")), "__h": F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix"))})
    rows = store(sized.select("source", "size", F.col("__h").alias("h")), "mix-rows")
    sizes = store(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    wanted = store(targets(sizes, weights, share, most), "mix-targets")
    tilts = solve_tilts(sizes, wanted, most)
    classes = _classes(sizes, tilts, most)
    t = wanted.select(F.col("source").alias("__t"), "source_size", "target")
    plan = _cuts(rows, classes).join(t, F.col("source").eqNullSafe(F.col("__t"))).drop("__t")
    plan = store(plan.select(F.col("source").alias("__s"), F.col("size").alias("__size"), "base", "cut", "source_size", "target"), "mix-plan")
    if small_enough(plan, MOST_BROADCAST):
        plan = F.broadcast(plan)
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__size")))
    copies = F.col("base") + F.coalesce((F.col("__h") <= F.col("cut")).cast("long"), F.lit(0))
    return joined.withColumn("copies", copies.cast("long")).select(*docs.columns, *MADE)


def expand(mixed: DataFrame) -> DataFrame:
    """The rows of mix(), each as often as it is taken, without mix()'s columns."""
    keep = [c for c in mixed.columns if c not in MADE]
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*keep)
