"""Ordered sequences: windows that close by size, islands, traces, batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.scratch import scratch

# Spans and characters of a window, spans of context before it.
WINDOW_SPANS, WINDOW_CHARS, CONTEXT_SPANS = 8, 180, 2


def _starts(sizes: np.ndarray, most_items: int, most_size: int) -> list[int]:
    """Index of the first item of each window."""
    out, n, chars = [], 0, 0
    for i, size in enumerate(sizes):
        if not n or n >= most_items or chars + size > most_size:
            out.append(i)
            n = chars = 0
        n, chars = n + 1, chars + size
    return out


def greedy_windows(sizes: Column, most_items: int = WINDOW_SPANS, most_size: int = WINDOW_CHARS) -> Column:
    """Window number of each item of an array of sizes, from 1.

    A window closes before an item that would be one too many or exceed the size; an item alone may exceed it. The
    sum starts anew at each window, which no SQL frame does, and Spark's aggregate() would copy the numbers
    for each item, so it is an Arrow function over the document's own array.
    """

    @F.pandas_udf("array<int>")
    def numbers(rows: pd.Series) -> pd.Series:
        def one(row: np.ndarray | None) -> np.ndarray | None:
            if row is None:
                return None
            new = np.zeros(len(row), dtype=np.int32)
            new[_starts(row, most_items, most_size)] = 1
            return np.cumsum(new, dtype=np.int32)

        return rows.map(one)

    return numbers(F.transform(sizes, lambda x: x.cast("int")))


def windows(docs: DataFrame, doc: str, spans: str) -> DataFrame:
    """doc, window_no, target_ids, context_ids from documents with an array of spans (id, text).

    Ids are cut into windows in one pass over a document's spans, and only then become rows.
    """
    return windows_of(docs, doc, F.transform(spans, lambda s: s.id), F.transform(spans, lambda s: F.length(s.text)))


def windows_of(docs: DataFrame, doc: str, span_ids: Column, span_sizes: Column) -> DataFrame:
    """windows() from arrays of the spans' ids and sizes."""

    @F.pandas_udf("array<struct<window_no: int, target_ids: array<string>, context_ids: array<string>>>")
    def cut(ids: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(names: np.ndarray | None, row: np.ndarray | None) -> list[dict]:
            if names is None:
                return []
            at = _starts(row, WINDOW_SPANS, WINDOW_CHARS)
            ends = [*at[1:], len(names)] if at else []
            return [{"window_no": k + 1, "target_ids": list(names[a:b]), "context_ids": list(names[max(0, a - CONTEXT_SPANS) : a])} for k, (a, b) in enumerate(zip(at, ends, strict=True))]

        return pd.Series([one(*x) for x in zip(ids, sizes, strict=True)], dtype=object)

    return docs.select(doc, F.explode(cut(span_ids, span_sizes)).alias("w")).select(doc, "w.*")


def recovery_context(ids: Column, missing: Column, before: int = CONTEXT_SPANS) -> Column:
    """Up to ``before`` neighbours ahead of each missing id, without the missing ones, each once and in order."""
    near = F.flatten(F.transform(missing, lambda m: F.slice(ids, F.greatest(F.lit(1), F.array_position(ids, m).cast("int") - before), F.least(F.lit(before), F.array_position(ids, m).cast("int") - 1))))
    return F.filter(ids, lambda i: F.array_contains(near, i) & ~F.array_contains(missing, i))


def islands(rows: DataFrame, group: str, start: str, stop: str, text: str) -> DataFrame:
    """group, island, start, stop, text: runs of rows of which each begins where the one before ends."""
    w = Window.partitionBy(group).orderBy(start)
    new = F.coalesce((F.lag(stop).over(w) != F.col(start)).cast("int"), F.lit(1))
    rows = rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy(group, "island").agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.array_sort(F.collect_list(F.struct(start, text))).alias("x"))
    return g.select(group, "island", "start", "stop", F.array_join(F.transform("x", lambda s: s[text]), "").alias("text"))


def first_divergence(left: DataFrame, right: DataFrame, trace: str, step: str, value: str) -> DataFrame:
    """trace, step: the first step at which two traces differ or one has ended; null if they agree."""
    a, b = left.select(trace, step, F.col(value).alias("__a")), right.select(trace, step, F.col(value).alias("__b"))
    both = a.join(b, [trace, step], "full")
    return both.groupBy(trace).agg(F.min(F.when(~F.col("__a").eqNullSafe(F.col("__b")), F.col(step))).alias("step"))


def micro_batches(times: Column, most: int, wait_us: int) -> Column:
    """Batch number of each arrival (sorted microseconds): a batch closes when it is full or its first one has waited.

    Where a batch begins depends on where the one before did, so it is one pass over a queue's own array.
    """

    @F.pandas_udf("array<int>")
    def numbers(rows: pd.Series) -> pd.Series:
        def one(row: np.ndarray | None) -> np.ndarray | None:
            if row is None:
                return None
            out, at, batch = np.zeros(len(row), dtype=np.int32), 0, 0
            while at < len(row):
                batch += 1
                stop = min(at + most, int(np.searchsorted(row, row[at] + wait_us, side="right")))
                out[at:stop] = batch
                at = stop
            return out

        return rows.map(one)

    return numbers(times)


def left_pad(tokens: Column, width: Column, pad: int) -> Column:
    """tokens with padding in front up to width."""
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(width - F.size(tokens), F.lit(0))), tokens)


def padding(rows: DataFrame, batch: str, length: str) -> DataFrame:
    """batch, rows, tokens, padded, wasted: what padding to the longest row of a batch costs."""
    g = rows.groupBy(batch).agg(F.count("*").alias("rows"), F.sum(length).alias("tokens"), F.max(length).alias("longest"))
    return g.select(batch, "rows", "tokens", (F.col("rows") * F.col("longest")).alias("padded"), (F.col("rows") * F.col("longest") - F.col("tokens")).alias("wasted"))


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """rows with their place in the order, counted from ``first``; rows are dealt by ranges and counted there, so no task holds all.

    The order must be total: rows are sorted once, written, and the counts of the ranges before are added.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    dealt = scratch(dealt, "numbered")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__m"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"))  # one row for each range
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__at", place).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__at") + (first - 1)).cast("long")).drop("__part", "__at", "__before")
