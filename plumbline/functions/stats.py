"""Ratios, percentiles and sums as the metrics define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b; null, not zero, on a zero denominator."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def prf(tp: Column, fp: Column, fn: Column, digits: int = 6) -> list[Column]:
    """precision, recall and f1; each null where it has no denominator."""
    return [ratio(tp, tp + fp, digits).alias("precision"), ratio(tp, tp + fn, digits).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, digits).alias("f1")]


def nearest_rank(column: str, p: float) -> Column:
    """The value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def linear(column: str, p: float) -> Column:
    """The percentile by linear interpolation between ranks."""
    return F.percentile(F.col(column), F.lit(p))


def gib(column: str | Column, digits: int = 6) -> Column:
    """Bytes as GiB."""
    return F.round((F.col(column) if isinstance(column, str) else column) / 2**30, digits)


def strict_sum(column: str | Column) -> Column:
    """Sum that is null as soon as one value is missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
