"""Functions that SQL text can call: table functions and grouped aggregates in Python, registered for a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import SPAN_CHARS, _spans_of


class ClauseSpans:
    """clause_spans(text, most): a row for each clause of a text; see text.split_spans()."""

    def eval(self, text: str, most: int = SPAN_CHARS) -> Iterator[tuple]:
        yield from _spans_of(text, most)


class GreedyWindows:
    """greedy_windows(TABLE(..) PARTITION BY key ORDER BY place, most_spans, most_chars): windows over the spans of a key.

    The table has key, place and size. A window is closed when one more span would exceed either bound; rows come as they
    are ordered, and only the open window's sums are kept.
    """

    def __init__(self) -> None:
        self.window = self.spans = self.chars = 0

    def eval(self, row, most_spans: int, most_chars: int) -> Iterator[tuple]:
        if not self.window or self.spans >= most_spans or self.chars + row["size"] > most_chars:
            self.window, self.spans, self.chars = self.window + 1, 0, 0
        self.spans, self.chars = self.spans + 1, self.chars + row["size"]
        yield row["key"], row["place"], self.window

    def terminate(self) -> None:
        return


def matched_in_turn(alarm: pd.Series, may: pd.Series) -> list:
    """matched_in_turn(alarm, may), grouped: each alarm in order takes the first of its sorted choices that no earlier one took."""
    gone, out = set(), []
    for a, choices in sorted(zip(alarm, may, strict=True), key=lambda x: x[0]):
        free = next((g for g in sorted(choices) if g not in gone), None)
        if free is not None:
            gone.add(free)
        out.append({"alarm": a, "matched": free})
    return out


def register(spark: SparkSession) -> None:
    """Make the functions of this module known to the session's SQL."""
    spark.udtf.register("clause_spans", F.udtf(ClauseSpans, returnType="id: string, text: string, start: int, stop: int"))
    spark.udtf.register("greedy_windows", F.udtf(GreedyWindows, returnType="key: long, place: int, window: int"))
    spark.udf.register("matched_in_turn", F.pandas_udf(matched_in_turn, "array<struct<alarm: long, matched: string>>"))
