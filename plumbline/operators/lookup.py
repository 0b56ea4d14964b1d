"""Which of many names stand inside texts, by an automaton over the names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names, and characters of them, that one automaton holds and all tasks receive; more names are taken in blocks.
MOST_NAMES, MOST_CHARS = 200_000, 16_000_000


def _block(names: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, name)
    found.make_automaton()
    return found


def inside(texts: DataFrame, key: str, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """key, name: distinct names (not empty) that occur in a text, wherever they begin.

    One pass over the texts for each block of names finds all of them at once, so texts and names never meet in pairs.
    Texts with a null key, null texts and null names match nothing.
    """
    out = None
    block: list[str] = []
    size = 0

    def search(some: list[str]) -> DataFrame:
        held = texts.sparkSession.sparkContext.broadcast(some)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _block(held.value)
            for batch in batches:
                rows = [(k, n) for k, t in zip(batch[key], batch[text], strict=True) for n in {found for _, found in automaton.iter(t)}]
                yield pd.DataFrame(rows, columns=[key, name], dtype=object)

        kind = dict(texts.dtypes)[key]
        # Numbers as text: nullable ones would pass through doubles in pandas.
        rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias(key), text)
        return rows.mapInPandas(scan, f"`{key}` string, `{name}` string").withColumn(key, F.col(key).cast(kind))

    for row in names.where(F.length(name) > 0).select(name).distinct().toLocalIterator():
        if len(block) >= MOST_NAMES or size >= MOST_CHARS:
            out = search(block) if out is None else out.unionByName(search(block))
            block, size = [], 0
        block.append(row[0])
        size += len(row[0])
    if block or out is None:
        out = search(block or ["\0"]) if out is None else out.unionByName(search(block))
    return out
