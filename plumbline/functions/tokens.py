"""Tokens of texts by a tokenizer file: counts for budgets, offsets, and where a text would be cut off."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    """The tokenizer of a file, once for a process; special tokens in texts count as plain text."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_truncation()
    made.no_padding()
    return made


class TokenCounter:
    """Counts a text's tokens and the special ones that an encoder puts around it; what corpus.chunks() takes as count_tokens.

    Only the file's path travels to the tasks.
    """

    def __init__(self, path: str, special: int = 2):
        self.path, self.special = path, special

    def __call__(self, text: str) -> int:
        return len(_tokenizer(self.path).encode(text, add_special_tokens=False)) + self.special


def offsets(text: Column, path: str) -> Column:
    """array of struct(start, stop): the characters of each token, stops exclusive; a null text has none."""

    @F.pandas_udf("array<struct<start: int, stop: int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = _tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
            yield pd.Series([[{"start": a, "stop": b} for a, b in e.offsets] for e in found], dtype=object)

    return find(text)


def inspect(rows: DataFrame, path: str, most: int, text: str = "text", special: int = 2, prefix: str = "") -> DataFrame:
    """rows with tokens (special ones counted), truncated (more than ``most``) and cut_at: the character from which an encoder would not read on.

    ``prefix`` stands before every text, as an encoder of queries puts it; cut_at counts in the text itself, and is its length
    where nothing is cut off.
    """
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    found = rows.withColumn("__t", offsets(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))), path))
    n = F.size("__t") + special
    cut = F.greatest(F.get("__t", F.lit(most - special)).start - len(prefix), F.lit(0))
    return found.select(*rows.columns, n.cast("long").alias("tokens"), (n > most).alias("truncated"), F.when(n > most, cut).otherwise(size).cast("long").alias("cut_at"))
