"""Token counts by a linear longest-match automaton over a sub-word vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Memory

WORD_MARK = "▁"
#: Words remembered by a Python worker between batches; the memory is emptied when it is full.
CACHE_WORDS = 400_000


class LongestMatch:
    """Greedy longest-match-first piece counts in one pass over a word.

    A trie over the pieces carries, for each node, a failure link and the number of tokens
    that are popped on the way along it (the pieces that greedy matching has settled when
    the next character doesn't extend the node). A character that is no piece by itself
    counts as its UTF-8 bytes, as tokenizers with byte fallback count it, so a match never
    fails; that weight is stored like a piece's.
    """

    def __init__(self, pieces: Iterable[str]):
        pieces = [p for p in pieces if p]
        known = set(pieces)
        weights = {p: 1 for p in pieces} | {c: len(c.encode()) for p in pieces for c in p if c not in known}
        self.go: list[dict[str, int]] = [{}]
        weight = [0]
        for piece, w in weights.items():
            node = 0
            for c in piece:
                nxt = self.go[node].get(c)
                if nxt is None:
                    nxt = self.go[node][c] = len(self.go)
                    self.go.append({})
                    weight.append(0)
                node = nxt
            weight[node] = w
        self.fail = [0] * len(self.go)
        self.popped = [0] * len(self.go)
        level = [(0, c, n) for c, n in self.go[0].items()]
        while level:  # by depth, so that the links of shorter nodes are there
            below = []
            for parent, c, node in level:
                if weight[node]:  # the node is itself a piece: it is popped and matching starts anew
                    self.fail[node], self.popped[node] = 0, weight[node]
                else:
                    at, count = self.fail[parent], self.popped[parent]
                    while c not in self.go[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    self.fail[node], self.popped[node] = self.go[at][c], count
                below += [(node, d, n) for d, n in self.go[node].items()]
            level = below

    def count(self, word: str) -> int:
        """Number of tokens of the greedy segmentation of word."""
        go, fail, popped = self.go, self.fail, self.popped
        node = total = 0
        for c in word:
            while c not in go[node]:
                if not node:
                    total += len(c.encode())
                    break
                total += popped[node]
                node = fail[node]
            else:
                node = go[node][c]
        while node:
            total += popped[node]
            node = fail[node]
        return total


@lru_cache(maxsize=4)
def automaton(vocabulary: str) -> LongestMatch:
    """The automaton of a sentencepiece model file or of a text file with one piece a line."""
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    else:
        with open(vocabulary, encoding="utf-8") as lines:
            pieces = [line.rstrip("\n") for line in lines]
    return LongestMatch(pieces)


_words = re.compile(WORD).findall


@lru_cache(maxsize=4)
def _memory(vocabulary: str) -> Memory:
    match = automaton(vocabulary)
    return Memory(lambda word: match.count(WORD_MARK + word), CACHE_WORDS)


def count_text(text: str | None, vocabulary: str) -> tuple[int, int]:
    """Words and tokens of one text."""
    words = _words(text or "")
    return len(words), sum(map(_memory(vocabulary).__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with n_words and n_tokens (long): greedy longest-match tokens of each whole text.

    A word is a run of non-space characters and is matched with the word mark in front. No
    shuffle; each row stands alone. A null or blank text has 0 of both; ties and repeated rows
    play no part; an empty table gives no rows. Columns of docs named n_words or n_tokens are
    replaced, all others are kept.
    """

    @F.pandas_udf("struct<n_words: long, n_tokens: long>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = np.array([count_text(x, vocabulary) for x in texts], dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame(found, columns=["n_words", "n_tokens"])

    out = docs.drop("n_words", "n_tokens").withColumn("__counts", counts(F.col(text)))
    return out.select(*[c for c in out.columns if c != "__counts"], "__counts.n_words", "__counts.n_tokens")
