"""Substring dedup: suffix automata of reference shards find repeated runs of words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, Memory, drop, row_name, store

#: Words of a window, words of an anchor.
WINDOW, ANCHOR = 35, 8
#: Words remembered by a Python worker.
CACHE_WORDS = 300_000
#: Different segments of an anchor up to which they make one automaton; windows of the rest are counted.
MOST_IN_SHARD = 2_000
#: Words of documents that are cut into segments together.
CUT_WORDS = 400_000
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_words = re.compile(WORD).findall
_known = Memory(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), CACHE_WORDS)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[str]:
    return _words(text) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of each run of ``length`` words."""
    n = len(h) - length + 1
    out = np.full(n, length, dtype=np.uint64)
    for i in range(length):
        out = out * _STEP + h[i : n + i]
    return _mix(out)


def segments(h: np.ndarray, ends: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and stop (of window starts) of each segment of documents whose words are joined in h.

    ``ends`` has for each word the end of its document. A window's anchor is its least run of ``anchor`` words,
    the leftmost if equal. It depends on the window's words alone, so equal windows have equal anchors at equal
    places. Consecutive windows that share one anchor occurrence are a segment, and every window is in exactly one.
    """
    starts = len(h) - window + 1
    none = np.zeros(0, dtype=np.int64)
    if starts < 1:
        return none.astype(np.uint64), none, none
    runs = _runs(h, anchor)
    width = window - anchor + 1
    # Sliding minimum by doubling; on a tie the left one stays.
    span, best = 1, np.arange(len(runs))
    while 2 * span <= width:
        left, right = best[: len(best) - span], best[span:]
        best = np.where(runs[right] < runs[left], right, left)
        span *= 2
    left, right = best[:starts], best[width - span : width - span + starts]
    best = np.where(runs[right] < runs[left], right, left)
    inside = np.flatnonzero(np.arange(starts) + window <= ends[:starts])  # windows that cross into the next document are none
    if not len(inside):
        return none.astype(np.uint64), none, none
    best, owner = best[inside], ends[inside]
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(inside)) - 1
    return runs[best[at]], inside[at], inside[last] + 1


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with in how many places each state occurs.

    A sequence is added once, with the number of places in which it stands.
    """

    def __init__(self) -> None:
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def add(self, words: list[int], times: int = 1) -> None:
        go, link, length, ends = self.go, self.link, self.length, self.ends
        last = 0
        for w in words:
            old = go[last].get(w)
            if old is not None:  # the prefix is there from an earlier sequence
                if length[old] == length[last] + 1:
                    ends[old] += times
                    last = old
                    continue
                last = self._clone(last, w, old)
                ends[last] += times
                continue
            new = len(go)
            go.append({})
            length.append(length[last] + 1)
            ends.append(times)
            link.append(0)
            p = last
            while p >= 0 and w not in go[p]:
                go[p][w] = new
                p = link[p]
            if p >= 0:
                q = go[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.go)
        self.go.append(dict(self.go[q]))
        self.length.append(self.length[p] + 1)
        self.ends.append(0)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = new
            p = self.link[p]
        return new

    def close(self) -> None:
        """Sum up how often states occur; call it once all sequences are in."""
        for s in sorted(range(1, len(self.go)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]

    def repeated(self, words: list[int], window: int) -> list[bool]:
        """For each window of words: whether it occurs in two places at least, by matching statistics."""
        state = matched = 0
        out = []
        for i, w in enumerate(words):
            while state and w not in self.go[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.go[state]:
                state, matched = self.go[state][w], matched + 1
            if i + 1 >= window:
                # The state of the window itself is the one on the way to the root that still holds its length.
                s = state
                while s > 0 and self.length[self.link[s]] >= window:
                    s = self.link[s]
                if s != state:
                    state, matched = s, min(matched, self.length[s])
                out.append(matched >= window and self.ends[s] >= 2)
        return out


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most_in_shard: int = MOST_IN_SHARD) -> DataFrame:
    """row, first, stop (of window starts) for runs of windows that also start elsewhere.

    ``docs`` has row (long, the same for equal texts only) and text. First every segment of every document goes, as
    two hashes, to its anchor; a segment whose anchor occurs nowhere else has no window that does. All others,
    copies included, are decided by automata: each different segment of an anchor is fetched once, and the segments
    of an anchor are a shard of the reference. Its suffix automaton holds each with the number of its places, and the
    segments are streamed past it. Shards meet their segments by the anchor rather than by a broadcast, since equal
    windows share their anchor. An anchor with more than ``most_in_shard`` different segments would make one
    task's automaton too large; the windows of its segments are counted by a sum over the cluster instead,
    with the same result. Segments and windows are named by 64 bits, and compared only within their anchor.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            sizes = np.array([len(x) for x in held])
            end = np.cumsum(sizes)
            h, start = np.concatenate(held), end - sizes
            a, first, stop = segments(h, np.repeat(end, sizes), window, anchor)
            doc = np.searchsorted(end, first, side="right")
            made = pd.DataFrame(
                {
                    "row": np.array(rows, dtype=np.int64)[doc], "anchor": a.view(np.int64), "name": _spans(h, first, stop + window - 1).view(np.int64),
                    "first": (first - start[doc]).astype(np.int32), "stop": (stop - start[doc]).astype(np.int32),
                }
            )
            rows.clear()
            held.clear()
            return made

        size = 0
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                h = word_hashes(split_words(text))
                if len(h) >= window:
                    rows.append(row)
                    held.append(h)
                    size += len(h)
                if size >= CUT_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    all_ = store(docs.select("row", "text").mapInPandas(cut, "row long, anchor long, name long, first int, stop int"), "sub-segments")
    # One row for each different segment; the place of one of its occurrences is enough.
    kinds = all_.groupBy("anchor", "name").agg(F.count("*").alias("m"), F.min(F.struct("row", "first", "stop")).alias("at"))
    kinds = store(kinds, "sub-kinds")
    crowd = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("m").alias("places")).where("places > 1").drop("places")
    open_ = store(kinds.join(crowd, "anchor").select("anchor", "name", "m", "at.*", (F.col("kinds") > most_in_shard).alias("crowded")), "sub-open")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                h = word_hashes(split_words(text))
                for w in wanted:
                    words = h[w["first"] : w["stop"] + window - 1]
                    windows = _runs(words, window).view(np.int64) if w["crowded"] else None
                    out.append((w["anchor"], w["name"], w["m"], None if w["crowded"] else words.tobytes(), windows))
            yield pd.DataFrame(out, columns=["anchor", "name", "m", "words", "windows"], dtype=object)

    wanted = open_.groupBy("row").agg(F.collect_list(F.struct("anchor", "name", "m", "first", "stop", "crowded")).alias("wanted"))
    texts = docs.select("row", "text").join(wanted, "row").dropDuplicates(["row"]).select("text", "wanted")
    texts = store(texts.mapInPandas(fetch, "anchor long, name long, m long, words binary, windows array<long>"), "sub-words")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor_now: int | None = None
        held: list[tuple[int, int, bytes]] = []

        def shard() -> list[tuple[int, int, int, int]]:
            sequences = [np.frombuffer(w, np.uint64).tolist() for _, _, w in held]
            automaton = SuffixAutomaton()
            for (_, m, _), s in zip(held, sequences, strict=True):
                automaton.add(s, m)
            automaton.close()
            out = []
            for (name, _, _), s in zip(held, sequences, strict=True):
                hit = automaton.repeated(s, window)
                i = 0
                while i < len(hit):
                    j = i
                    while j < len(hit) and hit[j]:
                        j += 1
                    if j > i:
                        out.append((anchor_now, name, i, j))
                    i = j + 1
            held.clear()
            return out

        for batch in batches:  # sorted by anchor, so that each shard is a run of rows
            out = []
            for key, name, m, words in zip(batch["anchor"].tolist(), batch["name"].tolist(), batch["m"].tolist(), batch["words"], strict=True):
                if key != anchor_now and held:
                    out += shard()
                anchor_now = key
                held.append((name, m, words))
            yield pd.DataFrame(out, columns=["anchor", "name", "i", "j"])
        if held:
            yield pd.DataFrame(shard(), columns=["anchor", "name", "i", "j"])

    shards = texts.where("words IS NOT NULL").drop("windows")
    spots = texts.where("words IS NULL").select("anchor", "name", "m", F.posexplode("windows").alias("i", "window"))
    twice = spots.groupBy("anchor", "window").agg(F.sum("m").alias("times")).where("times > 1").select("anchor", "window")
    counted = spots.join(twice, ["anchor", "window"], "left_semi").select("anchor", "name", "i", (F.col("i") + 1).alias("j"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = shards.repartition(parts, "anchor").sortWithinPartitions("anchor")
    matched = dealt.mapInPandas(match, "anchor long, name long, i int, j int")
    some = store(matched.unionByName(counted), "sub-some")
    drop(texts)
    at = all_.select("anchor", "name", "row", "first").join(some, ["anchor", "name"])
    return at.select("row", (F.col("first") + F.col("i")).alias("first"), (F.col("first") + F.col("j")).alias("stop"))


def _spans(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of the words [first, end) for each pair."""
    power = np.cumprod(np.full(len(h) + 1, _STEP, dtype=np.uint64))
    sums = np.concatenate([[_U(0)], np.cumsum(h * power[:-1])])
    inverse = _U(pow(int(_STEP), -1, 2**64))
    back = np.cumprod(np.full(len(h) + 1, inverse, dtype=np.uint64))
    return _mix((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most_in_shard: int = MOST_IN_SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by spaces) for each row of docs (doc_id, text).

    Each word covered by a window of ``window`` words whose word sequence also starts anywhere else
    goes, in the first place as in all others; windows are judged on the input. Null texts and texts
    shorter than a window lose nothing. Repeated rows and rows with one doc_id are rows of their own,
    so whole copies go. An empty table gives no rows; other columns are ignored.
    """
    # A row's name comes from its content, so that any reading gives it again; equal rows have equal windows.
    rows = docs.select("doc_id", "text", row_name().alias("row"))
    found = repeated_windows(rows, window, anchor, most_in_shard)
    hits = found.groupBy("row").agg(F.collect_set(F.struct("first", "stop")).alias("hits"))

    @F.pandas_udf("struct<n_words: long, n_removed: long, kept: string>")
    def strip(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, hits, strict=True):
            words = split_words(text)
            gone = np.zeros(len(words) + 1, dtype=np.int32)
            for s in spans if spans is not None else ():
                gone[s["first"]] += 1
                gone[s["stop"] + window - 1] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            out.append((len(words), int(len(words) - keep.sum()), " ".join(w for w, k in zip(words, keep, strict=True) if k)))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    joined = rows.join(hits, "row", "left")
    return joined.select("doc_id", strip("text", "hits").alias("r")).select("doc_id", "r.*")
