"""Cross-tokenizer alignment through a dictionary of distinct groups of token ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, store

#: Characters of a text that are encoded at a time, up to the next place where both tokenizers start anew.
PIECE = 1 << 16
#: Names of groups that a Python worker remembers, and words of up to LONGEST characters with their groups, in two generations; words encoded at once.
CACHE_NAMES, CACHE_WORDS, LONGEST, LEARNT = 500_000, 150_000, 64, 20_000
#: A group in more than this part of all (document, group) rows is broadcast; there can be HOT_PARTS such groups at most.
HOT_PARTS = 100_000

#: What a cut before a space must not follow: white space, controls and other characters that engines class differently.
_ODD = r"\s\x00-\x20\x7f-\xa0\xad\u0600-\u0605\u061c\u06dd\u070f\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff\ufff0-\uffff"
#: Whether such a character stands before a space or at the end.
_odd = re.compile(f"[{_ODD}](?: |\\Z)").search
_place = re.compile(f"(?<=[^{_ODD}]) ").search
#: Texts of these characters, whose classes no Unicode version and no engine tells apart.
_plain = re.compile("[\\t\\n\\r\x20-\x7e\xa1-\xac\xae-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*").fullmatch
_gap = re.compile(r"\s{1000}").search
# Fixed value: how byte-level tokenizers of the usual make cut a text before they pair.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Names(dict):
    """The text of a group, by both ids in one number if it has one A and one B token, else by both lists of ids."""

    def __missing__(self, ids: int | tuple[tuple, tuple]) -> str:
        if len(self) >= CACHE_NAMES:
            self.clear()
        name = f"{ids >> 32}|{ids & 0xFFFFFFFF}" if isinstance(ids, int) else "|".join(",".join(map(str, x)) for x in ids)
        self[ids] = name
        return name


class TwoTokenizers:
    """Token ids of a text by a byte-level tokenizer (A) and by pieces with byte fallback (B), and the groups they form.

    A long text is encoded in pieces: A splits a text before every space that follows other characters, before it pairs, and
    where no piece of B has a space after another character, B does not join over it either. Where A is of the usual make, plain
    texts go to the faster of two libraries that pair by the same merges.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)]
        shown = {chr(256 + i): b for i, b in enumerate(odd)} | {chr(b): b for b in range(256) if b not in odd}
        vocabulary = self.a.get_vocab()
        bytes_a = {i: bytes(map(shown.__getitem__, t)) if all(c in shown for c in t) else t.encode() for t, i in vocabulary.items()}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.fast = self._faster(path_a, vocabulary, shown)
        self.names = _Names()
        self.units: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    @staticmethod
    def _faster(path: str, vocabulary: dict[str, int], shown: dict[str, int]):
        """The same tokenizer from ranks, if it cuts texts by the usual pattern alone and its ids are in the order of its merges."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges") or []]
        ids = [vocabulary.get(m.replace(" ", ""), -1) for m in merges]
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model.get("type") == "BPE"
        if not usual or made.get("normalizer") or made.get("post_processor") or not ids or ids != sorted(set(ids)) or ids[0] < 256:
            return None
        added = {t["content"] for t in made.get("added_tokens") or []}
        ranks = {bytes(map(shown.__getitem__, t)): i for t, i in vocabulary.items() if t not in added}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _pieces(self, text: str) -> Iterator[str]:
        start = 0
        while self.apart and len(text) - start > PIECE and (found := _place(text, start + PIECE)):
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def _ids_a(self, piece: str) -> np.ndarray:
        if self.fast and _plain(piece) and not _gap(piece):
            return self.fast.encode_to_numpy(piece, disallowed_special=()).astype(np.int64)
        return np.array(self.a.encode(piece, add_special_tokens=False).ids, dtype=np.int64)

    def _ids_b(self, piece: str) -> np.ndarray:
        """Word by word, if single spaces part the words and no piece of B has a space inside."""
        if not self.apart or "  " in piece or piece.endswith(" "):
            return np.array(self.b.encode(piece[1:]) if piece != " " else [self.space], dtype=np.int64)
        return np.fromiter(chain.from_iterable(self.b.encode(piece[1:].split(" "), num_threads=1)), np.int64)

    def _groups(self, piece: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]] | None:
        """Of a text that begins with a space: where A and B tokens end, where groups end, the groups; None if the bytes of either side differ from it."""
        a, b = self._ids_a(piece), self._ids_b(piece)
        in_a, in_b = a.tolist(), b.tolist()
        if not b"".join(map(self.bytes_a.__getitem__, in_a)) == b"".join(map(self.bytes_b.__getitem__, in_b)) == piece.encode():
            return None
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at = np.searchsorted(ends_b, ends_a)  # both end with the text
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b = at[last_a]
        first_a, first_b = (np.concatenate([[0], x[:-1] + 1]) for x in (last_a, last_b))
        keys = (a[last_a] << 32 | b[last_b]).tolist()
        longer = np.flatnonzero((first_a < last_a) | (first_b < last_b))
        for k, i, j, m, n in zip(*(x.tolist() for x in (longer, first_a[longer], last_a[longer], first_b[longer], last_b[longer])), strict=True):
            keys[k] = (tuple(in_a[i : j + 1]), tuple(in_b[m : n + 1]))
        return ends_a, ends_b, ends_a[last_a], list(map(self.names.__getitem__, keys))

    def words_of(self, text: str) -> list[str] | None:
        """The words of a text whose tokens are those of its words with a space before each; null if that can't be told."""
        if not (self.apart and self.fast) or len(text) > 16 * PIECE or text[:1] in ("", " ") or not _plain(text) or _odd(text):
            return None
        words = text.split(" ")
        return None if len(max(words, key=len)) > LONGEST else words

    def learn(self, words: set[str]) -> None:
        """Remember the groups of words: those that are new are encoded as one text and cut apart."""
        if len(self.units) > CACHE_WORDS:
            self.older, self.units = self.units, {}
        known = {w: x for w in words if w not in self.units and (x := self.older.get(w))}
        new = [w for w in words if w not in self.units and w not in known]
        self.units.update(known)
        for i in range(0, len(new), LEARNT):
            some = new[i : i + LEARNT]
            found = self._groups(" " + " ".join(some))
            if found is None:  # some word is not given back, and so no text that holds it
                each = [(w, self._groups(" " + w)) for w in some]
                self.units.update((w, x and (len(x[0]), len(x[1]), tuple(x[3]), ";".join(x[3]))) for w, x in each)
                continue
            ends_a, ends_b, ends, groups = found
            stops = np.cumsum([len(w.encode()) + 1 for w in some])
            cuts = (np.concatenate([[0], np.searchsorted(x, stops, side="right")]) for x in (ends_a, ends_b, ends))
            in_a, in_b, at = (x.tolist() for x in cuts)
            for k, word in enumerate(some):
                own = tuple(groups[at[k] : at[k + 1]])
                self.units[word] = (in_a[k + 1] - in_a[k], in_b[k + 1] - in_b[k], own, ";".join(own))

    def align(self, text: str | None, words: list[str] | None = None) -> tuple[int, int, int, str, dict[str, int]]:
        """n_a, n_b, n_groups, digest of all groups in order, and how often each group occurs; ``words`` are known ones from words_of()."""
        if words is not None:
            known = list(map(self.units.__getitem__, words))
            if None in known:
                return 0, 0, 0, "", {}
            n_a, n_b, groups, shown = zip(*known, strict=True)
            tally = Counter(chain.from_iterable(groups))
            return sum(n_a), sum(n_b), tally.total(), hashlib.sha256(";".join(shown).encode()).hexdigest(), tally
        n_a, n_b, tally, digest = 0, 0, Counter(), None
        for piece in self._pieces(" " + text) if text else ():
            found = self._groups(piece)
            if found is None:
                return 0, 0, 0, "", {}
            n_a, n_b = n_a + len(found[0]), n_b + len(found[1])
            tally.update(found[3])
            if digest is None:
                digest = hashlib.sha256()
            else:
                digest.update(b";")
            digest.update(";".join(found[3]).encode())
        return n_a, n_b, tally.total(), digest.hexdigest() if digest else "", tally


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    return TwoTokenizers(path_a, path_b)


def groups_of(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A table of all rows: row, doc_id, n_a, n_b, n_groups, groups_sha256, groups (array of g and n, its occurrences)."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(path_a, path_b)
        for batch in batches:
            n_a, n_b, n_groups, digests, starts, names, times = [], [], [], [], [0], [], []
            texts = batch.column("text").to_pylist()
            words = [both.words_of(t) if t else None for t in texts]
            both.learn(set(chain.from_iterable(w for w in words if w)))
            for text, known in zip(texts, words, strict=True):
                a, b, n, digest, tally = both.align(text, known)
                n_a.append(a)
                n_b.append(b)
                n_groups.append(n)
                digests.append(digest)
                names.extend(tally)
                times.extend(tally.values())
                starts.append(len(names))
            each = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64())], ["g", "n"])
            counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]
            arrays = [batch.column("row"), batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), each)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups"])

    made = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups array<struct<g: string, n: long>>"
    return store(rows.mapInArrow(encode, made), "aligned")


def dictionary(aligned: DataFrame) -> DataFrame:
    """A table of the distinct groups: g, n (occurrences in all documents), docs (documents that hold it)."""
    each = aligned.select(F.explode("groups").alias("x"))
    return store(each.groupBy(F.col("x.g").alias("g")).agg(F.sum("x.n").alias("n"), F.count("*").alias("docs")), "groups")


def links_of(groups: DataFrame) -> DataFrame:
    """The links of each distinct group: g, n, docs, a, b.

    A link joins an A token and a B token that end at one byte. A group ends at the first byte where tokens of both sides do, so
    it has one link, between its last tokens.
    """
    a, b = F.substring_index("g", "|", 1), F.substring_index("g", "|", -1)
    return groups.select("*", *[F.substring_index(x, ",", -1).cast("int").alias(name) for x, name in ((a, "a"), (b, "b"))])


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count (links in all documents), best (no A id has more with this B id)."""
    counts = store(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    tops = counts.groupBy("b").agg(F.max("count").alias("top"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(tops), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


@small_batches
def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every row with doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A group is the tokens of both sides between two bytes where tokens of both end. Distinct groups are interned in a dictionary
    with their frequency; links are expanded once for each of them and multiplied by it, and what a group's links amount
    to goes back to the documents by group. Groups of over one in HOT_PARTS of all (document, group) rows, HOT_PARTS at most, go to
    all tasks; the others meet their rows in a shuffle.

    A text that is null, empty or not given back by either tokenizer has no tokens: zeros and an empty digest. Repeated rows
    and doc_ids each count; a null doc_id stays. Other columns are ignored; an empty table gives no rows.
    """
    aligned = groups_of(docs, path_a, path_b)
    known = dictionary(aligned)
    links = links_of(known)
    per_group = links.join(pair_counts(links), ["a", "b"]).groupBy("g").agg(
        F.first("docs").alias("docs"),
        F.count("*").alias("links"),
        F.sum(F.col("best").cast("long")).alias("bests"),
        F.sum("count").alias("counts"),
    )
    per_group = store(per_group, "linked")
    total = known.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("s")).first()["s"]
    hot = F.broadcast(per_group.where(F.col("docs") > total // HOT_PARTS).drop("docs"))
    rest = per_group.where(F.col("docs") <= total // HOT_PARTS).drop("docs")
    rows = aligned.select("row", F.explode("groups").alias("x")).select("row", "x.g", "x.n")
    met = rows.join(hot, "g").unionByName(rows.join(hot, "g", "left_anti").join(rest, "g"))
    sums = met.groupBy("row").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("links", "bests", "counts")])
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return aligned.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", zero("links", "n_links"), zero("bests", "n_best"), zero("counts", "count_sum"), "groups_sha256"
    )
