"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop, small_batches, small_enough, store

#: Bytes that are hashed or compared at a time; longer texts than HUGE are dealt out by chunks.
CHUNK, HUGE = 1 << 16, 1 << 17
#: Moduli and bases of the two residues that make a fingerprint.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525_713)
#: Groups of equal fingerprints that are broadcast; more are joined by a shuffle.
MOST_GROUPS = 1_000_000
#: Members of a group that meet one copy of its first text.
PER_SALT = 1_000


@lru_cache(maxsize=8)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * base % prime
    return out


def residues(piece: bytes, at: int = 0, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES) -> list[int]:
    """The sum of byte i times base ** (at + i) modulo each prime, for a piece of any length that begins at byte ``at``.

    Residues of the pieces of a text add up to those of the text, in any order: a piece that stands ``at`` bytes to
    the right is only multiplied by base ** at.
    """
    data, out = np.frombuffer(piece, np.uint8), []
    for base, prime in zip(BASES, primes, strict=True):
        powers, total = _powers(base, prime, chunk), 0
        for start in range(0, len(data), chunk):
            part = data[start : start + chunk].astype(np.int64)
            # At most 65,536 products below 2 ** 39 each: the sum stays below 2 ** 55.
            total += int(part @ powers[: len(part)]) % prime * pow(base, at + start, prime)
        out.append(total % prime)
    return out


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as an empty text."""
    # A single space stays as it is, so only longer runs and other white space are rewritten.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (text, n, others) cut into pieces: at (first byte), piece, others."""
    others = [c for c in rows.columns if c not in ("text", "n")]
    last = F.expr(f"(greatest(n, 1) - 1) div {chunk}")
    each = rows.select(*others, "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("k"))
    at = F.col("k").cast("long") * chunk
    return each.select(*others, at.alias("at"), F.substring("text", at.cast("int") + 1, F.lit(chunk)).alias("piece"))


def _print(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 31) + b


def _fingerprints(docs: DataFrame, chunk: int, huge: int, primes: tuple[int, int]) -> DataFrame:
    """A table of all rows: row, doc_id, text (bytes), n, text_sha256, f."""

    @F.pandas_udf("long")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [residues(t, 0, chunk, primes) for t in texts]
            yield pd.Series([a << 31 | b for a, b in found], dtype="int64")

    @F.pandas_udf("struct<a: long, b: long>")
    def partial(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pieces, starts in batches:
            found = [residues(p, int(s), chunk, primes) for p, s in zip(pieces, starts, strict=True)]
            yield pd.DataFrame(np.array(found, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text", (size > huge).alias("huge"))
    rows = rows.select("doc_id", "huge", normalised(F.col("text")).cast("binary").alias("text"))
    rows = rows.select("huge", "doc_id", "text", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("text_sha256"))
    name = F.monotonically_increasing_id() * 2
    large = store(rows.where("huge").drop("huge").withColumn("row", name + 1), "huge")
    pieces = _chunks(large.select("row", "text", "n"), chunk).repartition("row", "at")
    sums = pieces.select("row", partial("piece", "at").alias("h")).groupBy("row")
    prints = sums.agg(_print(F.pmod(F.sum("h.a"), F.lit(primes[0])), F.pmod(F.sum("h.b"), F.lit(primes[1]))).alias("f"))
    small = rows.where("NOT huge").drop("huge").withColumns({"row": name, "f": whole("text")})
    out = store(small.unionByName(large.join(prints, "row")), "fingerprints")
    drop(large)
    return out


def _unequal(copies: DataFrame, chunk: int) -> DataFrame:
    """row of those copies (row, lead, size, text, n) whose text is not that of their lead row.

    Texts meet chunk by chunk in a join; the lead's chunks are repeated once for PER_SALT members, and a member goes to one
    of the repeats, so that a large group is spread out.
    """
    salts = F.ceil(F.col("size") / PER_SALT).cast("int")
    salted = copies.withColumn("salt", F.when(F.col("row") != F.col("lead"), F.pmod(F.xxhash64("row"), salts).cast("int")))
    members = _chunks(salted.where("row != lead").select("row", "lead", "salt", "text", "n"), chunk)
    leads = salted.where("row = lead").select("lead", "text", "n", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    leads = _chunks(leads, chunk).withColumnRenamed("piece", "first_piece")
    met = members.join(leads, ["lead", "salt", "at"])
    return met.where("piece != first_piece").select("row").distinct()


@small_batches
def exact_duplicates(docs: DataFrame, chunk: int = CHUNK, huge: int = HUGE, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Every row with doc_id, keep_id, group_size, kept, text_sha256: which row stays of those with equal normalised texts.

    Fingerprints are sums over chunks, so those of huge texts come from chunks that are dealt to all tasks. Rows of
    one fingerprint and length are compared with their first row, byte by byte in chunks; what differs is grouped and
    compared again, until nothing differs. So equal fingerprints of different texts change nothing.

    Of equal texts the row with the smallest doc_id stays, null last; of rows that also share the doc_id, one. A null
    text is an empty one, a text of white space alone is one space. Other columns are ignored; an empty table
    gives no rows.
    """
    left, out = _fingerprints(docs, chunk, huge, primes), None
    while True:
        first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")).alias("first")
        groups = store(left.groupBy("f", "n").agg(F.count("*").alias("size"), first).where("size > 1"), "groups")
        joined = left.join(F.broadcast(groups) if small_enough(groups, MOST_GROUPS) else groups, ["f", "n"], "left")
        copies = joined.where("first IS NOT NULL").select("row", F.col("first.row").alias("lead"), "size", "text", "n")
        unequal = store(_unequal(copies, chunk), "unequal")
        again = unequal.limit(1).count() > 0
        if again:
            gone = left.join(unequal, "row", "left_semi").groupBy("f", "n").agg(F.count("*").alias("others"))
            joined = joined.join(unequal, "row", "left_anti").join(gone, ["f", "n"], "left")
        others = F.coalesce("others", F.lit(0)) if again else F.lit(0)
        alone = F.col("first").isNull()
        done = joined.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
            F.when(alone, F.lit(1)).otherwise(F.col("size") - others).cast("long").alias("group_size"),
            (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
            "text_sha256",
        )
        out = done if out is None else out.unionByName(done)
        if not again:
            return out
        left = store(left.join(unequal, "row", "left_semi"), "left")
