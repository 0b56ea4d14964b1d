"""Keyed rows and versioned tables: strict readers, staged writers, publication by pointer."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.checks import repeated_keys, require_empty
from plumbline.sources import corpus
from plumbline.sources.scratch import scratch
from plumbline.sources.stores import POINTER, read_text, replace_text


def read_records(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """JSON lines with an explicit schema; malformed lines and repeated keys are errors."""
    versioned = read_text(spark, f"{path}/{POINTER}") is not None
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(current(spark, path) if versioned else path)
    require_empty(repeated_keys(rows, keys), "repeated key")
    return rows


def write_records(rows: DataFrame, path: str) -> str:
    """Write rows as a version of a JSON-lines table and point to it; a reader finds the old version or the new one."""
    return _switch(rows, path, lambda target: rows.write.json(target))


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that a table's pointer names."""
    version = (read_text(spark, f"{path}/{POINTER}") or "").strip()
    if len(version) != 32:
        raise ValueError(f"{path} has no current version")
    return f"{path}/version={version}"


def _switch(rows: DataFrame, path: str, write: Callable[[str], None]) -> str:
    version = uuid.uuid4().hex
    write(f"{path}/version={version}")
    replace_text(rows.sparkSession, f"{path}/{POINTER}", version)
    return version


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """Only the named fields, with a header."""
    rows.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def publish(table: DataFrame, folder: str, key: str, config: dict[str, str] | None = None) -> str:
    """Write a version with its manifest, read it back and compare, then point to it; readers never see half a version."""
    spark, version = table.sparkSession, uuid.uuid4().hex
    path = f"{folder}/version={version}"
    table.write.parquet(path)
    back = spark.read.parquet(path)
    require_empty(repeated_keys(back, [key]), "repeated id")
    made, found = _sums(table), _sums(back)
    if made != found:
        raise ValueError("the written version differs from the table")
    replace_text(spark, f"{folder}/manifest={version}", json.dumps({"rows": made[0], "hash": made[1], "config": config or {}}, sort_keys=True))
    replace_text(spark, f"{folder}/{POINTER}", version)
    return version


def _sums(table: DataFrame) -> tuple[int, str]:
    """Rows and an order-free hash of a table."""
    r = table.agg(F.count("*"), F.sum(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)"))).first()
    return r[0], str(r[1])


def load(spark: SparkSession, folder: str, config: dict[str, str] | None = None) -> DataFrame:
    """The version that CURRENT points to; it must be what its manifest says, and made by ``config`` if that is given."""
    path = current(spark, folder)
    manifest = json.loads(read_text(spark, path.replace("/version=", "/manifest=")) or "null")
    if manifest is None:
        raise ValueError("the version has no manifest")
    if config is not None and manifest["config"] != config:
        raise ValueError("the index was made by another configuration; build it anew")
    table = spark.read.parquet(path)
    if _sums(table) != (manifest["rows"], manifest["hash"]):
        raise ValueError("the version differs from its manifest")
    return table


def build_index(spark: SparkSession, lore: str, folder: str, count_tokens: Callable[[str], int], encode: Callable[[DataFrame], DataFrame], config: dict[str, str], most: int = corpus.MOST_TOKENS) -> str:
    """Chunks of a collection with their vectors, published as an index; a collection that changes meanwhile is an error.

    ``encode`` adds ``embedding`` to chunks.
    """
    before = corpus.digests(spark, lore).collect()  # a row for each file of a written collection
    made = scratch(encode(corpus.chunks(corpus.read_files(spark, lore), count_tokens, most)), "index")
    require_empty(unit_problems(made), "no unit vector")
    if sorted(before) != sorted(corpus.digests(spark, lore).collect()):
        raise ValueError("the collection changed while the index was built")
    sources = hashlib.sha256(json.dumps(sorted(map(tuple, before))).encode()).hexdigest()
    return publish(made, folder, "chunk_id", config | {"max_tokens": str(most), "sources": sources})


def unit_problems(chunks: DataFrame) -> DataFrame:
    """chunk_id of chunks whose vector is missing, not of unit length or of another length than the first one's."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = F.broadcast(chunks.agg(F.max(F.size("embedding")).alias("__n")))
    fine = F.coalesce((F.size("embedding") == F.col("__n")) & (F.abs(norm - 1) <= 1e-5), F.lit(False))
    return chunks.join(size).where(~fine).select("chunk_id")


def new_rows(proposed: DataFrame, stored: DataFrame, identity: list[str]) -> DataFrame:
    """Proposed rows that are not stored yet; exact repeats are an error rather than skipped."""
    require_empty(proposed.join(stored, identity, "left_semi"), "already stored")
    require_empty(repeated_keys(proposed, identity), "proposed twice")
    return proposed
