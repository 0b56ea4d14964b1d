"""Indexes that follow their sources: a new version takes over the vectors of what did not change.

An index is a folder of segments, which are never rewritten, and of versions::

    segment=<id>      chunks with their vectors, as one sync made them: file, text_sha256, columns of the chunks, embedding
    files=<version>   file, sha256, segment: the files of a version, and which segment holds their chunks
    manifest=<version>  the configuration, the segments of the version, and counts
    CURRENT           the version that readers see, replaced in one move

A sync compares digests of files with the current version's. Chunks of new and changed files make a segment; of these, only
chunks whose text the index does not hold yet are encoded. What the files table does not assign to its segment any
more is dead (its tombstone is the missing pair) until compact() rewrites what is alive.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.checks import repeated_keys, require_empty
from plumbline.sources.scratch import scratch
from plumbline.sources.stores import POINTER, Conflict, read_text, replace_text

#: Files, or pairs of file and segment, that are broadcast; more meet the texts or chunks in a shuffle.
MOST_FILES = 1_000_000


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The current version's manifest with its name as ``version``; null if nothing was synced yet."""
    version = (read_text(spark, f"{folder}/{POINTER}") or "").strip()
    if not version:
        return None
    return json.loads(read_text(spark, f"{folder}/manifest={version}") or "null") | {"version": version}


def changes(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """file, sha256, change (added, changed, removed, same) of files (file, sha256) against those of a version."""
    if known is None:
        return files.select("file", "sha256", F.lit("added").alias("change"))
    old = known.select("file", F.col("sha256").alias("before"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("sha256").isNull(), "removed").when(F.col("sha256") != F.col("before"), "changed")
    return files.select("file", "sha256").join(old, "file", "full").select("file", "sha256", kind.otherwise("same").alias("change"))


def _alive(spark: SparkSession, folder: str, now: dict) -> DataFrame:
    """Chunks of a version: rows of its segments whose file the version assigns to that segment."""
    paths = [f"{folder}/segment={s}" for s in now["segments"]]
    rows = spark.read.option("basePath", folder).option("mergeSchema", "false").parquet(*paths)
    rows = rows.withColumn("segment", F.col("segment").cast("string"))
    pairs = spark.read.parquet(f"{folder}/files={now['version']}").select("file", "segment")
    pairs = F.broadcast(pairs) if now["files"] <= MOST_FILES else pairs
    return rows.join(pairs, ["file", "segment"], "left_semi")


def load(spark: SparkSession, folder: str, config: dict[str, str] | None = None) -> DataFrame:
    """The chunks of the current version with their vectors and the segment that holds them."""
    now = manifest(spark, folder)
    if now is None:
        raise ValueError(f"{folder} has no index")
    if config is not None and now["config"] != config:
        raise ValueError("the index was made by another configuration; build it anew")
    return _alive(spark, folder, now)


def sync(files: DataFrame, folder: str, cut: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame], config: dict[str, str], text: str = "text") -> dict:
    """Bring an index up to date with files (file, text); returns the new version's manifest.

    ``cut`` gives chunks (file, the column ``text`` that is encoded, others) of files and is called on new and changed ones only,
    ``encode`` adds ``embedding`` to chunks and is called on texts that no current chunk has, each once. Files are unique;
    a null text counts as empty. Another configuration than the index's is an error: its vectors would not fit. If someone else
    publishes a version meanwhile, that is a Conflict and nothing changes. A version without any change is not written.
    """
    spark = files.sparkSession
    now = manifest(spark, folder)
    if now is not None and now["config"] != config:
        raise ValueError("the index was made by another configuration; build it anew")
    require_empty(repeated_keys(files, ["file"]), "repeated file")
    known = spark.read.parquet(f"{folder}/files={now['version']}") if now else None
    found = files.select("file", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    change = scratch(changes(found, known), "changes")
    counts = {r["change"]: r["n"] for r in change.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if now is not None and set(counts) <= {"same"}:
        return now
    fresh = change.where("change IN ('added', 'changed')")
    chunks = cut(_fresh(files, change, counts)).withColumn("text_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    chunks = scratch(chunks, "chunks")
    held = None if now is None else _alive(spark, folder, now).select("text_sha256", "embedding").dropDuplicates(["text_sha256"])
    wanted = chunks.select("text_sha256", text).dropDuplicates(["text_sha256"])
    new_texts = wanted if held is None else wanted.join(held, "text_sha256", "left_anti")
    made = scratch(encode(new_texts).select("text_sha256", "embedding"), "encoded")
    vectors = made.withColumn("encoded", F.lit(True))
    if held is not None:
        vectors = vectors.unionByName(held.join(wanted, "text_sha256", "left_semi").withColumn("encoded", F.lit(False)))
    segment, version = uuid.uuid4().hex, uuid.uuid4().hex
    chunks.join(vectors, "text_sha256").write.parquet(f"{folder}/segment={segment}")
    table = fresh.select("file", "sha256", F.lit(segment).alias("segment"))
    if known is not None:
        table = table.unionByName(known.join(change.where("change = 'same'").select("file"), "file", "left_semi"))
    table.write.parquet(f"{folder}/files={version}")
    used = spark.read.parquet(f"{folder}/files={version}").groupBy("segment").agg(F.count("*").alias("n")).collect()  # a row for each segment
    told = {
        "config": config,
        "segments": sorted({r["segment"] for r in used} | {segment}),
        "files": sum(r["n"] for r in used),
        "changes": {k: counts.get(k, 0) for k in ("added", "changed", "removed", "same")},
        "chunks": chunks.count(),
        "encoded": made.count(),
    }
    _publish(spark, folder, now, version, told)
    return told | {"version": version}


def _fresh(files: DataFrame, change: DataFrame, counts: dict[str, int]) -> DataFrame:
    """The files that are new or changed; their texts stay where they lie while the others, or they, are few enough."""
    fresh, same = (change.where(F.col("change").isin(*kinds)).select("file") for kinds in (("added", "changed"), ("same",)))
    if not counts.get("same"):
        return files.where("file IS NOT NULL")
    if counts["same"] <= MOST_FILES:
        return files.where("file IS NOT NULL").join(F.broadcast(same), "file", "left_anti")
    few = counts.get("added", 0) + counts.get("changed", 0) <= MOST_FILES
    return files.join(F.broadcast(fresh) if few else fresh, "file", "left_semi")


def _publish(spark: SparkSession, folder: str, before: dict | None, version: str, told: dict) -> None:
    replace_text(spark, f"{folder}/manifest={version}", json.dumps(told, sort_keys=True))
    there = (read_text(spark, f"{folder}/{POINTER}") or "").strip()
    if there != (before or {}).get("version", ""):
        raise Conflict("another version was published meanwhile")
    replace_text(spark, f"{folder}/{POINTER}", version)


def compact(spark: SparkSession, folder: str) -> dict:
    """Rewrite the chunks that are alive as one segment, without encoding; readers of older versions keep theirs."""
    now = manifest(spark, folder)
    if now is None:
        raise ValueError(f"{folder} has no index")
    segment, version = uuid.uuid4().hex, uuid.uuid4().hex
    _alive(spark, folder, now).drop("segment").write.parquet(f"{folder}/segment={segment}")
    spark.read.parquet(f"{folder}/files={now['version']}").withColumn("segment", F.lit(segment)).write.parquet(f"{folder}/files={version}")
    told = {k: v for k, v in now.items() if k != "version"} | {"segments": [segment]}
    _publish(spark, folder, now, version, told)
    return told | {"version": version}
