"""Five stages that turn raw documents into sharded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, kneser_ney, minhash, mixing, sharding
from plumbline.llm.common import row_name, store, table, without
from plumbline.session import ship

SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of trusted text does not reject.

    Null and empty texts are scored as their end alone. Repeated rows share their fate; extra columns pass through.
    """
    ship(spark)
    scores = kneser_ney.classify(docs, table(spark, sf_dir, "labels"))
    return without(docs, scores.where("NOT accepted"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Null texts and those without words are left alone. Of repeated rows one stays; a null doc_id comes after
    all others; extra columns pass through.
    """
    ship(spark)
    found = store(minhash.near_duplicates(docs, named=True).where("n_shingles > 0").groupBy("component", "doc_id", "row").agg(F.count("*").alias("n")), "pipeline-near")
    best = found.groupBy("component").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    best = store(best, "pipeline-best")
    rest = without(docs, found.join(best, "row", "left_anti"))
    # Rows that repeat a kept one share its name.
    again = store(found.where("n > 1").join(best, "row", "left_semi").select(F.col("row").alias("__again")), "pipeline-again")
    if not again.limit(1).count():
        return rest
    named = rest.withColumn("__row", row_name())
    single = named.join(again, F.col("__row") == F.col("__again"), "left_semi").dropDuplicates(["__row"])
    return without(rest, again.select(F.col("__again").alias("row"))).unionByName(single.drop("__row"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null texts and those without words stay, extra columns pass through."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source, texts without words are taken as the rates fall. Columns with the names of
    the mix's own results pass through.
    """
    aside = {c: f"__own_{c}" for c in docs.columns if c in mixing.MADE}
    taken = mixing.expand(mixing.mix(docs.withColumnsRenamed(aside)))
    return taken.withColumnsRenamed({v: k for k, v in aside.items()})


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document; null texts are linked with each other, repeated rows are all placed.

    Of extra columns those of documents stay.
    """
    return sharding.shard_documents(docs, SHARDS, keep=("lang", "source", "n_chars"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources", mix), ("sharding", shard)]

#: The stages are iterative or models, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"stage{k}")
    return docs
