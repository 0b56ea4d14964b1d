"""Shared scratch tables, table access and word patterns."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir

# The character classes that the query contracts name.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*stored: DataFrame) -> None:
    """Delete tables of store() that no later plan reads."""
    for df in stored:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(docs: DataFrame, label: str) -> DataFrame:
    """docs as they are if they come straight from files, whose rows keep their order; written as a table if a shuffle made them."""
    return store(docs, label) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


class Memory(dict):
    """What a function makes of words, remembered by a Python worker: of up to ``most`` words of up to ``longest`` characters."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


#: Rows of an Arrow batch where texts go to Python workers: a batch of long ones must fit beside the work on them.
BATCH_ROWS = 1_000


def small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator, which writes its tables itself, with batches of BATCH_ROWS rows while it runs."""

    @functools.wraps(operator)
    def run(rows: DataFrame, *args: object, **options: object) -> DataFrame:
        with setting(rows.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
            return operator(rows, *args, **options)

    return run


def measured_joins(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator, which writes its tables itself, with join sides sent to all tasks only by their measured sizes while it runs.

    Estimates take no account of explode(), so a side estimated at megabytes may be a gigabyte, which the driver would gather.
    """

    @functools.wraps(operator)
    def run(rows: DataFrame, *args: object, **options: object) -> DataFrame:
        spark, key, name = rows.sparkSession, "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
        with setting(spark, key, spark.conf.get(key, None) or spark.conf.get(name)), setting(spark, name, "-1"):
            return operator(rows, *args, **options)

    return run


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def pinned_scans(spark: SparkSession) -> Iterator[None]:
    """While it lasts, files are split by their sizes alone, not by how many executors there happen to be."""
    key = "spark.sql.files.minPartitionNum"
    with setting(spark, key, spark.conf.get(key, None) or str(spark.sparkContext.defaultParallelism)):
        yield


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null and blank texts have none."""
    # Each word with the spaces around it becomes one character, which allocates nothing per word.
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.when(marks.startswith("x"), F.length(marks)), F.lit(0)).cast("long")


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows; reads no more than needed to tell."""
    return df.limit(most + 1).count() <= most


#: Names of rows to drop that are sent to all tasks (8 bytes each); more are joined by a shuffle.
MOST_DROPPED = 2_000_000


def row_name() -> Column:
    """Name of a document row by its content: doc_id and text."""
    return F.xxhash64("doc_id", "text")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose names are in ``gone`` (row)."""
    gone = store(gone.select(F.col("row").alias("__gone")).distinct(), "gone")
    gone = F.broadcast(gone) if small_enough(gone, MOST_DROPPED) else gone
    return docs.join(gone, row_name() == F.col("__gone"), "left_anti")
