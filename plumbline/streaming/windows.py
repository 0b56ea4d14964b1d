"""Windowed and stateful stream operators; each runs on a batch table just as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """events with ts as a zoned timestamp, watermarked if they stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", lateness) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, *keys: str, lateness: str = "10 minutes") -> DataFrame:
    """start, keys, n, value_sum in windows of fixed size."""
    g = event_time(events, lateness).groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value_sum"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "value_sum")


def sliding(events: DataFrame, size: str, slide: str, *keys: str) -> DataFrame:
    g = event_time(events).groupBy(F.window("ts", size, slide), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str) -> DataFrame:
    """key, start, stop, n: runs of events of a key without a longer gap."""
    g = event_time(events).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def append_new(rows: DataFrame, batch_id: int, path: str, keys: list[str]) -> None:
    """foreachBatch sink that a restart may repeat: a batch has a folder of its own, which a second try replaces as a whole.

    Rows whose keys an earlier batch stored, and repeats inside the batch, are left out.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = rows.dropDuplicates(keys)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        stored = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", batch long").parquet(path)
        rows = rows.join(stored.where(F.col("batch") < batch_id).select(*keys), keys, "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def replace_whole(path: str):
    """foreachBatch sink for complete results: each batch's table replaces the one before."""
    return lambda rows, _: rows.write.mode("overwrite").parquet(path)
