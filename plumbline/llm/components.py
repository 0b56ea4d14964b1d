"""Connected components of a link table, by DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop, store

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of links (a, b: long, not null).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until every node points at its
    component's smallest one. Each step takes a minimum per node, which is summed up before the
    shuffle, and one join; neighbours are never gathered into a list, so a hub of any degree is
    split like any skewed join. Each round is a written table.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-start")
    for turn in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: greater neighbours point at the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lesser neighbours point at the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = store(small.distinct(), f"cc-{turn}")
        # Settled: no node is both below and above another, and none points at two.
        sides = new.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(new.select("b", F.lit(0), F.lit(1)))
        open_ = sides.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out > 0 AND into > 0)")
        last, edges = edges, new
        drop(last)
        if not open_.limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b").distinct())
