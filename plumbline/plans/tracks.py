"""Queries over ordered events: pairs, overlaps, lineage, batches, windows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import relations, sequences
from plumbline.plans.base import registry, table
from plumbline.session import shared_dir
from plumbline.streaming import batching, windows

QUERIES, ORACLES, query = registry()


@query("""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT a.conv_id, a.n, a.turn AS first, b.turn AS second, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.i, b.i) AS pair_no FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.i < b.i)
SELECT conv_id, first, second, pair_no, (pair_no - 1) // 4 AS batch_no, greatest(n * (n - 1) // 2 - 120, 0) AS unprocessed FROM p WHERE pair_no <= 120
""")
def pair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a conversation's turns in order, up to the story check's limit of 120, in batches of four."""
    return relations.ordered_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", 120, 4)


DAYS = "epoch(CAST({c} AS TIMESTAMP)) // 86400"


@query(f"""
WITH s AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS id, CAST({DAYS.format(c='l_shipdate')} AS BIGINT) AS a, CAST({DAYS.format(c='l_shipdate')} + l_quantity AS BIGINT) AS b, l_returnflag AS f FROM lineitem)
SELECT x.k, x.id AS left_id, y.id AS right_id FROM s x JOIN s y ON x.k = y.k AND x.a <= y.b AND y.a <= x.b WHERE x.f = 'R' AND y.f = 'A'
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned and accepted lines of a supplier whose handling days overlap."""
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400)
    s = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), day.alias("start"), (day + F.col("l_quantity")).cast("long").alias("stop"), F.col("l_returnflag").alias("f")
    )
    return relations.overlapping(s.where("f = 'R'"), s.where("f = 'A'"), "k", 50)


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup
FROM events
""")
def nearest_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = relations.nearest_before(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "last_signup")
    return out.select("event_id", "user_id", "last_signup")


@query("""
WITH a AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed FROM events),
w AS (SELECT *, lag(failed) OVER p AS before_failed, coalesce(max(NOT failed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), FALSE) AS later_ok,
  row_number() OVER p AS attempt_no FROM a WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(attempt_no AS INTEGER) AS attempt_no, CASE WHEN before_failed IS NULL THEN 'first' WHEN before_failed THEN 'repeat' ELSE 'follow_up' END AS cost_class,
  CASE WHEN NOT failed THEN 'ok' WHEN later_ok THEN 'recovered' ELSE 'lost' END AS outcome FROM w
""")
def attempt_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relations.lineage(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return out.select("event_id", "attempt_no", "cost_class", "outcome")


@query("""
WITH a AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step FROM events WHERE event_type IN ('click', 'view')),
j AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.step, y.step) AS step, x.value IS DISTINCT FROM y.value AS differ
  FROM (SELECT * FROM a WHERE event_type = 'click') x FULL JOIN (SELECT * FROM a WHERE event_type = 'view') y ON x.user_id = y.user_id AND x.step = y.step)
SELECT user_id, CAST(min(step) FILTER (differ) AS INTEGER) AS step FROM j GROUP BY user_id
""")
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step at which a user's clicks and views first have different values."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    return sequences.first_divergence(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "step", "value")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'click' AND event_id % 2 = 0)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return relations.pending(e, e.where("event_type = 'click' AND event_id % 2 = 0"), ["event_id"]).select("event_id")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, date_trunc('day', o_orderdate) AS d, o_orderpriority AS p, o_orderstatus AS s FROM orders),
x AS (SELECT a.o_custkey AS grp, a.o_orderkey AS left_id, b.o_orderkey AS right_id, 100 * (a.p = b.p)::INT + 50 * (abs(date_diff('day', a.d, b.d)) <= 30)::INT AS score
  FROM c a JOIN c b ON a.o_custkey = b.o_custkey WHERE a.s = 'F' AND b.s = 'O')
SELECT grp, left_id, right_id, CAST(score AS INTEGER) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY grp, left_id ORDER BY score DESC, right_id) AS place FROM x WHERE score > 0) WHERE place <= 3
""")
def review_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each closed order the three open ones of the customer that fit best: same priority 100, within 30 days 50."""
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"), "o_orderstatus")
    left = c.where("o_orderstatus = 'F'").select("grp", F.col("id").alias("left_id"), F.col("d").alias("ld"), F.col("p").alias("lp"))
    right = c.where("o_orderstatus = 'O'").select("grp", F.col("id").alias("right_id"), F.col("d").alias("rd"), F.col("p").alias("rp"))
    score = F.when(F.col("lp") == F.col("rp"), 100).otherwise(0) + F.when(F.abs(F.datediff("ld", "rd")) <= 30, 50).otherwise(0)
    return relations.proposals(left, right, "grp", score, 3)


@query("""
WITH o AS (SELECT o_orderkey, md5(o_orderpriority) AS s, o_orderstatus AS label FROM orders),
fix AS (SELECT o_orderkey, s, 'X' AS label FROM o WHERE o_orderkey % 10 = 0)
SELECT o.o_orderkey, coalesce(fix.label, o.label) AS label FROM o LEFT JOIN fix USING (o_orderkey)
""")
def label_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.md5("o_orderpriority").alias("s"), F.col("o_orderstatus").alias("label"))
    return relations.correct(o, o.where("o_orderkey % 10 = 0").withColumn("label", F.lit("X")), "o_orderkey", "s", "label").select("o_orderkey", "label")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, CAST(1 AS BIGINT) AS b, CAST(1 AS BIGINT) AS n, t AS t0 FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, r.b + (r.n >= 8 OR e.t - r.t0 > 3600000000)::INT, CASE WHEN r.n >= 8 OR e.t - r.t0 > 3600000000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 8 OR e.t - r.t0 > 3600000000 THEN e.t ELSE r.t0 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, CAST(b AS INTEGER) AS batch FROM r
""")
def microbatch_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a user's events: closed at eight or when the first has waited an hour."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id"))).alias("x"))
    b = e.select("user_id", "x", sequences.micro_batches(F.transform("x", lambda s: s.t), 8, 3_600_000_000).alias("b"))
    return b.select("user_id", F.explode(F.arrays_zip("x", "b")).alias("z")).select("user_id", F.col("z.x.event_id").alias("event_id"), F.col("z.b").alias("batch"))


@query("""
WITH RECURSIVE e AS (SELECT user_id AS run, event_id, epoch_us(ts) / 1e6 AS arrival, value * 100 AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS i FROM events),
s0 AS (SELECT run, i, arrival, seconds FROM e),
r AS (SELECT run, CAST(0 AS BIGINT) AS i, [CAST(0 AS DOUBLE), 0, 0, 0] AS free, CAST(0 AS DOUBLE) AS start, CAST(0 AS DOUBLE) AS waited, CAST(0 AS DOUBLE) AS stop FROM (SELECT DISTINCT run FROM e)
  UNION ALL SELECT e.run, e.i, list_transform([1, 2, 3, 4], lambda k: CASE WHEN k = list_position(list_transform(r.free, lambda f: greatest(f, e.arrival)), list_min(list_transform(r.free, lambda f: greatest(f, e.arrival))))
    THEN list_min(list_transform(r.free, lambda f: greatest(f, e.arrival))) + e.seconds ELSE r.free[k] END),
    list_min(list_transform(r.free, lambda f: greatest(f, e.arrival))), list_min(list_transform(r.free, lambda f: greatest(f, e.arrival))) - e.arrival, list_min(list_transform(r.free, lambda f: greatest(f, e.arrival))) + e.seconds
  FROM r JOIN s0 e ON e.run = r.run AND e.i = r.i + 1),
p AS (SELECT run, round(start, 6) AS start, round(waited, 6) AS waited, round(stop, 6) AS stop FROM r WHERE i > 0)
SELECT run, count(*) AS requests, round(max(stop) - min(start), 4) AS makespan, round(sum(stop - start) / ((max(stop) - min(start)) * 4), 6) AS utilisation, quantile_disc(waited, 0.5) AS waited_p50, max(waited) AS waited_max FROM p GROUP BY run
""")
def slot_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four slots per user and run, refilled as soon as one is free."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), t.alias("arrival"), (F.col("value") * 100).alias("seconds"))
    return batching.slot_summary(batching.slots(r, 4), 4)


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY ALL
""")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start FROM events, (SELECT unnest([0, 1]) AS k))
SELECT start, count(*) AS n FROM s GROUP BY start
""")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k
""")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(table(spark, sf_dir, "events"), "2 hours", "user_id")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "stop": F.col("stop").cast("timestamp_ntz")})


def _streamed(spark: SparkSession, sf_dir: str, plan) -> DataFrame:
    """Run a plan as a stream over the events file until all of it is read, and return the table it wrote."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = plan(stream).writeStream.outputMode("complete").foreachBatch(windows.replace_whole(f"{folder}/rows")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@query(ORACLES["window_tumbling"])
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window_tumbling() as a stream."""
    out = _streamed(spark, sf_dir, lambda s: windows.tumbling(s, "1 hour", "event_type"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(ORACLES["window_session"])
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window_session() as a stream."""
    out = _streamed(spark, sf_dir, lambda s: windows.sessions(s, "2 hours", "user_id"))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "stop": F.col("stop").cast("timestamp_ntz")})
