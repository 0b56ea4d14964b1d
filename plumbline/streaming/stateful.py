"""Keyed state in streams: numbering and lineage of attempts with timers, and append windows whose late rows are accounted for."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.streaming.windows import event_time, tumbling

#: The state store that keyed state with several variables and timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# Processors also start in a worker beside the driver, which does not get the files that executors are sent.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
LINEAGE = "event_id long, attempt_no int, cost_class string, outcome string"


class Lineage(StatefulProcessor):
    """Number a key's attempts and say what each was for and what became of it.

    State of a key, in one value, since each read and write of state is a call to the executor: how many attempts there were, whether the
    last one failed, the failures that are still open, and when its timer goes off.
    A failure is told as open at once and again as recovered, when an attempt within ``patience`` succeeds, or lost,
    when one comes later or the watermark passes the end of its patience, which a timer for the earliest one watches. Without
    patience failures stay open until an attempt succeeds.
    """

    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lineage", "n int, failed boolean, ids array<bigint>, numbers array<int>, costs array<string>, ats array<bigint>, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, failed, pending, timer = self._held()
        out = []
        for event, at, broken in sorted(((r.event_id, r.at, r.failed) for r in rows), key=lambda x: (x[1], x[0])):
            n += 1
            cost = "first" if failed is None else "repeat" if failed else "follow_up"
            failed = bool(broken)
            if failed:
                pending.append((event, n, cost, at))
                out.append(_told(event, n, cost, "open"))
                continue
            out.append(_told(event, n, cost, "ok"))
            out += [_told(e, k, c, "recovered" if self.patience is None or at - since <= self.patience else "lost") for e, k, c, since in pending]
            pending = []
        self._keep(n, failed, pending, timer)
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, failed, pending, _ = self._held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        gone = [x for x in pending if x[3] + self.patience <= now]
        self._keep(n, failed, [x for x in pending if x not in gone], None)
        return iter([_told(e, k, c, "lost") for e, k, c, _ in gone])

    def _held(self) -> tuple[int, bool | None, list[tuple], int | None]:
        """Attempts so far, whether the last one failed, the open failures in order, and the timer."""
        held = self.state.get()
        if held is None:
            return 0, None, [], None
        n, failed, *open_, timer = held
        return n, failed, list(zip(*open_, strict=True)), timer

    def _keep(self, n: int, failed: bool | None, pending: list[tuple], timer: int | None) -> None:
        if pending and timer is None and self.patience is not None:
            timer = min(x[3] for x in pending) + self.patience
            self.handle.registerTimer(timer)
        self.state.update((n, failed, *(list(c) for c in (zip(*pending, strict=True) if pending else ((), (), (), ()))), timer))

    def close(self) -> None:
        pass


def _told(event: int, number: int, cost: str, outcome: str) -> Row:
    return Row(event_id=event, attempt_no=number, cost_class=cost, outcome=outcome)


def lineage_changes(events: DataFrame, group: str, failed: str, patience: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """A stream of event_id, attempt_no, cost_class, outcome over a stream of events (event_id, ts, ``group``): see Lineage.

    ``failed`` is a condition in SQL. A key's events must come in order from one micro-batch to the next; within one they are
    sorted, so a task holds the events of a key that one micro-batch brings. Events are told once as ok, or as open and once more.
    """
    patience_ms = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)
    rows = event_time(events, lateness).select(F.col(group).alias("key"), "event_id", "ts", F.unix_millis("ts").alias("at"), F.expr(failed).alias("failed"))
    return rows.groupBy("key").transformWithState(Lineage(patience_ms), LINEAGE, "Append", "EventTime")


def settled(changes: DataFrame) -> DataFrame:
    """What lineage_changes() has told of each event so far: an open failure is lost unless it recovers later."""
    final = F.max(F.when(F.col("outcome") != "open", F.col("outcome")))
    out = changes.groupBy("event_id").agg(F.first("attempt_no").alias("attempt_no"), F.first("cost_class").alias("cost_class"), final.alias("outcome"))
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("lost")))


def write_lineage(events: DataFrame, folder: str, group: str, failed: str, patience: str | None = None) -> None:
    """Run lineage_changes() over what has arrived, into a table that a restart goes on with; nothing is written twice."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        out = lineage_changes(events, group, failed, patience).writeStream.format("parquet").option("path", f"{folder}/rows")
        out.option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(*PROVIDER[:1], before) if before else spark.conf.unset(PROVIDER[0])


def write_windows(events: DataFrame, folder: str, size: str, lateness: str, *keys: str) -> None:
    """Append windows of fixed size to a table once the watermark has passed their end; then their state goes.

    A row counts until the watermark of the micro-batch before has passed the end of its window; a later one is dropped.
    """
    out = tumbling(events, size, *keys, lateness=lateness).writeStream.format("parquet").option("path", f"{folder}/rows")
    out.option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def window_report(spark: SparkSession, folder: str, arrived: DataFrame, *keys: str) -> DataFrame:
    """start, keys, n, state of the windows of write_windows(): closed (in the table), open (in the stream's state), and late, the
    number of rows that were dropped; ``arrived`` has one row for each that the stream has read.
    """
    closed = spark.read.parquet(f"{folder}/rows").select("start", *keys, "n", F.lit("closed").alias("state"))
    held = spark.read.format("statestore").load(f"{folder}/state")
    opened = held.select(F.col("key.window.start").alias("start"), *[F.col(f"key.{k}").alias(k) for k in keys], F.col("value.count").alias("n"), F.lit("open").alias("state"))
    rows = closed.unionByName(opened)
    counted = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    late = arrived.agg(F.count("*").alias("arrived")).join(F.broadcast(counted))  # one row each
    kinds = {f.name: f.dataType for f in rows.schema}
    nulls = [F.lit(None).cast(kinds[c]).alias(c) for c in ("start", *keys)]
    return rows.unionByName(late.select(*nulls, (F.col("arrived") - F.col("counted")).alias("n"), F.lit("late").alias("state")))
