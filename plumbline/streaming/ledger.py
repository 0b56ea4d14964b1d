"""Model stages that resume: a ledger of what was answered, so that a run after a failure asks only what is open."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.checks import repeated_keys, require_empty
from plumbline.operators.runs import ensure_manifest
from plumbline.sources.scratch import scratch

#: Jobs of a ledger batch: what at most is asked between two writes.
BATCH_JOBS = 10_000
LEDGER = "job string, attempt int, state string, reply string, error string"


class Stopped(RuntimeError):
    """A stage ended with open jobs; running it again goes on with these."""


def job_name(identity: str) -> Column:
    """A job's name from the run's identity, its id and its prompt, so that answers of another run or prompt are never taken over."""
    return F.sha2(F.to_json(F.struct(F.lit(identity).alias("run"), F.col("id").cast("string").alias("id"), F.col("prompt"))), 256)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """job, attempt, state (done, failed), reply, error: everything that was answered so far."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{folder}/ledger")


def open_jobs(jobs: DataFrame, told: DataFrame, attempts: int) -> DataFrame:
    """jobs (job, ..) without an answer and with attempts left, with the number of the next one."""
    seen = told.groupBy("job").agg(F.max("attempt").alias("last"), F.max((F.col("state") == "done").cast("int")).alias("done"))
    left = jobs.join(seen, "job", "left").where("coalesce(done, 0) = 0").withColumn("attempt", F.coalesce("last", F.lit(0)) + 1)
    return left.where(F.col("attempt") <= attempts).drop("last", "done")


def _answer(model: Callable[[list[str]], list[str]], batch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows done or failed. After a call that raised, what is left of the task is not asked and has no row: it stays open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = False
        for part in batches:
            for at in range(0, 0 if broken else len(part), batch):
                some = part.iloc[at : at + batch]
                out = some[["job", "attempt"]].assign(state="done", reply=None, error=None)
                try:
                    out["reply"] = model(some["prompt"].tolist())
                except Exception as e:  # the answers before this call are kept
                    out, broken = out.assign(state="failed", error=f"{type(e).__name__}: {e}"), True
                yield out
                if broken:
                    break

    return run


def run_stage(jobs: DataFrame, model: Callable[[list[str]], list[str]], folder: str, identity: str, batch: int = 8, attempts: int = 3, batch_jobs: int = BATCH_JOBS) -> DataFrame:
    """Answers of all jobs (id, prompt, others): jobs with reply, error, attempt; raises Stopped if some are left open.

    ``model`` answers a list of prompts and is called where rows lie. Open jobs go through in batches of about ``batch_jobs``; each
    is one write to the ledger, which takes effect as a whole. A call that raises costs its own jobs an attempt, and the rest of its task
    is left for the next run; all answers before it are in the ledger. So a run after a failure asks each job that has an
    answer not again. Only if executors or the driver are lost is what they were asked since the last write asked again.

    Ids are unique; a folder belongs to one identity. A job whose attempts are used up has its last error and no reply.
    """
    spark = jobs.sparkSession
    require_empty(repeated_keys(jobs, ["id"]), "repeated id")
    ensure_manifest(spark, f"{folder}/manifest.json", {"identity": identity, "attempts": attempts})
    named = jobs.withColumn("job", job_name(identity))
    todo = scratch(open_jobs(named.select("job", "prompt"), ledger(spark, folder), attempts), "open")
    parts = -(-todo.count() // batch_jobs)
    stopped = False
    for i in range(parts):
        some = todo.where(F.pmod(F.xxhash64("job"), F.lit(parts)) == i)
        path = f"{folder}/ledger/batch={uuid.uuid4().hex}"
        some.repartition(max(1, spark.sparkContext.defaultParallelism), "job").select("job", "attempt", "prompt").mapInPandas(_answer(model, batch), LEDGER).write.parquet(path)
        stopped = spark.read.schema(LEDGER).parquet(path).where("state = 'failed'").limit(1).count() > 0
        if stopped:
            break
    told = ledger(spark, folder)
    if stopped and open_jobs(named.select("job"), told, attempts).limit(1).count():
        raise Stopped(f"jobs are left open in {folder}")
    last = told.groupBy("job").agg(F.max(F.struct((F.col("state") == "done").alias("done"), "attempt", "reply", "error")).alias("x"))
    return named.join(last, "job", "left").select(*jobs.columns, "x.reply", F.when(~F.col("x.done"), F.col("x.error")).alias("error"), "x.attempt")
