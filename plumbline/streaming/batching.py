"""Model calls over rows: micro-batches, row-wise second attempts, slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.scratch import scratch

#: What a model does with a list of prompts: a reply, or an exception's text, for each.
Model = Callable[[list[str]], list[tuple[str | None, str | None]]]


def call_model(rows: DataFrame, model: Model, batch: int = 8, attempts: int = 2, accept: Callable[[str], str | None] | None = None) -> DataFrame:
    """rows (with id and prompt) and reply, error, attempt.

    Batches are filled where rows lie. Only rows that failed, or whose reply ``accept`` names an error of, are
    called again, so one bad row doesn't repeat its batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part = part.reset_index(drop=True).assign(reply=None, error=None, attempt=0)
            todo = list(part.index)
            for n in range(1, attempts + 1):
                failed = []
                for at in range(0, len(todo), batch):
                    some = todo[at : at + batch]
                    for i, (reply, error) in zip(some, model(part.loc[some, "prompt"].tolist()), strict=True):
                        error = error or (accept(reply) if accept else None)
                        part.at[i, "reply"], part.at[i, "error"], part.at[i, "attempt"] = None if error else reply, error, n
                        if error:
                            failed.append(i)
                todo = failed
            yield part

    schema = rows.schema.simpleString()[7:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) if schema else ""
    return rows.mapInPandas(run, f"{fields}, reply string, error string, attempt int")


def ask(rows: DataFrame, model: Model, error_of: Callable[[Column], Column], batch: int = 8) -> DataFrame:
    """rows (with id and prompt) and reply, v (the reply as a variant), error, attempt: replies held against a contract.

    ``error_of`` gives a reply's error from v and the row's own columns. Only rows whose first reply breaks it, or is
    none, are asked again, all at once; what is wrong with the second one stays as their error.
    """

    def told(some: DataFrame, attempt: int) -> DataFrame:
        out = call_model(some, model, batch, attempts=1).drop("attempt").withColumn("v", F.try_parse_json("reply"))
        return scratch(out.withColumn("error", F.coalesce("error", error_of(F.col("v")))).withColumn("attempt", F.lit(attempt)), "asked")

    first = told(rows, 1)
    second = told(first.where("error IS NOT NULL").select(*rows.columns), 2)
    return first.where("error IS NULL").unionByName(second)


Encoder = Callable[[list[str]], np.ndarray]


def encode(rows: DataFrame, text: str, encoder: Encoder, batch: int = 16, prefix: str = "") -> DataFrame:
    """rows with ``embedding``: what an encoder makes of texts, as unit vectors of single precision.

    Texts are encoded where rows lie, ``batch`` at a time, queries with their prefix. A text without a finite, non-zero vector is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [encoder([prefix + t for t in part[text].iloc[i : i + batch]]) for i in range(0, len(part), batch)]
            v = np.concatenate(made).astype(np.float64) if made else np.zeros((0, 1))
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            if not (np.isfinite(norm).all() and (norm > 0).all()):
                raise ValueError("a text has no vector")
            yield part.assign(embedding=list((v / norm).astype(np.float32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, embedding array<float>")


def slots(requests: DataFrame, capacity: int) -> DataFrame:
    """Slot and start of each request when ``capacity`` slots are refilled at once, in order of arrival.

    requests: run, id, arrival, seconds. What a slot is free for depends on all requests before, so a
    run is one fold in one task, as one engine serves it.
    """

    def serve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        free = [0.0] * capacity
        out = []
        for r in part.sort_values(["arrival", "id"]).itertuples(index=False):
            slot = min(range(capacity), key=lambda s: (max(free[s], r.arrival), s))
            start = max(free[slot], r.arrival)
            free[slot] = start + r.seconds
            out.append((key[0], r.id, slot, round(start, 6), round(start - r.arrival, 6), round(free[slot], 6)))
        return pd.DataFrame(out, columns=["run", "id", "slot", "start", "waited", "stop"])

    return requests.groupBy("run").applyInPandas(serve, "run long, id long, slot int, start double, waited double, stop double")


def slot_summary(served: DataFrame, capacity: int) -> DataFrame:
    """run, requests, makespan, utilisation, waited_p50 (by rank), waited_max."""
    span = F.max("stop") - F.min("start")
    return served.groupBy("run").agg(
        F.count("*").alias("requests"),
        F.round(span, 4).alias("makespan"),
        F.round(F.try_divide(F.sum(F.col("stop") - F.col("start")), span * capacity), 6).alias("utilisation"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY waited)").alias("waited_p50"),
        F.max("waited").alias("waited_max"),
    )
