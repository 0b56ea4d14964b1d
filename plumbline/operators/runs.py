"""What runs are made of: identities, manifests, arms, systems in pairs, digests of what a run said."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.contracts import SYSTEMS
from plumbline.functions.text import digest
from plumbline.operators.checks import repeated_keys, require_empty
from plumbline.sources.stores import read_text, replace_text

# What the two systems are made of.
SYSTEM = {"baseline": ("dense", "scope"), "candidate": ("hybrid", "joint")}


def run_identity(dataset_sha256: str, config: dict, cases: DataFrame) -> str:
    """Digest of a dataset, a configuration and its cases (case_id), which must be unique; runs of one identity may be resumed."""
    require_empty(repeated_keys(cases, ["case_id"]), "repeated case")
    if config.get("system") not in SYSTEMS or (config.get("retrieval"), config.get("contract")) != SYSTEM[config["system"]]:
        raise ValueError(f"no such system: {config}")
    ids = cases.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("case_id").cast("string"))), "\n"), 256)).first()[0]
    return hashlib.sha256(json.dumps({"cases": ids, "config": config, "dataset": dataset_sha256}, sort_keys=True).encode()).hexdigest()


def ensure_manifest(spark: SparkSession, path: str, manifest: dict) -> bool:
    """Write a run's manifest, or find the same one there (then True: a run to resume); another one is an error."""
    text = json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=1)
    there = read_text(spark, path)
    if there is None:
        replace_text(spark, path, text)
        return False
    if json.loads(there) != json.loads(text):
        raise ValueError(f"{path} belongs to another run")
    return True


def enough_space(spark: SparkSession, path: str, least: int) -> None:
    """Raise if the store below a path has less than ``least`` bytes left."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    left = place.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus(place).getRemaining()
    if left < least:
        raise OSError(f"{left} bytes left at {path}, {least} needed")


def arms(spark: SparkSession, **settings: list) -> DataFrame:
    """A row for each combination of settings, with its name."""
    rows = [("-".join(f"{k}{v}" for k, v in zip(settings, x, strict=True)), *map(str, x)) for x in itertools.product(*settings.values())]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ("arm", *settings)))


def arm_table(all_arms: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every arm with its summary; what an arm lacks stays null."""
    return all_arms.join(summaries, "arm", "left")


def paired(extraction: DataFrame, retrievals: dict[str, Callable[[DataFrame], DataFrame]], judges: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Judged rows of every retrieval with every judge over one extraction, with columns retrieval and judge.

    Each retrieval is one plan that all judges read.
    """
    out = None
    for r, find in retrievals.items():
        found = find(extraction)
        for j, decide in judges.items():
            rows = decide(found).select(F.lit(r).alias("retrieval"), F.lit(j).alias("judge"), "*")
            out = rows if out is None else out.unionByName(rows)
    return out


def semantic_digest(row: Column, *timing: str) -> Column:
    """Digest of a struct without its measured fields (paths), so that two runs that said the same agree."""
    return digest(row.dropFields(*timing).alias("row"))


def quality_reference(rows: DataFrame, signature: Column) -> DataFrame:
    """case_id, digest of a run's rows; a repeated case is an error. Runs are compared by relations.reconcile()."""
    require_empty(repeated_keys(rows, ["case_id"]), "repeated case")
    return rows.select("case_id", signature.alias("digest"))


def admission_orders(target: str, first: tuple[str, ...], second: tuple[str, ...]) -> list[tuple[str, list[str]]]:
    """Orders in which a story meets a batch: alone, before and after the first neighbours, and before the second; neighbours are distinct."""
    if len({target, *first, *second}) != 1 + len(first) + len(second):
        raise ValueError("stories of a scenario must differ")
    return [("alone", [target]), ("first", [target, *first]), ("last", [*first, target]), ("other", [target, *second])]


def divergences(traces: dict[str, DataFrame], step: str, value: str) -> DataFrame:
    """left, right, step: for each pair of traces (step, value) the first step at which they differ; null if they agree."""
    out = None
    for a, b in itertools.combinations(sorted(traces), 2):
        both = traces[a].select(step, F.col(value).alias("__a")).join(traces[b].select(step, F.col(value).alias("__b")), step, "full")
        row = both.agg(F.min(F.when(~F.col("__a").eqNullSafe(F.col("__b")), F.col(step))).alias("step")).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "step")
        out = row if out is None else out.unionByName(row)
    return out
