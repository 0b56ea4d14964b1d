"""Scratch tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from plumbline.session import shared_dir


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it is computed once and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt and sorted by keys, once, and kept on the executors' disks: joins by these keys of what is read off it deal and sort nothing more.

    Parts that are lost with an executor are computed anew, so df should be cheap to read. It is kept until the session ends or clears its cache.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)
    rows.count()  # in one job, since several readers at once might compute it more than once
    return rows
