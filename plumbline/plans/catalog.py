"""Queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import audits, changing, derived, ledgers, ranking, reviewed, stages, texts, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (texts, ranking, audits, tracks, ledgers, stages, changing, derived, reviewed):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
