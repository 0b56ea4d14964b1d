"""Session construction for jobs, benches and tests."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every plan here relies on.

    UTC keeps timestamps comparable between engines, adaptive execution splits
    skewed joins and merges small partitions.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session that names none gets a temporary one; a cluster must name its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = now.get() if now.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application, so that Python functions can import it there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / "plumbline.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted((root / "plumbline").rglob("*.py")):
                out.write(source, source.relative_to(root))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query, with the package sent to the executors first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run
