"""Several outputs of one run that are published together: readers see all of a version or none of it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.stores import POINTER, read_text, replace_text

#: What a table is written as; a text is a small document.
FORMATS = ("parquet", "json", "csv")


def publish(spark: SparkSession, folder: str, outputs: dict[str, DataFrame | str], formats: dict[str, str] | None = None, config: dict | None = None) -> str:
    """Write all outputs beside the versions before, then a manifest that names them, then move the pointer; returns the version.

    Tables are parquet unless ``formats`` says json or csv; texts are written as they are. Each table's rows are counted when it is read
    back, so a write that lost rows is an error. If anything fails, the pointer stays where it was and what was written is no version.
    """
    formats = formats or {}
    for name in outputs:
        if not name or name.strip(".") != name or "/" in name or formats.get(name, "parquet") not in FORMATS:
            raise ValueError(f"no output can be called or written so: {name}")
    version = uuid.uuid4().hex
    path, told = f"{folder}/version={version}", {}
    for name, output in outputs.items():
        if isinstance(output, str):
            replace_text(spark, f"{path}/{name}", output)
            told[name] = {"format": "text", "characters": len(output)}
            continue
        kind = formats.get(name, "parquet")
        seen = Observation()
        counted = output.observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = counted.write.option("header", True) if kind == "csv" else counted.write
        getattr(writer, kind)(f"{path}/{name}")
        rows = _read(spark, f"{path}/{name}", kind, output.schema).count()
        if rows != seen.get["rows"]:
            raise ValueError(f"{name} was not written whole")
        told[name] = {"format": kind, "schema": output.schema.json(), "rows": rows}
    replace_text(spark, f"{folder}/manifest={version}", json.dumps({"config": config or {}, "outputs": told}, sort_keys=True))
    replace_text(spark, f"{folder}/{POINTER}", version)
    return version


def _read(spark: SparkSession, path: str, kind: str, schema) -> DataFrame:
    reader = spark.read.schema(schema)
    return getattr(reader.option("header", True) if kind == "csv" else reader, kind)(path)


def load(spark: SparkSession, folder: str, version: str | None = None) -> dict[str, DataFrame | str]:
    """The outputs of the current version, or of a named one."""
    from pyspark.sql.types import StructType

    version = version or (read_text(spark, f"{folder}/{POINTER}") or "").strip()
    manifest = json.loads(read_text(spark, f"{folder}/manifest={version}") or "null") if version else None
    if manifest is None:
        raise ValueError(f"{folder} has no published version")
    out: dict[str, DataFrame | str] = {}
    for name, told in manifest["outputs"].items():
        path = f"{folder}/version={version}/{name}"
        if told["format"] == "text":
            out[name] = read_text(spark, path)
            if out[name] is None or len(out[name]) != told["characters"]:
                raise ValueError(f"{name} differs from its manifest")
        else:
            out[name] = _read(spark, path, told["format"], StructType.fromJson(json.loads(told["schema"])))
    return out


def verify(spark: SparkSession, folder: str) -> None:
    """Count the current version's rows; another number than its manifest's is an error."""
    version = (read_text(spark, f"{folder}/{POINTER}") or "").strip()
    outputs = load(spark, folder, version)
    told = json.loads(read_text(spark, f"{folder}/manifest={version}"))["outputs"]
    for name, output in outputs.items():
        if not isinstance(output, str) and output.count() != told[name]["rows"]:
            raise ValueError(f"{name} differs from its manifest")
