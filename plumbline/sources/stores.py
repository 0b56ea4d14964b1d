"""Stores of confirmed entries and records: read, preview, commit against a revision, export; and published indexes.

A store is a folder of versions and one small pointer file that names the current one. A version is written
beside the others and checked; only then the pointer is replaced, in one rename. Commits name the revision that they were
prepared on, so of two that were prepared on one only the first succeeds. Stores are kept by single writers on the
driver: entries are typed by people, not computed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import contracts
from plumbline.functions import shapes as S
from plumbline.operators.checks import repeated_keys, require_empty, violations

# Fields of entries, first lines of exports, labels of record fields.
ENTRY = "id string, entity string, category string, text string, event_time string, created_at string"
RECORD = "id string, kind string, entity string, entity_type string, category string, text string, target string, time string, valid_from string, valid_until string, created_at string, source_input string"
ENTRY_KEY = ("entity", "category", "text", "event_time")
ENTRY_HEAD = "# 用户确认录入（由 entries.json 生成，请勿直接编辑）"
RECORD_HEAD = "# 用户确认的通用世界观条目（由 world_records.json 生成，请勿直接编辑）"
RECORD_LINES = (("条目类型", "kind"), ("实体类型", "entity_type"), ("关系对象", "target"), ("事件时间", "time"), ("生效起点", "valid_from"), ("生效终点", "valid_until"))
WORLD = "世界规则"
EMPTY = "empty"
POINTER = "CURRENT"


class Conflict(ValueError):
    """The store has changed since a commit was prepared."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    opened = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode("utf-8")
    finally:
        opened.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there in one step, so readers see the old text or the new one."""
    fs, place = _fs(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(new)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(new, place, options)


class _Lock:
    """A file that only one writer can create."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs, self.path = _fs(spark, path)

    def __enter__(self) -> None:
        if not self.fs.createNewFile(self.path):
            raise Conflict("another commit is under way")

    def __exit__(self, *_: object) -> None:
        self.fs.delete(self.path, False)


class Store:
    """Rows of one schema with an id, under revisions."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: tuple[str, ...]):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def revision(self) -> str:
        return (read_text(self.spark, f"{self.folder}/{POINTER}") or EMPTY).strip()

    def problems(self, rows: DataFrame) -> DataFrame:
        """id, rule: rows that must not be in the store."""
        raise NotImplementedError

    def read(self, revision: str | None = None) -> DataFrame:
        """All rows of a revision, the current one unless named; broken or repeated ones are an error."""
        revision = revision or self.revision()
        if revision == EMPTY:
            return self.spark.createDataFrame([], self.schema)
        if len(revision) != 32 or not all(c in "0123456789abcdef" for c in revision):
            raise ValueError("the pointer names no version")
        rows = self.spark.read.schema(self.schema).option("mode", "FAILFAST").json(f"{self.folder}/version={revision}")
        require_empty(self.problems(rows), "broken row")
        require_empty(repeated_keys(rows, ["id"]), "repeated id")
        return rows

    def commit(self, rows: DataFrame, revision: str) -> str:
        """Add rows (without id and created_at) that were prepared on a revision; all or none. Returns the new revision.

        Rows that are there already, by all fields of the key, or are given twice, are an error.
        """
        with _Lock(self.spark, f"{self.folder}/.lock"):
            if self.revision() != revision:
                raise Conflict("the store has changed since the preview")
            old = self.read(revision)
            stamped = rows.withColumns({"id": F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")}).select(*old.columns)
            require_empty(self.problems(stamped), "broken row")
            require_empty(repeated_keys(rows, list(self.key)), "given twice")
            same = F.lit(True)
            for k in self.key:
                same &= F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
            require_empty(rows.alias("n").join(old.alias("o"), same, "left_semi"), "already stored")
            version = uuid.uuid4().hex
            old.unionByName(stamped).coalesce(1).write.json(f"{self.folder}/version={version}")
            self.read(version)
            replace_text(self.spark, f"{self.folder}/{POINTER}", version)
            return version

    def lines(self) -> Column:
        """The lines of a row's section in an export."""
        raise NotImplementedError

    def export(self, path: str, head: str) -> None:
        """All rows as Markdown, in the order they were added; a file with another first line is not overwritten."""
        there = read_text(self.spark, path)
        if there is not None and not there.startswith(head):
            raise ValueError(f"{path} was written by hand")
        rows = self.read().orderBy("created_at", "id").select(F.array_join(self.lines(), "\n").alias("section")).collect()  # typed by people: few
        replace_text(self.spark, path, "\n".join([head, "", *[r["section"] for r in rows]]))


def _indented(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "\n$", ""), "\r\n|[\n\r]"), lambda x: F.concat(F.lit("    "), x))


def _maybe(label: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(f"    {label}："), c))).otherwise(F.array().cast("array<string>"))


class EntryStore(Store):
    """Entries of an author: entity, category, text, event_time."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, ENTRY, ENTRY_KEY)

    def problems(self, rows: DataFrame) -> DataFrame:
        single = lambda c: ~F.col(c).rlike("[\n\r]")
        return violations(rows, "id", entry_rules() | {"id": F.col("id").isNotNull(), "created_at": F.col("created_at").isNotNull(), "line": single("entity") & single("category")})

    def preview(self, entity: str, category: str, text: str, chunks: DataFrame, event_time: str | None = None) -> tuple[DataFrame, DataFrame, str]:
        """The proposed entry, what is known of the entity (category, text, source, same_category), and the revision to commit it on."""
        proposed = self.spark.createDataFrame([(entity.strip(), category.strip(), text.strip(), event_time)], "entity string, category string, text string, event_time string")
        require_empty(violations(proposed, "entity", entry_rules()), "broken entry")
        revision = self.revision()
        h = F.col("heading_path")
        known = chunks.where((F.size(h) >= 2) & (F.element_at(h, -2) == entity.strip())).select(F.element_at(h, -1).alias("category"), "text", F.col("chunk_id").alias("source"))
        known = known.unionByName(self.read(revision).where(F.col("entity") == entity.strip()).select("category", "text", F.col("id").alias("source")))
        return proposed, known.withColumn("same_category", F.col("category") == category.strip()), revision

    def lines(self) -> Column:
        none = F.concat(F.lit("## "), F.col("entity")), F.concat(F.lit("### "), F.col("category")), F.lit("")
        return F.concat(F.array(*none), _maybe("事件时间", F.col("event_time")), _indented(F.col("text")), F.array(F.lit("")))

    def export(self, path: str, head: str = ENTRY_HEAD) -> None:
        super().export(path, head)


def entry_rules() -> dict[str, Column]:
    """What an entry must satisfy: filled texts, names and times on one line."""
    line = lambda c: S.filled(F.col(c)) & ~F.col(c).rlike("[\n\r]")
    return {"entity": line("entity"), "category": line("category"), "text": S.filled(F.col("text")), "event_time": F.col("event_time").isNull() | line("event_time")}


class WorldStore(Store):
    """Typed records, each with the input that it was taken from."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, RECORD, contracts.RECORD_FIELDS)

    def problems(self, rows: DataFrame) -> DataFrame:
        record = F.struct(*contracts.RECORD_FIELDS)
        own = dict(contracts.record_rules(record, F.col("source_input")))
        return violations(rows, "id", own | {"id": F.col("id").isNotNull(), "created_at": F.col("created_at").isNotNull()})

    def preview(self, records: DataFrame, source: str, rows: DataFrame) -> tuple[DataFrame, DataFrame, str]:
        """Records with their source, what a catalog (operators.lore) has under the same entity and category, and the revision to commit them on."""
        proposed = records.select(*contracts.RECORD_FIELDS, F.lit(source).alias("source_input"))
        rules = dict(contracts.record_rules(F.struct(*contracts.RECORD_FIELDS), F.col("source_input")))
        require_empty(violations(proposed, "text", rules), "broken record")
        named = proposed.select(F.col("entity").alias("e"), F.col("category").alias("c")).distinct()
        known = rows.join(named, F.col("entity").eqNullSafe(F.col("e")) & F.col("category").eqNullSafe(F.col("c")), "left_semi")
        return proposed, known, self.revision()

    def lines(self) -> Column:
        head = F.array(F.concat(F.lit("## "), F.coalesce(F.nullif(F.col("entity"), F.lit("")), F.lit(WORLD))), F.concat(F.lit("### "), F.col("category")), F.lit(""))
        return F.concat(head, *[_maybe(label, F.col(c)) for label, c in RECORD_LINES], _maybe("主体", F.col("entity")), _indented(F.col("text")), F.array(F.lit("")))

    def export(self, path: str, head: str = RECORD_HEAD) -> None:
        super().export(path, head)
