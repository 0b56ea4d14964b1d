"""Reference collections: metadata tables, catalogs of names and times, targets, presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules
from plumbline.functions.stats import ratio
from plumbline.functions.text import TIME
from plumbline.operators.lookup import inside


def vocabulary(chunks: DataFrame) -> DataFrame:
    """name: the scopes of all chunks (heading_path), the names that entities are looked for by."""
    return chunks.select(rules.scope(F.col("heading_path")).alias("name")).where("name IS NOT NULL").distinct()


def metadata(chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """chunk_id, file, start_line, end_line, heading_path, domain, primary_scope, category, entities, time_markers, dimension_tags, polarity_tags, ordered by nothing.

    chunks: chunk_id, file, start_line, end_line, heading_path, text. Entities are the collection's own scopes that stand in a text,
    found in one pass, and the chunk's scope.
    """
    names = vocabulary(chunks) if names is None else names
    h, t = F.col("heading_path"), F.coalesce("text", F.lit(""))
    seen = inside(chunks, "chunk_id", "text", names).groupBy("chunk_id").agg(F.collect_set("name").alias("__in"))
    own = F.array_compact(F.array("primary_scope"))
    out = chunks.join(seen, "chunk_id", "left").select(
        "chunk_id", "file", "start_line", "end_line", "heading_path", rules.domain(h, F.col("file")).alias("domain"), rules.scope(h).alias("primary_scope"), F.try_element_at(h, F.lit(-1)).alias("category"),
        F.coalesce("__in", F.array().cast("array<string>")).alias("__in"), rules.times(F.concat_ws(" ", h, t)).alias("time_markers"), rules.dimension_tags(h, t, F.col("file")).alias("dimension_tags"), rules.polarity(t).alias("polarity_tags"),
    )
    entities = F.array_sort(F.array_union("__in", own))
    rest = [c for c in out.columns if c != "__in"]
    return out.select(*rest[: rest.index("category") + 1], entities.alias("entities"), *rest[rest.index("category") + 1 :])


def metadata_summary(items: DataFrame) -> DataFrame:
    """section, name, n, rate: domains, dimension tags, and the share of chunks for which each field says something."""
    whole = F.broadcast(items.agg(F.count("*").alias("__n")))
    filled = {"primary_scope": F.col("primary_scope").isNotNull(), **{c: F.size(c) > 0 for c in ("entities", "time_markers", "dimension_tags")}}
    cells = F.concat(
        F.array(F.struct(F.lit("domain").alias("section"), F.col("domain").alias("name"))),
        F.transform("dimension_tags", lambda d: F.struct(F.lit("dimension").alias("section"), d.alias("name"))),
        F.array_compact(F.array(*[F.when(ok, F.struct(F.lit("coverage").alias("section"), F.lit(c).alias("name"))) for c, ok in filled.items()])),
    )
    g = items.select(F.explode(cells).alias("x")).groupBy("x.section", "x.name").agg(F.count("*").alias("n")).join(whole)
    return g.select("section", "name", "n", ratio(F.col("n"), F.col("__n")).alias("rate"))


def metadata_digest(items: DataFrame) -> DataFrame:
    """One row: n, sha256 over the rows' own digests in order of chunk_id; the same for the same rows in any order."""
    row = F.sha2(F.to_json(F.struct(*sorted(items.columns)), {"ignoreNullFields": "false"}), 256)
    pair = items.select("chunk_id", row.alias("d")).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "d"))).alias("x"))
    return pair.select(F.size("x").cast("long").alias("n"), F.sha2(F.array_join(F.transform("x", lambda r: r.d), ""), 256).alias("sha256"))


def metadata_problems(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, problem: chunks without metadata, metadata without a chunk, and repeated rows."""
    m = items.groupBy("chunk_id").agg(F.count("*").alias("m"))
    both = m.join(chunks.select("chunk_id", F.lit(1).alias("c")).distinct(), "chunk_id", "full")
    problem = F.when(F.col("m").isNull(), "missing").when(F.col("c").isNull(), "unknown").when(F.col("m") > 1, "twice")
    return both.select("chunk_id", problem.alias("problem")).where("problem IS NOT NULL")


def catalog(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """source, entity, category, text, marks (other names and times of a record): rows of the collection and of records together."""
    h = F.col("heading_path")
    above = F.when(F.size(h) >= 2, F.element_at(h, -2))
    a = chunks.select(F.col("chunk_id").alias("source"), above.alias("entity"), F.try_element_at(h, F.lit(-1)).alias("category"), "text", F.array().cast("array<string>").alias("marks"))
    marks = F.array_compact(F.array("target", "time", "valid_from", "valid_until"))
    return a.unionByName(records.select(F.col("id").alias("source"), "entity", "category", "text", marks.alias("marks")))


def catalog_names(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """kind (name, time), label: what the collection's scopes and the records name."""
    above = F.when(F.size("heading_path") >= 2, F.element_at("heading_path", -2))
    a = chunks.select(above.alias("label")).where("label IS NOT NULL").select(F.when(F.col("label").rlike(f"^{TIME}$"), "time").otherwise("name").alias("kind"), "label")
    b = records.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("label")) for k, c in (("name", "entity"), ("name", "target"), ("time", "time"), ("time", "valid_from"), ("time", "valid_until"))])).alias("x")).select("x.*")
    return a.unionByName(b).where("label <> ''").distinct()


def presence(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """label, status (mentioned, not_found_in_catalog), sources: where labels (label) stand as an entity, a mark or inside a text of a catalog."""
    named = rows.select("source", F.explode(F.array_union(F.array_compact(F.array("entity")), F.col("marks"))).alias("label"))
    named = named.join(labels.select("label").distinct(), "label", "left_semi").select("source", "label")
    told = inside(rows, "source", "text", labels.select(F.col("label").alias("name"))).withColumnRenamed("name", "label")
    found = named.unionByName(told.select("source", "label")).groupBy("label").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    out = labels.select("label").distinct().join(found, "label", "left")
    return out.select("label", F.when(F.col("sources").isNull(), "not_found_in_catalog").otherwise("mentioned").alias("status"), F.coalesce("sources", F.array().cast(dict(found.dtypes)["sources"])).alias("sources"))


def targets(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """target_id, chunk_id, problem (none, ambiguous) of labels by file and heading suffix (target_id, file, suffix); exactly one chunk may fit."""
    tail = lambda n: F.slice("heading_path", F.greatest(F.size("heading_path") - n + 1, F.lit(1)), n)
    met = wanted.join(chunks.select("file", "chunk_id", "heading_path"), "file").where((F.size("suffix") <= F.size("heading_path")) & (tail(F.size("suffix")) == F.col("suffix")))
    g = met.groupBy("target_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id"))
    out = wanted.select("target_id").join(g, "target_id", "left")
    problem = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous")
    return out.select("target_id", F.when(F.col("n") == 1, F.col("chunk_id")).alias("chunk_id"), problem.alias("problem"))


def first_mentions(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """word, chunk_id: the first chunk (by ord) that holds each word."""
    met = inside(chunks, "chunk_id", "text", words.select(F.col("word").alias("name"))).withColumnRenamed("name", "word")
    return met.join(chunks.select("chunk_id", "ord"), "chunk_id").groupBy("word").agg(F.min_by("chunk_id", "ord").alias("chunk_id"))


def labelled(evidence: Column, letter: str = "L") -> Column:
    """Evidence with labels L1, L2, .. that a model names it by: array of struct(evidence_id, id, text)."""
    return F.transform(evidence, lambda c, i: F.struct(F.concat(F.lit(letter), i + 1).alias("evidence_id"), c.id.alias("id"), c.text.alias("text")))
