"""Report documents: sections of tables, lists and notes, stated over DataFrames and written in one ordered pass.

A document is a specification. Each part turns its rows into lines where they lie; only finished lines, in order, reach the driver, and
no more than ``most`` of them: a report is read by a person.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NONE = "N/A"


def number(value: str | Column, digits: int = 4, none: str = NONE) -> Column:
    """A number with a fixed count of digits."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNull(), none).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def whole(value: str | Column, none: str = NONE) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.cast("long").cast("string"), F.lit(none))


def share(part: str, of: str, none: str = NONE) -> Column:
    """part/of as two whole numbers."""
    return F.concat_ws("/", whole(part, none), whole(of, none))


def percent(value: str | Column, digits: int = 2, none: str = NONE) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c.isNull(), none).otherwise(F.concat(F.format_string(f"%.{digits}f", c.cast("double") * 100), F.lit("%")))


def several(*parts: Column, between: str = " / ") -> Column:
    return F.concat_ws(between, *parts)


def words(value: str | Column, none: str = NONE) -> Column:
    """A text in one cell or item: no bars and no line breaks."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.regexp_replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), "[\r\n]+", " "), F.lit(none))


@dataclass(frozen=True)
class Note:
    """A paragraph: pieces of text and, from the one row of ``rows``, values."""

    pieces: tuple[str | Column, ...]
    rows: DataFrame | None = None

    def lines(self, spark: SparkSession) -> DataFrame:
        rows = spark.range(1) if self.rows is None else self.rows.limit(2)
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in self.pieces])
        return rows.select(F.lit(0).cast("long").alias("place"), text.alias("line"))


@dataclass(frozen=True)
class Items:
    """A list: an item for each row, in the order of ``order``."""

    rows: DataFrame
    item: Column
    order: tuple[str, ...]
    numbered: bool = False
    empty: str = "none"

    def lines(self, spark: SparkSession) -> DataFrame:
        placed = self.rows.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*self.order)).cast("long").alias("place"), self.item.alias("item"))
        mark = F.concat(F.col("place").cast("string"), F.lit(". ")) if self.numbered else F.lit("- ")
        return _or(placed.select("place", F.concat(mark, "item").alias("line")), ("- " if not self.numbered else "") + self.empty, spark, 1)


@dataclass(frozen=True)
class Table:
    """A table: columns are (header, text, whether it is a number), rows in the order of ``order``."""

    rows: DataFrame
    columns: tuple[tuple[str, Column, bool], ...]
    order: tuple[str, ...]

    def lines(self, spark: SparkSession) -> DataFrame:
        bar = lambda cells: "| " + " | ".join(cells) + " |"
        head = [bar([h for h, _, _ in self.columns]), "|" + "|".join("---:" if n else "---" for _, _, n in self.columns) + "|"]
        top = spark.createDataFrame(list(enumerate(head)), "place long, line string")
        placed = self.rows.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*self.order)) + 1).cast("long").alias("place"), *[c.alias(f"c{i}") for i, (_, c, _) in enumerate(self.columns)])
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[f"c{i}" for i in range(len(self.columns))]), F.lit(" |"))
        return top.unionByName(_or(placed.select("place", cells.alias("line")), bar([NONE] * len(self.columns)), spark, 2))


def _or(rows: DataFrame, empty: str, spark: SparkSession, place: int) -> DataFrame:
    """rows, or one line if there are none."""
    some = rows.agg(F.count("*").alias("n"))
    instead = some.where("n = 0").select(F.lit(place).cast("long").alias("place"), F.lit(empty).alias("line"))
    return rows.unionByName(instead)


@dataclass(frozen=True)
class Section:
    title: str
    parts: tuple[Note | Items | Table, ...]
    level: int = 2


@dataclass(frozen=True)
class Document:
    title: str
    sections: tuple[Section, ...]
    intro: tuple[Note | Items | Table, ...] = field(default=())


def lines(spark: SparkSession, document: Document) -> DataFrame:
    """section (0: the title), part, place, line of a document; part 0 of a section is its heading."""
    frames = [spark.createDataFrame([(i, 0, 0, f"{'#' * level} {title}") for i, (level, title) in enumerate([(1, document.title), *[(s.level, s.title) for s in document.sections]])], "section int, part int, place long, line string")]
    for i, parts in enumerate([document.intro, *[s.parts for s in document.sections]]):
        frames += [p.lines(spark).select(F.lit(i).alias("section"), F.lit(k).alias("part"), "place", "line") for k, p in enumerate(parts, 1)]
    return reduce(DataFrame.unionByName, frames)


def text(spark: SparkSession, document: Document, most: int = 5_000) -> str:
    """The document as Markdown: headings and parts stand apart by an empty line."""
    rows = lines(spark, document).orderBy("section", "part", "place").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report should be a summary")
    out, last = [], None
    for r in rows:
        if last not in (None, (r["section"], r["part"])):
            out.append("")
        last = (r["section"], r["part"])
        out.append(r["line"])
    return "\n".join(out) + "\n"


# Three layouts.


def benchmark_summary(headline: DataFrame, errors: DataFrame, performance: DataFrame, run: DataFrame) -> Document:
    """headline: conflict_f1, extraction_recall, hallucination_rate, recall_at_k, judge_accuracy (one row). errors: cause, n.
    performance: metric, median, least, most, spread. run: batch_size, repeats (one row)."""
    named = (("Conflict F1", "conflict_f1"), ("Extraction recall", "extraction_recall"), ("Hallucination rate", "hallucination_rate"), ("Recall at k", "recall_at_k"), ("Judge accuracy", "judge_accuracy"))
    each = headline.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for i, (n, c) in enumerate(named)])).alias("x")).select("x.*")
    return Document(
        "Benchmark summary",
        (
            Section("Quality", (Table(each, (("Metric", words("metric"), False), ("Value", number("value"), True)), ("i",)),)),
            Section("Errors by first cause", (Table(errors, (("Cause", words("cause"), False), ("Count", whole("n"), True)), ("cause",)),)),
            Section(
                "Performance",
                (
                    Table(performance, (("Metric", words("metric"), False), *[(h, number(c), True) for h, c in (("Median", "median"), ("Least", "least"), ("Most", "most"), ("Spread", "spread"))]), ("metric",)),
                    Note(("Batch size: ", whole("batch_size"), "; repeats: ", whole("repeats"), "."), run),
                ),
            ),
        ),
    )


def batch_comparison(baseline: DataFrame, arms: DataFrame, failures: DataFrame) -> Document:
    """baseline: recall, precision (one row). arms: batch_size, mean_batch, calls, retries, recoveries, input_tokens, padded_tokens,
    output_tokens, ttft_p50, ttft_p95, prefill, decode, seconds, wall, decode_rate, story_rate, peak_bytes, recall, precision, pending.
    failures: batch_size, reason."""
    d = "—"
    n = lambda c, k=2: number(c, k, d)
    columns = (
        ("Batch", whole("batch_size"), True), ("Mean batch", n("mean_batch"), True), ("Calls", whole("calls"), True), ("Retries / recoveries", several(whole("retries"), whole("recoveries")), True),
        ("Input / padded / output tokens", several(*map(whole, ("input_tokens", "padded_tokens", "output_tokens"))), True), ("First token p50 / p95 ms", several(n("ttft_p50"), n("ttft_p95")), True),
        ("Prefill / decode / model / wall s", several(*map(n, ("prefill", "decode", "seconds", "wall"))), True), ("Decode tokens/s", n("decode_rate"), True), ("Stories/s", n("story_rate", 3), True),
        ("Peak GiB", n(F.col("peak_bytes") / 2**30), True), ("Recall / precision", several(percent("recall", none=d), percent("precision", none=d)), True), ("Events to review", whole("pending"), True),
    )
    return Document(
        "Extraction in batches",
        (Section("Arms", (Table(arms, columns, ("batch_size",)),)), Section("Failures", (Items(failures, several(whole("batch_size"), words("reason"), between=": "), ("batch_size", "reason")),))),
        intro=(Note(("Baseline: recall ", percent("recall", none=d), ", precision ", percent("precision", none=d), "."), baseline), Note(("Only extraction ran again; events that are new or changed count once they are reviewed.",))),
    )


def case_report(totals: DataFrame, groups: DataFrame, confusion: DataFrame, times: DataFrame, cases: DataFrame, labels: tuple[str, ...]) -> Document:
    """totals: inputs, valid, overall, claims_found, claims, verdicts, complete (one row). groups: grp and the same counts.
    confusion: expected and a column for each of ``labels``. times: name, n, median, p95. cases: case_id, grp, expected, observed, verdicts, claims, seconds, complete."""
    listed = (("Valid replies", "valid", "inputs"), ("Overall label as expected", "overall", "inputs"), ("Claims found", "claims_found", "claims"), ("Verdicts right", "verdicts", "claims"), ("All standards met", "complete", "inputs"))
    items = totals.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"{n}: "), share(a, b)).alias("t")) for i, (n, a, b) in enumerate(listed)])).alias("x")).select("x.*")
    return Document(
        "Checks of single claims",
        (
            Section("Totals", (Items(items, F.col("t"), ("i",)),)),
            Section("By group", (Table(groups, (("Group", words("grp"), False), ("Inputs", whole("inputs"), True), ("Overall", whole("overall"), True), ("Verdicts", share("verdicts", "claims"), True), ("Complete", whole("complete"), True)), ("grp",)),)),
            Section("Confusion", (Table(confusion, (("Expected", words("expected"), False), *[(x, whole(F.col(f"`{x}`")), True) for x in labels]), ("expected",)),)),
            Section("Times", (Items(times, F.concat(words("name"), F.lit(": n="), whole("n"), F.lit(", median "), number("median", 3), F.lit(" s, p95 "), number("p95", 3), F.lit(" s")), ("name",)),)),
            Section("Cases", (Table(cases, (("Case", words("case_id"), False), ("Group", words("grp"), False), ("Expected", words("expected"), False), ("Observed", words("observed"), False), ("Verdicts", share("verdicts", "claims"), True), ("Seconds", number("seconds", 2), True), ("Complete", F.when(F.col("complete"), "yes").otherwise("no"), False)), ("case_id",)),)),
        ),
    )
