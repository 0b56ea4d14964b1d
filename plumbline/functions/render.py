"""Markdown of small, finished tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def cell(value: object) -> str:
    """A value as text; null is N/A, and ratios have four digits."""
    if value is None:
        return "N/A"
    if isinstance(value, float):
        return f"{value:.4f}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def table(rows: DataFrame, order: Iterable[str], most: int = 1000) -> str:
    """A Markdown table of at most ``most`` rows; reports are summaries, so more is an error."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("a report table should be a summary")
    head = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return "\n".join(head + [f"| {' | '.join(cell(v) for v in r)} |" for r in found]) + "\n"


def report(title: str, sections: list[tuple[str, DataFrame, list[str]]]) -> str:
    """A titled report of tables."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{table(rows, order)}" for name, rows, order in sections)
