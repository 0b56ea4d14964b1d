"""Looks at JSON of unknown shape, by variants: kinds, closed key sets, texts.

A text that is no JSON, or names a key of an object twice, has no shape: every rule on it is broken.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, Column]]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: as a lambda's variable it is not copied into each place that reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def parsed(raw: Column) -> Column:
    return F.try_parse_json(raw)


def part(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str = "$") -> Column:
    """The schema of a part: STRING, BOOLEAN, VOID, ARRAY<...>, OBJECT<...>; null where there is none."""
    return F.schema_of_variant(part(v, path))


def text(v: Column, path: str) -> Column:
    """A string part; null for anything else."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def texts(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<string>")


def rows(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def keys(v: Column, path: str = "$") -> Column:
    return F.json_object_keys(F.to_json(part(v, path)))


def yes(c: Column) -> Column:
    """c, with no for null."""
    return F.coalesce(c, F.lit(False))


def has_keys(v: Column, need: tuple[str, ...], may: tuple[str, ...] = (), path: str = "$") -> Column:
    """Whether a part is an object with all needed keys and no others than the allowed ones."""
    own = keys(v, path)
    names = lambda of: F.array(*[F.lit(k) for k in of]).cast("array<string>")
    return yes((F.size(F.array_except(names(need), own)) == 0) & (F.size(F.array_except(own, names(need + may))) == 0))


def filled(t: Column) -> Column:
    """Whether a text holds more than white space."""
    return yes(t.rlike(r"(?U)\S"))


def is_text(v: Column, path: str) -> Column:
    return filled(text(v, path))


def is_texts(v: Column, path: str, some: bool = False, distinct: bool = False) -> Column:
    """Whether a part is an array of filled texts; ``some``: not an empty one."""
    ok = kind(v, path).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(texts(v, path), lambda x: filled(x))
    if some:
        ok &= F.size(texts(v, path)) > 0
    if distinct:
        ok &= F.size(F.array_distinct(texts(v, path))) == F.size(texts(v, path))
    return yes(ok)


def is_flag(v: Column, path: str, or_null: bool = False) -> Column:
    return yes(kind(v, path).isin("BOOLEAN", *(["VOID"] if or_null else [])))


def is_list(v: Column, path: str) -> Column:
    return yes(kind(v, path).startswith("ARRAY<"))


def one_of(v: Column, path: str, values: tuple[str, ...]) -> Column:
    return yes(text(v, path).isin(*values))


def first_broken(rules: Rules) -> Column:
    """Name of the first rule that does not hold; null if all do. A null counts as broken."""
    return reduce(lambda rest, r: F.when(~yes(r[1]), r[0]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
