"""Text functions: tokens, spans, query texts, digests."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.shapes import let

# CJK blocks and word characters of the tokenizer, clause marks, time labels.
CJK = "㐀-䶿一-鿿豈-﫿"
TOKEN = f"[{CJK}]+|[a-z0-9_]+"
#: Texts of these characters alone have the same tokens in NFKC form.
SAME_TOKENS = f"^[\\x00-\\x7F\\xC0-\\xFF{CJK}，。！？；：、“”‘’《》（）—–…]*$"
CLAUSE_END = "，,。！？!?；;"
TIME = "(?:[0-9]{3,4}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?|第[零〇一二三四五六七八九十百千万0-9]+[话章节卷幕])"
SPAN_CHARS = 180


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC form; no built-in function has it. Plain ASCII passes as it is."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def tokenize(text: Column) -> Column:
    """Lower-case tokens of the NFKC form: a CJK run gives its characters, then its pairs; other words stay whole.

    Only texts whose tokens NFKC may change go through Python, and only those with CJK characters through the lambda
    that cuts runs.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.lower(F.coalesce(nfkc(F.when(~text.rlike(SAME_TOKENS), text)), text))
    runs = F.regexp_extract_all(plain, F.lit(f"({TOKEN})"), F.lit(1))

    def cut(run: Column) -> Column:
        n = F.length(run)
        ones = F.transform(F.sequence(F.lit(1), n), lambda i: run.substr(i, F.lit(1)))
        twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: run.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(ones, twos)).otherwise(F.array(run))

    return F.when(plain.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, cut))).otherwise(runs)


def searchable(headings: Column, text: Column) -> Column:
    """What BM25 sees of a chunk: its headings and its text on lines of their own."""
    return F.array_join(F.concat(F.coalesce(headings, F.array().cast("array<string>")), F.array(F.coalesce(text, F.lit("")))), "\n")


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("text", T.StringType()), ("start", T.IntegerType()), ("stop", T.IntegerType()))]))
_clause = re.compile(f"[^\r\n{CLAUSE_END}]+[{CLAUSE_END}]?")


def _spans_of(text: str | None, most: int | None) -> list[tuple[str, str, int, int]]:
    found: list[tuple[str, str, int, int]] = []
    for m in _clause.finditer(text or ""):
        clause = m.group()
        start = m.start() + len(clause) - len(clause.lstrip())
        stop = m.start() + len(clause.rstrip())
        step = most or max(1, stop - start)
        found += [(f"S{len(found) + i + 1}", text[a : min(a + step, stop)], a, min(a + step, stop)) for i, a in enumerate(range(start, stop, step))]
    return found


def split_spans(text: Column, most: int | None = SPAN_CHARS) -> Column:
    """Clauses with code-point offsets (end exclusive), trimmed and cut at ``most`` characters; none for blank text."""

    @F.arrow_udf(SPAN_TYPE)
    def spans(texts: pa.Array) -> pa.Array:
        return _spans_in_pieces(texts, most)

    return spans(text)


#: Texts whose spans are Python objects at a time.
SPAN_PIECE = 100


def _spans_in_pieces(texts: pa.Array, most: int | None) -> pa.Array:
    """Spans of each text; columns are built piece by piece, so that few spans are Python objects at a time."""
    pieces = [_span_lists(texts.slice(i, SPAN_PIECE).to_pylist(), most) for i in range(0, len(texts), SPAN_PIECE)]
    return pa.concat_arrays(pieces) if pieces else _span_lists([], most)


def _span_lists(texts: list[str | None], most: int | None) -> pa.Array:
    ends, columns = [0], ([], [], [], [])
    for t in texts:
        for s in _spans_of(t, most):
            for column, value in zip(columns, s, strict=True):
                column.append(value)
        ends.append(len(columns[0]))
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "text", "start", "stop"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def span_sizes(text: Column, most: int | None = SPAN_CHARS) -> Column:
    """Characters of each span of split_spans(), without the texts."""

    @F.pandas_udf("array<int>")
    def sizes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [len(s[1]) for s in _spans_of(t, most)])

    return sizes(text)


SPACES = "\t\x0b\f \x1c\x1d\x1e\x1f\x85\xa0"


def clause_texts(text: Column, most: int = SPAN_CHARS) -> Column:
    """The texts of split_spans() without offsets, by built-in functions alone.

    A line is broken after each mark by plain replacements, which cost far less than a regular expression with these classes.
    """
    broken = F.translate(F.coalesce(text, F.lit("")), "\r", "\n")
    for mark in dict.fromkeys(CLAUSE_END):
        broken = F.replace(broken, F.lit(mark), F.lit(mark + "\n"))
    raw = F.filter(F.split(broken, "\n", -1), lambda c: ~c.isin("", *CLAUSE_END))  # a mark alone ends no clause
    clauses = F.filter(F.transform(raw, lambda c: F.btrim(c, F.lit(SPACES))), lambda c: c != "")
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.length(c) - 1) / most).cast("int")), lambda i: c.substr(i * most + 1, F.lit(most)))
    return let(clauses, lambda found: F.when(F.exists(found, lambda c: F.length(c) > most), F.flatten(F.transform(found, cut))).otherwise(found))


def lines(*parts: Column, distinct: bool = False) -> Column:
    """Non-empty parts on lines of their own, in order."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != ""))
    return F.array_join(F.array_distinct(kept) if distinct else kept, "\n")


def digest(*columns: str | Column) -> Column:
    """SHA-256 of the columns as JSON with keys in alphabetical order; null fields stay visible."""
    ordered = sorted(columns, key=str)
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces, for digests that other programs must reproduce byte by byte."""

    def canonical(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(canonical)
