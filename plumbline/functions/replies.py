"""Replies of models parsed once: a typed struct per reply that contracts are rules over.

JSON is read in one Arrow pass, which also stands as a border in the plan: rules refer to columns, and nothing is parsed again for each of
them. A text that is no JSON, or names a key of an object twice, has no keys and no parts, so every rule on it is broken.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = ("same_subject", "evidence_applicable", "can_both_be_true", "assumptions_required")
#: A reply with an answer. Texts are null where a part is none; flags are true, false, null (said) or other, and null where absent;
#: lists of texts are null unless all items are texts or null.
ANSWER = (
    "keys array<string>, verdict string, reason string, ids array<string>, "
    "citations array<struct<keys: array<string>, label: string, quote: string>>, "
    "held array<string>, " + ", ".join(f"{f} string" for f in FLAGS) + ", relation string, assumptions array<string>"
)
#: A reply with findings: each with its keys, parts and citations.
FINDINGS = (
    "keys array<string>, findings array<struct<keys: array<string>, input_quote: string, verdict: string, reason: string, new_candidates: array<string>, "
    "evidence: array<struct<keys: array<string>, label: string, quote: string>>>>"
)
#: A flat reply: its keys, which of them hold texts or null, and the texts.
FLAT = "keys array<string>, kinds map<string, string>, texts map<string, string>"


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key twice")
    return out


def _no_number(name: str) -> None:
    raise ValueError(name)


def read(raw: str | None) -> object:
    """The value of a JSON text; KeyError stands for none."""
    try:
        return KeyError if raw is None else json.loads(raw, object_pairs_hook=_unique, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return KeyError


def _keys(x: object) -> list[str] | None:
    return list(x) if isinstance(x, dict) else None


def _text(x: object, key: str) -> str | None:
    v = x.get(key) if isinstance(x, dict) else None
    return v if isinstance(v, str) else None


def _texts(x: object, key: str) -> list[str | None] | None:
    v = x.get(key) if isinstance(x, dict) else None
    return v if isinstance(v, list) and all(i is None or isinstance(i, str) for i in v) else None


def _items(x: object, key: str) -> list | None:
    v = x.get(key) if isinstance(x, dict) else None
    return v if isinstance(v, list) else None


def _flag(x: object, key: str) -> str | None:
    if not isinstance(x, dict) or key not in x:
        return None
    v = x[key]
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else "other"


def _kind(v: object) -> str:
    return "null" if v is None else "flag" if isinstance(v, bool) else "text" if isinstance(v, str) else "number" if isinstance(v, (int, float)) else "list" if isinstance(v, list) else "object"


def _cited(x: object, key: str, label: str) -> list[dict] | None:
    found = _items(x, key)
    return None if found is None else [{"keys": _keys(c), "label": _text(c, label), "quote": _text(c, "quote")} for c in found]


def _answer(x: object) -> dict:
    a = x.get("assessment") if isinstance(x, dict) else None
    return {
        "keys": _keys(x), "verdict": _text(x, "verdict"), "reason": _text(x, "reason"), "ids": _texts(x, "evidence_ids"), "citations": _cited(x, "citations", "evidence_id"),
        "held": _keys(a), **{f: _flag(a, f) for f in FLAGS}, "relation": _text(a, "relation"), "assumptions": _texts(a, "assumptions"),
    }


def _findings(x: object) -> dict:
    found = _items(x, "findings")
    each = lambda f: {
        "keys": _keys(f), "input_quote": _text(f, "input_quote"), "verdict": _text(f, "verdict"), "reason": _text(f, "reason"),
        "new_candidates": _texts(f, "new_candidates"), "evidence": _cited(f, "evidence", "chunk_id"),
    }
    return {"keys": _keys(x), "findings": None if found is None else list(map(each, found))}


def _flat(x: object) -> dict:
    own = x if isinstance(x, dict) else {}
    return {"keys": _keys(x), "kinds": {k: _kind(v) for k, v in own.items()}, "texts": {k: v for k, v in own.items() if isinstance(v, str)}}


def _typed(raw: Column, kind: str, look: Callable[[object], dict]) -> Column:
    names = [f.split(" ", 1)[0] for f in _split(kind)]

    @F.pandas_udf(f"struct<{', '.join(f.replace(' ', ': ', 1) for f in _split(kind))}>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([look(read(t)) for t in texts], columns=names, dtype=object)

    return parse(raw)


def _split(kind: str) -> list[str]:
    """The fields of a row's schema."""
    out, depth = [""], 0
    for c in kind:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def answer(raw: Column) -> Column:
    """A reply with an answer as a struct of ANSWER."""
    return _typed(raw, ANSWER, _answer)


def findings(raw: Column) -> Column:
    """A reply with findings as a struct of FINDINGS."""
    return _typed(raw, FINDINGS, _findings)


def flat(raw: Column) -> Column:
    """A reply without nested parts as a struct of FLAT."""
    return _typed(raw, FLAT, _flat)
