"""Keyword rules: tags of reference texts, failure classes, verdict and status precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import TIME

# The words that decide each tag.
DOMAINS = {
    "character": ("人物", "character"),
    "angel": ("天使", "angel"),
    "history": ("历史", "事件", "history"),
    "technology": ("科技", "技术", "technology"),
}
DIMENSIONS = {
    "physical_rule": ("生理", "心脏", "能力", "力量", "治疗", "机械", "义肢", "装备", "装甲", "续航", "冷却", "感知", "身体"),
    "character_knowledge": ("知道", "不知道", "认知", "保密", "告知", "秘密"),
    "character_relation": ("关系", "见面", "交谈", "父亲", "母亲", "契约", "宿主"),
    "identity": ("身份", "伪装", "代号", "真实姓名"),
    "space": ("地点", "位置", "城区", "地下", "广场", "教堂", "避难所", "档案馆", "交通", "列车"),
    "causality": ("导致", "因此", "使得", "使其", "后会", "才会", "触发", "副作用", "代价"),
    "world_rule": ("规则", "必须", "无法", "不能", "最多", "只有", "限制", "条件"),
}
DIMENSION_ALIASES = {
    "物理": "physical_rule",
    "生理": "physical_rule",
    "能力": "physical_rule",
    "认知": "character_knowledge",
    "知识": "character_knowledge",
    "关系": "character_relation",
    "身份": "identity",
    "空间": "space",
    "地点": "space",
    "因果": "causality",
    "时间": "time",
    "世界规则": "world_rule",
}
NEGATIVE = ("不", "无", "未", "没")
RESTRICTIVE = ("必须", "只有", "最多", "不能", "无法", "限制")
# Marks of each failure class, in the order in which classes are tried.
RETRY_CLASSES = (
    "JSON_PARSE_ERROR",
    "SCHEMA_VALIDATION_ERROR",
    "MISSING_TARGET_COVERAGE",
    "EMPTY_OUTPUT",
    "TRUNCATED_OUTPUT",
    "INVALID_FIELD_OR_REFERENCE",
    "BATCH_ROW_RETRY",
    "OTHER",
)
MISSING_TARGETS, MISSING = "未覆盖的target_spans", "missing target"
BAD_JSON = ("有效 json", "valid json")
TRUNCATED = ("输出上限", "truncat", "max_new_tokens")
BAD_REFERENCE = ("只能引用", "引用无效", "citation字段无效", "source_id无效", "context_id无效")
BAD_SCHEMA = ("字段无效", "字段不符合", "wire协议", "输出必须", "核对原因无效", "schema")
AUDIT_TOP = ("输出必须且只能包含", "Lean wire必须且只能包含")
AUDIT_EVENT = ("事件字段", "event字段")
AUDIT_REFERENCE = ("只能引用", "引用无效", "超出当前窗口", "不能重叠", "ignored_spans字段无效", "处置")
AUDIT_TYPE = ("核对原因无效", "modality", "reason无效", "必须为", "须为")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text holds one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def tags(text: Column, rules: dict[str, tuple[str, ...]], *more: Column) -> Column:
    """Sorted names of all rules with a word in text; ``more`` are nullable further tags."""
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(text, words), name) for name, words in rules.items()], *more)))


def domain(headings: Column, file: Column) -> Column:
    """First domain with a word in the top heading or the file's name without its ending."""
    stem = F.regexp_replace(F.substring_index(F.coalesce(file, F.lit("")), "/", -1), r"(?<=.)\.[^.]*$", "")
    where = F.concat_ws(" ", F.coalesce(F.get(headings, 0), F.lit("")), F.lower(stem))
    out = F.lit("other")
    for name, words in reversed(DOMAINS.items()):
        out = F.when(any_of(where, words), name).otherwise(out)
    return out


def scope(headings: Column) -> Column:
    """The heading above the last one, unless it is a time label or missing."""
    above = F.when(F.size(headings) > 1, F.element_at(headings, -2))
    return F.when(~above.rlike(f"^{TIME}$") & (F.trim(above) != ""), F.trim(above))


def times(text: Column) -> Column:
    """Sorted distinct time labels."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TIME})"), F.lit(1))))


def dimension_tags(headings: Column, text: Column, file: Column) -> Column:
    """Dimensions by their words, and time if a time label occurs or the domain is history."""
    seen = F.concat_ws(" ", headings, text)
    dated = (F.size(times(seen)) > 0) | (domain(headings, file) == "history")
    return tags(seen, DIMENSIONS, F.when(dated, "time"))


def polarity(text: Column) -> Column:
    """Surface polarity; affirmative if nothing else shows."""
    found = F.array_compact(F.array(F.when(any_of(text, NEGATIVE), "negative"), F.when(any_of(text, RESTRICTIVE), "restrictive")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("affirmative")))


def _first(cases: list[tuple[Column, str]]) -> Column:
    """Name of the first case that holds; a null counts as no."""
    out = F.lit("OTHER")
    for holds, name in reversed(cases):
        out = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def retry_class(purpose: Column, error: Column, error_type: Column, raw: Column) -> Column:
    """Why a call was repeated, from the failure before it."""
    e, low = F.coalesce(error, F.lit("")), F.lower(F.coalesce(error, F.lit("")))
    return _first(
        [
            ((purpose == "recover_missing_targets") | F.contains(e, F.lit(MISSING_TARGETS)) | F.contains(low, F.lit(MISSING)), "MISSING_TARGET_COVERAGE"),
            (F.trim(F.coalesce(raw, F.lit(""))) == "", "EMPTY_OUTPUT"),
            (F.contains(F.lower(error_type), F.lit("jsondecode")) | any_of(low, BAD_JSON), "JSON_PARSE_ERROR"),
            (any_of(low, TRUNCATED), "TRUNCATED_OUTPUT"),
            (any_of(e, BAD_REFERENCE), "INVALID_FIELD_OR_REFERENCE"),
            (any_of(e, BAD_SCHEMA), "SCHEMA_VALIDATION_ERROR"),
        ]
    )


def call_retry_class(component: Column, purpose: Column, error: Column, error_type: Column, raw: Column) -> Column:
    """retry_class(); calls of a judge batch are repeated row by row."""
    return F.when(component == "judge", "BATCH_ROW_RETRY").otherwise(retry_class(purpose, error, error_type, raw))


def audit_class(error: Column, error_type: Column, raw: Column) -> Column:
    """Class of a failed extraction attempt."""
    e, low = F.coalesce(error, F.lit("")), F.lower(F.coalesce(error, F.lit("")))
    return _first(
        [
            (F.contains(e, F.lit(MISSING_TARGETS)) | F.contains(low, F.lit(MISSING)), "MISSING_TARGET_COVERAGE"),
            (F.trim(F.coalesce(raw, F.lit(""))) == "", "EMPTY_OUTPUT"),
            (F.contains(F.lower(error_type), F.lit("jsondecode")) | any_of(low, ("expecting ", "有效 json")), "JSON_PARSE_ERROR"),
            (any_of(low, TRUNCATED), "TRUNCATED_OUTPUT"),
            (any_of(e, AUDIT_TOP) | (F.contains(e, F.lit("顶层")) & F.contains(e, F.lit("字段"))), "TOP_LEVEL_SCHEMA_ERROR"),
            (any_of(low, AUDIT_EVENT), "EVENT_FIELD_ERROR"),
            (any_of(e, AUDIT_REFERENCE), "INVALID_REFERENCE_OR_DISPOSITION"),
            (any_of(e, AUDIT_TYPE), "INVALID_ENUM_OR_TYPE"),
        ]
    )


def verdict_of(verdicts: Column) -> Column:
    """Aggregate: contradiction before uncertain before consistent; null if there is none."""
    rank = F.when(verdicts == "contradiction", 3).when(verdicts == "uncertain", 2).when(verdicts == "consistent", 1)
    top = F.max(rank)
    return F.when(top == 3, "contradiction").when(top == 2, "uncertain").when(top == 1, "consistent")


def status_of(statuses: Column) -> Column:
    """Aggregate: error if all failed, partial if any isn't ok, else ok."""
    failed, odd = F.count_if(statuses == "error"), F.count_if(~statuses.eqNullSafe(F.lit("ok")))
    return F.when((failed == F.count(F.lit(1))) & (failed > 0), "error").when(odd > 0, "partial").otherwise("ok")
