"""Replies of models as JSON: repair, expansion, decoding and projection, by variants and higher-order functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import contracts
from plumbline.functions import shapes as S

# Field names and words of the event wire, and the misspellings that replies showed.
MODALITIES = ("observed", "speech", "belief", "plan", "dream", "conditional", "inferred")
CHECK_REASONS = ("mechanism", "knowledge_relation", "state_time_space", "consequence_support")
IGNORE_REASONS = ("routine", "process_detail")
EXITS = ("events", "ignored_spans", "non_event_span_ids")
LEAN_EXITS = ("events", "ignored_span_ids", "non_event_span_ids")
NEEDED = ("actors", "event", "source_ids", "modality", "check_reason")
OPTIONAL = ("explicit", "mental_state", "conditions", "context_ids")
LEAN_NEEDED = ("actors", "event", "modality", "source_ids", "context_ids", "check_reason")
LEAN_OPTIONAL = ("mental_state", "conditions")
EVENT_FIELDS = ("id", "actors", "event", "mental_state", "explicit", "modality", "conditions", "source_ids", "context_ids", "check_reason")
EARLY_FIELDS = ("actors", "event", "mental_state", "explicit", "modality", "conditions", "source_ids", "context_ids")
LISTS = ("actors", "conditions", "source_ids", "context_ids")
MISSPELLED = (("events", "mentalological_state", "mental_state"), ("ignored_spans", "source_Ids", "source_id"))
FIELD_ALIASES = {
    "checkreason": "check_reason",
    "checkReason": "check_reason",
    "contextips": "context_ids",
    "contextIds": "context_ids",
    "sourceIds": "source_ids",
    "mentalological": "mental_state",
    "mentalronic": "mental_state",
    "mentalState": "mental_state",
}
REASON_ALIASES = {"mechanibility": "mechanism", "mechanical": "mechanism", "observed": "state_time_space"}
DECISIONS = {
    "routine": "ignore",
    "process_detail": "ignore",
    "mechanism": "keep",
    "knowledge_relation": "keep",
    "state_time_space": "keep",
    "consequence_support": "keep",
    "unclear": "review",
}
RECORD_KEYS = {"k": "kind", "e": "entity", "y": "entity_type", "c": "category", "x": "target", "t": "time", "f": "valid_from", "u": "valid_until"}
NO_TIME = ("未知", "未指定", "未提供", "不明确", "无", "null", "None")
TIME_NODE = "时间节点"
FACT_TYPES = ("character_attribute", "character_knowledge", "relationship", "location", "timeline", "world_rule", "technology", "object_state", "identity", "causality")
FACT_PRONOUNS = ("他", "她", "它", "他们", "她们", "它们", "我", "你", "我们", "此人", "这个人")
TRAILER = "^(说明|解释)\\s*[：:]"
CUT_REPLY, SENTENCE_END = '"evidence_ids"}', r"[。！？!?；;\r\n]"
EVENT = "struct<actors: array<string>, event: string, mental_state: string, explicit: boolean, modality: string, conditions: array<string>, source_ids: array<string>, context_ids: array<string>, check_reason: string>"
MOST_EVENTS, MOST_FACTS, MOST_REASON = 40, 20, 80
BUDGET, LEAST_OUTPUT, MOST_OUTPUT = 4096, 256, 1536
_NONE = lambda: F.array().cast("array<string>")


def misspelled(raw: Column) -> Column:
    """array of struct(path, from, to): fields of known wrong names whose right name is free."""
    v = S.parsed(raw)

    def found(table: str, wrong: str, right: str) -> Column:
        path = lambda i: F.concat(F.lit(f"{table}["), i.cast("string"), F.lit("]"))
        here = lambda x, name: S.part(x, f"$.{name}").isNotNull()
        move = lambda i: F.struct(path(i).alias("path"), F.lit(wrong).alias("from"), F.lit(right).alias("to"))
        return F.array_compact(F.transform(S.rows(v, f"$.{table}"), lambda x, i: F.when(here(x, wrong) & ~here(x, right), move(i))))

    return F.concat(*[F.coalesce(found(*m), F.array().cast("array<struct<path: string, from: string, to: string>>")) for m in MISSPELLED])


_place = re.compile(r"(\w+)\[(\d+)\]").fullmatch


@F.pandas_udf(T.StringType())
def _moved(replies: pd.Series, moves: pd.Series) -> pd.Series:
    """Replies with fields renamed at the given places; a renamed field comes last, and the text has no spaces."""

    def one(raw: str | None, todo) -> str | None:
        if raw is None:
            return None
        value = json.loads(raw)
        for m in todo:
            table, i = _place(m["path"]).groups()
            row = value[table][int(i)]
            value[table][int(i)] = {**{k: x for k, x in row.items() if k != m["from"]}, m["to"]: row[m["from"]]}
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([one(*x) for x in zip(replies, moves, strict=True)], dtype=object)


def repair(raw: Column) -> Column:
    """struct(raw, actions): replies with misspelled names put right, and what was done; untouched replies keep every byte.

    What is wrong is found by a variant; only replies with something to move reach Python.
    """
    moves = misspelled(raw)
    broken = F.size(moves) > 0
    return F.struct(F.coalesce(_moved(F.when(broken, raw), moves), raw).alias("raw"), moves.alias("actions"))


def rename_key(raw: Column, wrong: str, right: str) -> Column:
    """A flat JSON object with one key renamed unless the right one is there; native and otherwise byte by byte the same."""
    keys = F.json_object_keys(raw)
    wanted = F.array_contains(keys, wrong) & ~F.array_contains(keys, right)
    return F.when(wanted, F.regexp_replace(raw, f'"{wrong}"(\\s*:)', f'"{right}"$1')).otherwise(raw)


def unknown_keys(raw: Column, known: tuple[str, ...]) -> Column:
    """Keys of a JSON object beyond the known ones; null for what is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in known])))


def fields(v: Column) -> Column:
    """A variant object as a map of its fields; null for anything else."""
    return F.try_variant_get(v, "$", "map<string, variant>")


def _pick(m: Column, *names: str) -> Column:
    """The field of the first name that the map has."""
    return F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names])


def _string(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _strings(x: Column) -> Column:
    """A list of texts, or a text as a list of one."""
    return F.when(F.schema_of_variant(x) == "STRING", F.array(F.try_variant_get(x, "$", "string"))).otherwise(F.try_variant_get(x, "$", "array<string>"))


def _spelled(name: str) -> tuple[str, ...]:
    return (name, *[a for a, right in FIELD_ALIASES.items() if right == name])


def _reason(code: Column) -> Column:
    for wrong, right in REASON_ALIASES.items():
        code = F.when(code == wrong, right).otherwise(code)
    return code


def compact_event(v: Column) -> Column:
    """struct(error, event) of a compact event: aliases resolved and left-out fields filled in.

    An alias counts where the right name is free; beside the right name it is an unknown field.
    """
    m = fields(v)
    own = F.map_keys(m)
    of = {n: _pick(m, *_spelled(n)) for n in (*NEEDED, *OPTIONAL)}
    known = F.array(*[F.lit(n) for n in (*NEEDED, *OPTIONAL)])
    aliases = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(r).alias("r")) for a, r in FIELD_ALIASES.items()])
    met = F.filter(aliases, lambda x: F.array_contains(own, x.a))
    stray = F.exists(met, lambda x: F.array_contains(own, x.r)) | (F.size(F.array_distinct(F.transform(met, lambda x: x.r))) < F.size(met))
    extra = F.size(F.array_except(own, F.array_union(known, F.array(*[F.lit(a) for a in FIELD_ALIASES])))) > 0
    told = F.try_variant_get(of["explicit"], "$", "boolean")
    modality = _string(of["modality"])
    error = S.first_broken(
        [
            ("object", m.isNotNull()),
            ("fields", F.forall(F.array(*[of[n].isNotNull() for n in NEEDED]), lambda x: x) & ~extra & ~stray),
            ("modality", modality.isin(*MODALITIES)),
            ("explicit", of["explicit"].isNull() | (F.schema_of_variant(of["explicit"]).eqNullSafe(F.lit("BOOLEAN")) & (told == (modality != "inferred")))),
        ]
    )
    lists = lambda n: F.try_variant_get(of[n], "$", "array<string>")
    event = F.struct(
        lists("actors").alias("actors"),
        _string(of["event"]).alias("event"),
        _string(of["mental_state"]).alias("mental_state"),
        (modality != "inferred").alias("explicit"),
        modality.alias("modality"),
        F.coalesce(lists("conditions"), _NONE()).alias("conditions"),
        lists("source_ids").alias("source_ids"),
        F.coalesce(lists("context_ids"), _NONE()).alias("context_ids"),
        _reason(_string(of["check_reason"])).alias("check_reason"),
    )
    return F.struct(error.alias("error"), F.when(error.isNull(), event).alias("event"))


def expand_event(e: Column) -> Column:
    """A typed compact event with the fields that it may leave out."""
    return F.struct(
        e.actors.alias("actors"),
        e.event.alias("event"),
        e.mental_state.alias("mental_state"),
        (e.modality != "inferred").alias("explicit"),
        e.modality.alias("modality"),
        F.coalesce(e.conditions, _NONE()).alias("conditions"),
        e.source_ids.alias("source_ids"),
        F.coalesce(e.context_ids, _NONE()).alias("context_ids"),
        e.check_reason.alias("check_reason"),
    )


def expand_payload(raw: Column) -> Column:
    """struct(error, events) of a compact reply: all three exits must be there as arrays, and all events expand."""
    v = S.parsed(raw)
    shape = S.first_broken([("exits", S.has_keys(v, EXITS)), *[(e, S.is_list(v, f"$.{e}")) for e in EXITS]])

    def told(made: Column) -> Column:
        error = F.coalesce(shape, F.get(F.filter(F.transform(made, lambda x: x.error), lambda x: x.isNotNull()), 0))
        return F.struct(error.alias("error"), F.when(error.isNull(), F.transform(made, lambda x: x.event)).alias("events"))

    return S.let(F.transform(S.rows(v, "$.events"), compact_event), told)


def lean_payload(raw: Column) -> Column:
    """struct(error, changes, events, ignored_spans, non_event_span_ids) of a lean reply on the full wire.

    Field names may differ in case; a name in two cases is an error. Lean ignored ids count as process details.
    """
    v = S.parsed(raw)
    names = (*LEAN_NEEDED, *LEAN_OPTIONAL)

    def one(x: Column) -> Column:
        m = fields(x)
        named = lambda n: F.map_filter(m, lambda k, _: F.lower(k) == n)
        of = {n: F.get(F.map_values(named(n)), 0) for n in names}
        low = F.transform(F.map_keys(m), lambda k: F.lower(k))
        error = S.first_broken(
            [
                ("event object", m.isNotNull()),
                ("field case", F.size(F.array_distinct(F.filter(low, lambda k: k.isin(*names)))) == F.size(F.filter(low, lambda k: k.isin(*names)))),
                ("event fields", F.forall(F.array(*[F.size(named(n)) == 1 for n in LEAN_NEEDED]), lambda ok: ok) & F.forall(low, lambda k: k.isin(*names))),
            ]
        )
        lists = lambda n: F.try_variant_get(of[n], "$", "array<string>")
        modality = _string(of["modality"])
        event = F.struct(
            lists("actors").alias("actors"), _string(of["event"]).alias("event"), _string(of["mental_state"]).alias("mental_state"), (modality != "inferred").alias("explicit"), modality.alias("modality"),
            F.coalesce(lists("conditions"), _NONE()).alias("conditions"), lists("source_ids").alias("source_ids"), lists("context_ids").alias("context_ids"), _string(of["check_reason"]).alias("check_reason"),
        )
        return F.struct(error.alias("error"), F.exists(F.map_keys(m), lambda k: (F.lower(k) != k) & F.lower(k).isin(*names)).alias("folded"), event.alias("event"))

    ignored = S.texts(v, "$.ignored_span_ids")
    shape = S.first_broken(
        [
            ("exits", S.has_keys(v, LEAN_EXITS)),
            *[(e, S.is_list(v, f"$.{e}")) for e in LEAN_EXITS],
            ("ignored ids", S.is_texts(v, "$.ignored_span_ids", distinct=True)),
        ]
    )

    def told(made: Column) -> Column:
        error = F.coalesce(shape, F.get(F.filter(F.transform(made, lambda x: x.error), lambda x: x.isNotNull()), 0))
        ok = error.isNull()
        return F.struct(
            error.alias("error"),
            F.when(F.exists(made, lambda x: x.folded), F.array(F.lit("event_field_case_normalized"))).otherwise(_NONE()).alias("changes"),
            F.when(ok, F.transform(made, lambda x: x.event)).alias("events"),
            F.when(ok, F.transform(ignored, lambda i: F.struct(i.alias("source_id"), F.lit("process_detail").alias("reason")))).alias("ignored_spans"),
            F.when(ok, S.texts(v, "$.non_event_span_ids")).alias("non_event_span_ids"),
        )

    return S.let(F.transform(S.rows(v, "$.events"), one), told)


def in_scope(ids: Column, targets: Column) -> Column:
    """The ids of a recovery reply that it was asked about, in order."""
    return F.filter(ids, lambda i: F.array_contains(targets, i))


def early_event(v: Column) -> Column:
    """struct(event, defaulted, changes) of an event of the first wire: names by case, lone texts as lists, left-out fields."""
    m = fields(v)
    right = lambda n: F.map_contains_key(m, F.lit(n))
    other = lambda n: F.get(F.filter(F.map_keys(m), lambda k: (F.lower(k) == n) & (k != n)), 0)
    of = {n: F.when(right(n), F.try_element_at(m, F.lit(n))).otherwise(F.try_element_at(m, other(n))) for n in EARLY_FIELDS}
    changes = [F.when(~right(n) & other(n).isNotNull(), F.concat(F.lit("field_case_normalized:"), other(n))) for n in EARLY_FIELDS]
    changes += [F.when((F.schema_of_variant(of[n]) == "STRING") & S.filled(_string(of[n])), F.lit(f"{n}_scalar_wrapped")) for n in LISTS]
    optional = ("mental_state", "conditions", "context_ids")
    defaulted = [F.when(of[n].isNull(), F.lit(n)) for n in optional]
    event = F.struct(
        _strings(of["actors"]).alias("actors"),
        _string(of["event"]).alias("event"),
        _string(of["mental_state"]).alias("mental_state"),
        F.try_variant_get(of["explicit"], "$", "boolean").alias("explicit"),
        _string(of["modality"]).alias("modality"),
        F.coalesce(_strings(of["conditions"]), _NONE()).alias("conditions"),
        _strings(of["source_ids"]).alias("source_ids"),
        F.coalesce(_strings(of["context_ids"]), _NONE()).alias("context_ids"),
    )
    return F.struct(F.when(m.isNotNull(), event).alias("event"), F.array_compact(F.array(*defaulted)).alias("defaulted"), F.array_compact(F.array(*changes)).alias("changes"))


def _text_of(spans: Column, i: Column) -> Column:
    return F.get(F.filter(spans, lambda s: s.id == i), 0).text


def with_actor_context(e: Column, spans: Column, context_ids: Column, target_ids: Column) -> Column:
    """An event with, for each actor that its references don't mention, the nearest earlier span of the window that does.

    Actors are taken in order, since what one adds may mention the next. spans: array of struct(id, text, ..).
    """
    order = F.concat(context_ids, target_ids)
    places = F.filter(F.transform(e.source_ids, lambda i: F.array_position(order, i)), lambda p: p > 0)
    before = F.when(F.size(places) > 0, F.slice(order, F.lit(1), (F.array_min(places) - 1).cast("int"))).otherwise(order)

    def add(held: Column, actor: Column) -> Column:
        says = lambda i: S.yes(F.contains(_text_of(spans, i), actor))
        known = F.concat(e.source_ids, held)
        found = F.filter(before, lambda i: says(i) & ~F.array_contains(known, i))
        return F.when(F.exists(known, says) | (F.size(found) == 0), held).otherwise(F.array_append(held, F.try_element_at(found, F.lit(-1))))

    return e.withField("context_ids", F.aggregate(e.actors, e.context_ids, add))


def settle_window(events: Column, ignored: Column, non_events: Column, spans: Column, context_ids: Column, target_ids: Column) -> Column:
    """struct(events, ignored_spans, non_event_span_ids, changes): a window's reply after its unambiguous mistakes are mended.

    Actors get their nearest mention as context, events that rest on context alone go, and a span keeps its first
    disposition: event before ignored before none. events: array of events, ignored: array of struct(source_id, reason).
    """
    outside = lambda i: S.yes(F.array_contains(context_ids, i) & ~F.array_contains(target_ids, i))
    ids = F.transform(ignored, lambda x: x.source_id)
    on_context = lambda e: (F.size(e.source_ids) > 0) & F.forall(e.source_ids, outside)

    def sources(grounded: Column) -> Column:
        kept = F.filter(grounded, lambda e: ~on_context(e))
        return F.struct(grounded.alias("grounded"), kept.alias("kept"), F.flatten(F.transform(kept, lambda e: e.source_ids)).alias("sources"))

    def claims(x: Column) -> Column:
        once = F.filter(ignored, lambda g, i: ~outside(g.source_id) & ~S.yes(F.array_contains(x.sources, g.source_id)) & (F.array_position(ids, g.source_id) == i + 1))
        return F.struct(x.grounded.alias("grounded"), x.kept.alias("kept"), once.alias("once"), F.concat(x.sources, F.transform(once, lambda g: g.source_id)).alias("taken"))

    def told(x: Column) -> Column:
        rest = F.filter(non_events, lambda n, i: ~outside(n) & ~S.yes(F.array_contains(x.taken, n)) & (F.array_position(non_events, n) == i + 1))
        away = F.exists(ids, outside) | F.exists(non_events, outside)
        changes = [
            F.when(F.exists(F.arrays_zip(events.alias("a"), x.grounded.alias("b")), lambda z: F.size(z.a.context_ids) < F.size(z.b.context_ids)), F.lit("actor_context_added")),
            F.when(F.size(x.kept) < F.size(x.grounded), F.lit("context_event_removed")),
            F.when(away, F.lit("context_disposition_removed")),
            F.when(F.size(F.filter(ids, lambda i: ~outside(i))) > F.size(x.once), F.lit("duplicate_ignored_removed")),
            F.when(F.size(F.filter(non_events, lambda i: ~outside(i))) > F.size(rest), F.lit("duplicate_non_event_removed")),
        ]
        return F.struct(x.kept.alias("events"), x.once.alias("ignored_spans"), rest.alias("non_event_span_ids"), F.array_compact(F.array(*changes)).alias("changes"))

    grounded = F.transform(events, lambda e: with_actor_context(e, spans, context_ids, target_ids))
    return S.let(S.let(S.let(grounded, sources), claims), told)


def event_error(e: Column, span_ids: Column, referenced: Column) -> Column:
    """Name of the first rule that an event breaks: enums, flags, grounding and disjoint references; null for a valid one."""
    return (
        F.when(~F.coalesce(e.modality.isin(*MODALITIES), F.lit(False)), "modality")
        .when(~F.coalesce(e.check_reason.isin(*CHECK_REASONS), F.lit(False)), "check_reason")
        .when(F.coalesce(F.trim(e.event), F.lit("")) == "", "event")
        .when(e.explicit.isNotNull() & (e.explicit != (e.modality != "inferred")), "explicit")
        .when(F.size(F.coalesce(e.source_ids, F.array())) == 0, "source_ids")
        .when(F.size(F.array_except(F.concat(e.source_ids, F.coalesce(e.context_ids, F.array())), span_ids)) > 0, "reference")
        .when(F.arrays_overlap(e.source_ids, F.coalesce(e.context_ids, F.array().cast("array<string>"))), "overlap")
        .when(~F.forall(F.coalesce(e.actors, F.array()), lambda a: F.contains(referenced, a)), "actor")
    )


def window_error(reply: Column, spans: Column, context_ids: Column, target_ids: Column) -> Column:
    """Error of a settled reply (struct of events, ignored_spans, non_event_span_ids) as a whole: every target has one disposition."""
    allowed = F.concat(target_ids, context_ids)
    text_of = lambda e: F.array_join(F.transform(F.concat(e.source_ids, e.context_ids), lambda i: F.coalesce(_text_of(spans, i), F.lit(""))), "")
    events = F.get(F.filter(F.transform(reply.events, lambda e: event_error(e, allowed, text_of(e))), lambda x: x.isNotNull()), 0)
    sources = F.flatten(F.transform(reply.events, lambda e: e.source_ids))
    ignored = F.transform(reply.ignored_spans, lambda x: x.source_id)
    all_ = F.concat(F.array_distinct(sources), ignored, reply.non_event_span_ids)
    rest = S.first_broken(
        [
            ("source scope", F.size(F.array_except(sources, target_ids)) == 0),
            ("ignored", F.size(F.array_except(ignored, target_ids)) == 0),
            ("ignore reason", F.forall(reply.ignored_spans, lambda x: S.yes(x.reason.isin(*IGNORE_REASONS)))),
            ("non event", F.size(F.array_except(reply.non_event_span_ids, target_ids)) == 0),
            ("repeated disposition", F.size(F.array_distinct(all_)) == F.size(all_)),
            ("uncovered", F.size(F.array_except(target_ids, all_)) == 0),
        ]
    )
    return F.coalesce(events, rest)


def early_envelope_error(v: Column, target_ids: Column) -> Column:
    """Error of a reply of the first wire: at most 40 events, and non-event spans among the targets and apart from sources."""
    none = F.coalesce(S.texts(v, "$.non_event_span_ids"), _NONE())
    sources = F.flatten(F.coalesce(F.transform(S.rows(v, "$.events"), lambda e: F.coalesce(S.texts(e, "$.source_ids"), _NONE())), F.array().cast("array<array<string>>")))
    listed = S.kind(v, "$.non_event_span_ids").isNull() | S.yes(S.kind(v, "$.non_event_span_ids").isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(F.array_distinct(none)) == F.size(none)))
    return S.first_broken(
        [
            ("fields", S.has_keys(v, ("events",), ("non_event_span_ids",)) & S.is_list(v, "$.events") & (F.size(S.rows(v, "$.events")) <= MOST_EVENTS)),
            ("non event ids", listed),
            ("non event scope", F.size(F.array_except(none, target_ids)) == 0),
            ("both", ~F.arrays_overlap(F.array_compact(sources), F.array_compact(none)) | (F.size(none) == 0)),
        ]
    )


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("value", "rest")]))
def leading_object(replies: pd.Series) -> pd.DataFrame:
    """The JSON object that a reply starts with, and what follows it; null without one."""
    out = []
    for raw in replies:
        try:
            value, end = json.JSONDecoder().raw_decode((raw or "").strip())
            out.append((json.dumps(value, ensure_ascii=False), (raw or "").strip()[end:].strip()) if isinstance(value, dict) else (None, None))
        except ValueError:
            out.append((None, None))
    return pd.DataFrame(out, columns=["value", "rest"])


def tolerated(lead: Column) -> Column:
    """struct(value, note, error) of leading_object(): a lone quote or a marked explanation may follow the object, nothing else."""
    prose = lead.rest.rlike(TRAILER) & ~lead.rest.rlike(r"[{}\[\]]")
    note = F.when(lead.rest == '"', "single_trailing_quote_removed").when(prose, "trailing_explanation_removed")
    ok = S.yes((lead.rest == "") | note.isNotNull())
    return F.struct(F.when(ok, lead.value).alias("value"), F.when(ok, note).alias("note"), F.when(lead.value.isNull(), "no object").when(~ok, "trailing content").alias("error"))


def cut_answer(raw: Column) -> Column:
    """struct(raw, note): an uncertain answer that breaks off before its empty list of evidence, completed; others as they are."""
    whole = F.regexp_replace(F.trim(raw), r"\}$", ":[]}")
    fits = F.try_parse_json(raw).isNull() & F.trim(raw).endswith(CUT_REPLY) & S.yes(S.text(F.try_parse_json(whole), "$.verdict") == contracts.SAID[2])
    return F.struct(F.when(S.yes(fits), whole).otherwise(raw).alias("raw"), F.when(S.yes(fits), "missing_empty_uncertain_evidence_array").alias("note"))


def extractor_projection(raw: Column) -> Column:
    """The shortest reply that keeps events and what became of every span: ignored spans without their reasons."""
    v = S.parsed(raw)
    ids = F.array_compact(F.transform(S.rows(v, "$.ignored_spans"), lambda x: F.coalesce(F.nullif(S.text(x, "$.source_id"), F.lit("")), _string(x))))
    return F.to_json(
        F.struct(
            F.coalesce(S.part(v, "$.events"), F.parse_json(F.lit("[]"))).alias("events"),
            F.coalesce(ids, _NONE()).alias("ignored_span_ids"),
            F.coalesce(S.part(v, "$.non_event_span_ids"), F.parse_json(F.lit("[]"))).alias("non_event_span_ids"),
        )
    )


def judge_projection(verdict: Column, reason: Column, citation_ids: Column) -> Column:
    """The shortest answer that keeps a verdict checkable: citations and a cut reason for contradictions only."""
    conflict = verdict == "contradiction"
    return F.to_json(F.struct(verdict.alias("verdict"), F.when(conflict, citation_ids).alias("citation_ids"), F.when(conflict, F.substring(F.coalesce(reason, F.lit("")), 1, MOST_REASON)).alias("reason")))


def decision(v: Column) -> Column:
    """struct(error, event_id, decision, reason_code, note) of a filter decision: its code says what it may be.

    A code that stands in the decision's place as well is read as the code's decision.
    """
    code, said = S.text(v, "$.reason_code"), S.text(v, "$.decision")
    due = F.try_element_at(F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair]), code)
    error = S.first_broken([("fields", S.has_keys(v, ("event_id", "decision", "reason_code"))), ("reason_code", due.isNotNull()), ("decision", (said == due) | (said == code))])
    ok = error.isNull()
    return F.struct(
        error.alias("error"),
        F.when(ok, S.text(v, "$.event_id")).alias("event_id"),
        F.when(ok, due).alias("decision"),
        F.when(ok, code).alias("reason_code"),
        F.when(ok & (said == code), "decision_from_reason_code").alias("note"),
    )


def guarded_decision(said: Column, modality: Column, review_reasons: Column) -> Column:
    """A decision, or review where an inferred event would be ignored or one without a clear actor kept."""
    unsure = ((said == "ignore") & (modality == "inferred")) | ((said == "keep") & S.yes(F.array_contains(review_reasons, "unresolved_actor")))
    return F.when(S.yes(unsure), "review").otherwise(said)


def short_record(v: Column, source: Column, spans: Column) -> Column:
    """struct(error, record) of a record with one-letter keys; spans: array of struct(id, text) that ``s`` names.

    Times that only say that there is none are none. Entities and time nodes are their own text.
    """
    named = {full: S.text(v, f"$.{k}") for k, full in RECORD_KEYS.items()}
    bare = lambda t: F.when(S.filled(t) & ~(F.trim(t).isin(*NO_TIME) & ~F.contains(source, t)), t)
    named |= {n: bare(named[n]) for n in ("time", "valid_from", "valid_until")}
    node, thing = S.yes(named["kind"] == "timepoint"), S.yes(named["kind"] == "entity")
    ref = S.text(v, "$.s")
    named["category"] = F.coalesce(named["category"], F.when(thing, named["entity_type"]).when(node, F.lit(TIME_NODE)))
    named["time"] = F.coalesce(named["time"], F.when(node, named["entity"]))
    named["text"] = F.when(node | thing, named["entity"]).otherwise(_text_of(spans, ref))
    strings = F.forall(F.array(*[S.kind(v, f"$.{k}") for k in RECORD_KEYS]), lambda k: k.isNull() | k.isin("STRING", "VOID"))
    shape = [("fields", S.has_keys(v, (), (*RECORD_KEYS, "s")) & strings), ("span", F.when(node | thing, ref.isNull()).otherwise(_text_of(spans, ref).isNotNull()))]

    def judged(r: Column) -> Column:
        return F.struct(S.first_broken([*shape, *contracts.record_rules(r, source)]).alias("error"), r.alias("record"))

    return S.let(S.let(F.struct(*[named[n].alias(n) for n in contracts.RECORD_FIELDS]), judged), lambda x: F.struct(x.error.alias("error"), F.when(x.error.isNull(), x.record).alias("record")))


def decoded_records(v: Column, source: Column, spans: Column) -> Column:
    """struct(error, records, rejected, duplicates, status) of a reply with 1 to 20 short records; places count from 1."""
    made = F.transform(S.rows(v, "$.records"), lambda x, i: F.struct((i + 1).alias("at"), short_record(x, source, spans).alias("r")))
    shape = S.has_keys(v, ("records",)) & S.is_list(v, "$.records") & F.size(S.rows(v, "$.records")).between(1, contracts.MOST_RECORDS)

    def sorted_out(m: Column) -> Column:
        good = F.filter(m, lambda x: x.r.error.isNull())
        return F.struct(
            good.alias("good"),
            F.transform(good, lambda x: x.r.record).alias("kinds"),
            F.transform(F.filter(m, lambda x: x.r.error.isNotNull()), lambda x: F.struct(x.at.alias("at"), x.r.error.alias("error"))).alias("rejected"),
        )

    def told(x: Column) -> Column:
        first = lambda g, i: F.array_position(x.kinds, g.r.record) == i + 1
        error = S.first_broken([("source", S.filled(source)), ("records", shape), ("all rejected", F.size(x.good) > 0)])
        ok = error.isNull()
        return F.struct(
            error.alias("error"),
            F.when(ok, F.transform(F.filter(x.good, first), lambda g: g.r.record)).alias("records"),
            F.when(ok, x.rejected).alias("rejected"),
            F.when(ok, F.transform(F.filter(x.good, lambda g, i: ~first(g, i)), lambda g: g.at)).alias("duplicates"),
            F.when(ok, F.when(F.size(x.rejected) > 0, "partial").otherwise("complete")).alias("status"),
        )

    return S.let(S.let(made, sorted_out), told)


def fact(v: Column, story: Column, spans: Column, defer_grounding: bool = False) -> Column:
    """struct(error, grounding_error, fact) of a suggested fact; spans: array of struct(id, text, start, stop).

    The subject must stand in the references, or in the one span of the story that names it, if that ends before the
    first reference and in the same sentence; that span then becomes context.
    """
    span = lambda i: F.get(F.filter(spans, lambda s: s.id == i), 0)
    subject, said_time = S.text(v, "$.subject"), S.text(v, "$.time")
    obj = F.nullif(F.trim(F.coalesce(S.text(v, "$.object"), F.lit(""))), F.lit(""))
    sources, contexts = S.texts(v, "$.source_ids"), F.coalesce(S.texts(v, "$.context_ids"), _NONE())
    by_place = lambda ids: F.transform(F.array_sort(F.transform(ids, lambda i: F.struct(span(i).start.alias("start"), i.alias("id")))), lambda x: x.id)
    line = lambda n: S.is_text(v, f"$.{n}") & ~S.yes(S.text(v, f"$.{n}").rlike("[\n\r]"))
    refs = lambda n, some: S.is_texts(v, f"$.{n}", some=some, distinct=True) & S.yes(F.forall(S.texts(v, f"$.{n}"), lambda i: span(i).id.isNotNull()))
    says = lambda i: S.yes(F.contains(span(i).text, subject))
    grounded = F.exists(F.concat(sources, contexts), says)
    naming = F.filter(spans, lambda s: F.contains(s.text, subject))
    first = F.array_min(F.transform(sources, lambda i: span(i).start))
    only = F.get(naming, 0)
    between = F.substring(story, only.stop, F.greatest(first - only.stop + 1, F.lit(0)))
    near = S.yes((F.size(naming) == 1) & (only.stop <= first) & ~between.rlike(SENTENCE_END))
    added = F.when(~grounded & near, F.array(only.id)).otherwise(_NONE())
    unfounded = F.when(~grounded & ~near, "grounding")
    own_kinds = S.yes(S.kind(v, "$.object").isNull() | S.kind(v, "$.object").isin("STRING", "VOID"))
    error = S.first_broken(
        [
            ("fields", S.has_keys(v, ("subject", "predicate", "type", "source_ids"), ("object", "context_ids", "time"))),
            *[(n, line(n)) for n in ("subject", "predicate", "type")],
            ("object", own_kinds & ~S.yes(S.text(v, "$.object").rlike("[\n\r]"))),
            ("type", S.one_of(v, "$.type", FACT_TYPES)),
            ("named subject", ~subject.isin(*FACT_PRONOUNS) & F.contains(story, subject)),
            ("source_ids", refs("source_ids", True)),
            ("context_ids", S.kind(v, "$.context_ids").isNull() | refs("context_ids", False)),
            *([] if defer_grounding else [("grounding", grounded | near)]),
            ("time", S.yes(S.kind(v, "$.time").isNull() | (S.kind(v, "$.time") == "VOID")) | (S.filled(said_time) & F.contains(story, said_time))),
        ]
    )
    last = F.array_max(F.transform(sources, lambda i: span(i).stop))
    all_contexts = by_place(F.concat(contexts, added))
    made = F.struct(
        subject.alias("subject"),
        S.text(v, "$.predicate").alias("predicate"),
        S.text(v, "$.type").alias("type"),
        F.when(obj.isNotNull(), S.text(v, "$.object")).alias("object"),
        F.substring(story, first + 1, last - first).alias("source_text"),
        by_place(sources).alias("source_ids"),
        all_contexts.alias("context_ids"),
        F.array_join(F.transform(all_contexts, lambda i: span(i).text), "\n").alias("context_text"),
        said_time.alias("time"),
    )
    ok = error.isNull()
    return F.struct(error.alias("error"), F.when(ok, unfounded).alias("grounding_error"), F.when(ok, made).alias("fact"))


def decoded_facts(v: Column, story: Column, spans: Column, defer_grounding: bool = False) -> Column:
    """struct(error, facts, rejected, duplicates, unselected, status) of a reply with up to 20 facts; ids F1.. follow its order."""
    made = F.transform(S.rows(v, "$.facts"), lambda x, i: F.struct((i + 1).alias("at"), fact(x, story, spans, defer_grounding).alias("r")))
    shape = S.has_keys(v, ("facts",)) & S.is_list(v, "$.facts") & (F.size(S.rows(v, "$.facts")) <= MOST_FACTS)

    def sorted_out(m: Column) -> Column:
        good = F.filter(m, lambda x: x.r.error.isNull())
        rejected = F.transform(F.filter(m, lambda x: x.r.error.isNotNull()), lambda x: F.struct(F.concat(F.lit("F"), x.at).alias("id"), x.r.error.alias("error")))
        return F.struct(good.alias("good"), F.transform(good, lambda x: x.r.fact).alias("kinds"), rejected.alias("rejected"))

    def told(x: Column) -> Column:
        first = lambda g, i: F.array_position(x.kinds, g.r.fact) == i + 1
        kept = F.filter(x.good, first)
        used = F.flatten(F.transform(kept, lambda g: F.concat(g.r.fact.source_ids, g.r.fact.context_ids)))
        error = S.first_broken([("facts", shape)])
        ok = error.isNull()
        return F.struct(
            error.alias("error"),
            F.when(ok, F.transform(kept, lambda g: F.struct(F.concat(F.lit("F"), g.at).alias("id"), g.r.grounding_error.alias("grounding_error"), g.r.fact.alias("fact")))).alias("facts"),
            F.when(ok, x.rejected).alias("rejected"),
            F.when(ok, F.transform(F.filter(x.good, lambda g, i: ~first(g, i)), lambda g: g.at)).alias("duplicates"),
            F.when(ok, F.array_except(F.transform(spans, lambda s: s.id), used)).alias("unselected"),
            F.when(ok, F.when(F.size(x.rejected) == 0, "ok").when(F.size(kept) > 0, "partial").otherwise("error")).alias("status"),
        )

    return S.let(S.let(made, sorted_out), told)


def output_budget(input_tokens: Column) -> Column:
    """Tokens that a reply may have; null, which is an error to the caller, if too few are left for one."""
    left = F.lit(BUDGET) - input_tokens
    return F.when(input_tokens.isNull(), MOST_OUTPUT).when(left >= LEAST_OUTPUT, F.least(F.lit(MOST_OUTPUT), left))


def event_schema() -> dict:
    """The JSON schema of a compact reply, for decoders that keep to one."""
    texts = {"type": "array", "items": {"type": "string", "minLength": 1}, "uniqueItems": True}
    some = {**texts, "minItems": 1}
    kinds = {
        "actors": some, "event": {"type": "string", "minLength": 1}, "source_ids": some, "modality": {"enum": list(MODALITIES)}, "check_reason": {"enum": list(CHECK_REASONS)},
        "explicit": {"type": "boolean"}, "mental_state": {"type": ["string", "null"]}, "conditions": texts, "context_ids": texts,
    }
    closed = lambda fields, needed: {"type": "object", "properties": fields, "required": list(needed), "additionalProperties": False}
    ignored = closed({"source_id": {"type": "string"}, "reason": {"enum": list(IGNORE_REASONS)}}, ("source_id", "reason"))
    return closed({"events": {"type": "array", "items": closed(kinds, NEEDED)}, "ignored_spans": {"type": "array", "items": ignored}, "non_event_span_ids": texts}, EXITS)
