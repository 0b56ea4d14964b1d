"""Routing, validation and guarding of verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an answer may say.
VERDICTS = ("consistent", "contradiction", "uncertain")
RELATIONS = ("direct_support", "direct_conflict", "insufficient")
NON_ACTUAL = ("speech", "belief", "plan", "dream", "inferred")


def proven(a: Column, relation: str, coexist: bool | None) -> Column:
    """Whether an assessment proves a verdict; coexist None leaves joint truth open, as the older contract does."""
    ok = (a.same_subject & a.evidence_applicable & (a.relation == relation) & (F.size(F.coalesce(a.assumptions, F.array())) == 0))
    if coexist is not None:
        ok = ok & a.can_both_be_true.eqNullSafe(F.lit(coexist))
    return F.coalesce(ok, F.lit(False))


def guard(verdict: Column, assessment: Column, joint_truth: bool = True) -> Column:
    """struct(verdict, model_verdict, guard_reason): unproven verdicts become uncertain; without an assessment nothing changes."""
    conflict = proven(assessment, "direct_conflict", False if joint_truth else None)
    support = proven(assessment, "direct_support", True if joint_truth else None)
    reason = F.when(assessment.isNotNull() & (verdict == "contradiction") & ~conflict, "coexistence_not_ruled_out")
    reason = reason.when(assessment.isNotNull() & (verdict == "consistent") & ~support, "direct_support_not_proven")
    return F.struct(
        F.when(reason.isNotNull(), "uncertain").otherwise(verdict).alias("verdict"),
        F.when(reason.isNotNull(), verdict).alias("model_verdict"),
        reason.alias("guard_reason"),
    )


def route(modality: Column, importance: Column, evidence: Column) -> Column:
    """Which events reach the model: support-only, non-actual and unsupported ones are settled before."""
    return (
        F.when(importance == "support_only", "support_only")
        .when(modality.isin(*NON_ACTUAL), "non_actual")
        .when(F.size(F.coalesce(evidence, F.array())) == 0, "no_evidence")
        .otherwise("judge")
    )


def grounded(citations: Column, evidence: Column) -> Column:
    """Whether each citation (evidence_id L1.., quote) names its evidence once and quotes it verbatim."""
    number = F.transform(citations, lambda c: F.try_to_number(F.substring(c.evidence_id, 2, 9), F.lit("999999999")).cast("int"))
    quotes = F.forall(
        F.arrays_zip(citations.alias("c"), number.alias("n")),
        lambda z: F.coalesce(
            z.c.evidence_id.startswith("L") & (z.n >= 1) & (F.trim(z.c.quote) != "") & F.contains(F.try_element_at(evidence, F.greatest(z.n, F.lit(1))).text, z.c.quote), F.lit(False)
        ),
    )
    once = F.size(F.array_distinct(F.transform(citations, lambda c: c.evidence_id))) == F.size(citations)
    return quotes & once & (F.size(citations) <= F.size(evidence))


def answer_error(verdict: Column, reason: Column, assessment: Column, citations: Column, evidence: Column) -> Column:
    """Name of the first rule that an answer breaks; null for a valid one."""
    return (
        F.when(~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), "verdict")
        .when(F.coalesce(F.trim(reason), F.lit("")) == "", "reason")
        .when(assessment.isNull() | ~F.coalesce(assessment.relation.isin(*RELATIONS), F.lit(False)), "relation")
        .when(F.exists(F.coalesce(assessment.assumptions, F.array(F.lit(""))), lambda x: F.coalesce(F.trim(x), F.lit("")) == ""), "assumptions")
        .when((verdict != "uncertain") & (F.size(F.coalesce(citations, F.array())) == 0), "missing citation")
        .when(~F.coalesce(grounded(citations, evidence), F.lit(True)), "citation")
    )
