"""Scalar building blocks: content ids, ordinal severities, exact rounding, tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the output contract.
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}
SEVERITY_POINTS = {"high": 25, "medium": 12, "low": 5, "info": 2}
SCORE_CAP = 100
RELATIVE_TOLERANCE, ZERO_MULTIPLIER, APPROXIMATE_MULTIPLIER = "0.02", 10, 5
DEFAULT_ABSOLUTE_TOLERANCE = "0.0000005"
SEVERITY_GATES = {"high": "0.5", "medium": "0.1"}
LEVELS = (25, 50, 75)
COHERENCE_CONFIDENCE = {
    "conflicting_project_identity": "0.85", "conflicting_facility_identity": "0.8", "conflicting_location": "0.75", "conflicting_activity_or_category": "0.7",
    "conflicting_reporting_period": "0.8", "conflicting_operator": "0.85", "unresolved_entity_identity": "0.4", "insufficient_cross_document_context": "0.35",
    "orphan_document_reference": "0.5",
}
COHERENCE_PENALTIES = {"ocr_source": "0.15", "address_partial": "0.1", "single_document": "0.1"}
CONFIDENCE_ELSE, CONFIDENCE_RANGE = "0.5", ("0.05", "0.95")


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix, two underscores, 12 hex digits of the sha256 of the parts joined by |. A null part is empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}__"), F.substring(F.sha2(joined, 256), 1, 12))


def by_severity(severity: Column, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in values.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def points(severity: Column) -> Column:
    return by_severity(severity, SEVERITY_POINTS)


def cap_severity(severity: Column, most: str) -> Column:
    """The milder of the two."""
    return F.when(by_severity(severity, SEVERITY_RANK) < SEVERITY_RANK[most], most).otherwise(severity)


def half_even_mean(total: Column, count: Column) -> Column:
    """Mean of whole numbers, rounded half to even, in whole-number arithmetic. Null without a count."""
    rest = F.pmod(total, count)
    q, r2 = ((total - rest).cast("decimal(20,0)") / count.cast("decimal(20,0)")).cast("long"), rest * 2
    return F.when(count > 0, (q + ((r2 > count) | ((r2 == count) & (F.pmod(q, F.lit(2)) == 1))).cast("long")).cast("long"))


def money(value: Column) -> Column:
    """Two decimals, half up, of the decimal text of a value."""
    return F.round(value.cast("decimal(28,10)"), 2).cast("decimal(18,2)")


def level(score: Column) -> Column:
    low, middle, high = LEVELS
    return F.when(score >= high, "high").when(score >= middle, "elevated").when(score >= low, "moderate").otherwise("low")


def tolerance(a: Column, b: Column, quantum_a: Column, quantum_b: Column, approximate: Column | None = None, absolute: Column | None = None) -> Column:
    """struct(abs_diff, rel_diff, mismatch) of two decimals. Both zero never differ; with one zero rel_diff is null and the absolute bound is ten times as wide."""
    exact = "decimal(28,8)"
    a, b = a.cast(exact), b.cast(exact)
    diff = F.abs(a - b)
    rounding = (quantum_a.cast(exact) + quantum_b.cast(exact)) / 2
    absolute = (absolute if absolute is not None else F.lit(DEFAULT_ABSOLUTE_TOLERANCE)).cast(exact)
    larger = F.greatest(F.abs(a), F.abs(b))
    relative = F.when(F.coalesce(approximate, F.lit(False)), F.lit(RELATIVE_TOLERANCE).cast("decimal(6,4)") * APPROXIMATE_MULTIPLIER).otherwise(F.lit(RELATIVE_TOLERANCE).cast("decimal(6,4)")) if approximate is not None else F.lit(RELATIVE_TOLERANCE).cast("decimal(6,4)")
    both, one = (a == 0) & (b == 0), (a == 0) | (b == 0)
    # compared by a product, so that no quotient is rounded
    beyond = F.when(both, False).when(one, diff > F.greatest(absolute * ZERO_MULTIPLIER, rounding)).otherwise((diff > F.greatest(absolute, rounding)) & (diff > relative * larger))
    rel = F.when(~one, diff.cast("double") / larger.cast("double"))
    return F.struct(diff.alias("abs_diff"), rel.alias("rel_diff"), beyond.alias("mismatch"))


def conflict_severity(rel_diff: Column, immaterial: Column, confidence: Column) -> Column:
    raw = F.when(rel_diff.isNull(), "medium").when(rel_diff >= float(SEVERITY_GATES["high"]), "high").when(rel_diff >= float(SEVERITY_GATES["medium"]), "medium").otherwise("low")
    return F.when(immaterial | (confidence < 0.5), cap_severity(raw, "low")).otherwise(raw)


def tri_state(a: Column, b: Column) -> Column:
    """match, conflict or unknown; unknown never counts as match."""
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "match").otherwise("conflict")


def confidence(kind: Column, flags: Column, bases: dict[str, str] = COHERENCE_CONFIDENCE, penalties: dict[str, str] = COHERENCE_PENALTIES, extra: Column | None = None) -> Column:
    """decimal(4,2): the base of a kind of finding less the penalty of each flag that is there, each once, plus extra; within bounds. Null flags are none."""
    exact, value = "decimal(4,2)", F.lit(CONFIDENCE_ELSE).cast("decimal(4,2)")
    for name, base in bases.items():
        value = F.when(kind == name, F.lit(base).cast(exact)).otherwise(value)
    for flag, penalty in penalties.items():
        value = value - F.when(F.array_contains(flags, flag), F.lit(penalty).cast(exact)).otherwise(F.lit("0").cast(exact))
    value = value if extra is None else value + extra.cast(exact)
    low, high = (F.lit(x).cast(exact) for x in CONFIDENCE_RANGE)
    return F.least(high, F.greatest(low, value)).cast(exact)
