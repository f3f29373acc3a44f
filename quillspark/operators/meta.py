"""Combined review: features of the parts, capped part scores, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the output contract: points of a feature at its full value, and caps of the parts.
FEATURE_WEIGHTS = {
    "P1": {"p1_high_severity_findings": 10, "p1_medium_severity_rate": 12, "p1_low_severity_rate": 4, "p1_structural_anomaly_rate": 9, "p1_ocr_or_empty_page_rate": 4},
    "P2": {"p2_potential_conflicts": 16, "p2_insufficient_evidence": 4},
    "P3": {"p3_proven_conflicts": 18, "p3_unresolved_context_findings": 2},
    "P4": {"p4_proven_conflicts": 20, "p4_unresolved_identity_findings": 5, "p4_other_diagnostic_findings": 2},
}
PILLAR_CAPS = {"P1": 35, "P2": 15, "P3": 25, "P4": 25}
P2_SYNTHETIC_DISCOUNT, P2_SYNTHETIC_CAP = "0.35", "8"
COVERAGE_WEIGHTS = {"P1": "0.25", "P2": "0.25", "P3": "0.25", "P4": "0.25"}


def normalized(count: Column, divisor: Column) -> Column:
    """count / divisor between 0 and 1, six decimals; 0 without a divisor."""
    share = count.cast("decimal(18,0)").cast("double") / divisor
    return F.when(divisor > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).cast("decimal(18,9)"), 6)).otherwise(F.lit(0).cast("decimal(18,6)")).cast("decimal(12,6)")


def contribution(value: Column, weight: Column) -> Column:
    """Points of a normalized value, half up, two decimals."""
    return F.round(value.cast("decimal(12,6)") * weight.cast("decimal(8,2)"), 2).cast("decimal(12,2)")


def part_scores(features: DataFrame, authoritative: Column | None = None) -> DataFrame:
    """(project_id, part, raw, factor, cap, subtotal) from features(project_id, part, contribution, ...).

    raw is the sum of contributions. P2's is discounted, and its cap lowered, by the share of requirements
    that no authority stands behind; authoritative is that column of features (of a project's P2 rows the
    greatest counts; null is none). An unknown part has no cap and is left out.
    """
    ratio = F.coalesce(F.max(authoritative if authoritative is not None else F.lit(0)), F.lit(0)).cast("decimal(8,6)")
    sums = features.groupBy("project_id", "part").agg(F.sum("contribution").cast("decimal(18,2)").alias("raw"), ratio.alias("_ratio"))
    caps = F.lit(None).cast("decimal(8,2)")
    for part, most in PILLAR_CAPS.items():
        caps = F.when(F.col("part") == part, F.lit(most).cast("decimal(8,2)")).otherwise(caps)
    low, synthetic = F.lit(P2_SYNTHETIC_DISCOUNT).cast("decimal(4,2)"), F.lit(P2_SYNTHETIC_CAP).cast("decimal(8,2)")
    second = F.col("part") == "P2"
    factor = F.when(second, F.round(low + (1 - low) * F.col("_ratio"), 6)).otherwise(1).cast("decimal(8,6)")
    most = F.when(second, F.round(synthetic + (caps - synthetic) * F.col("_ratio"), 2)).otherwise(caps).cast("decimal(8,2)")
    found = sums.select("project_id", "part", "raw", factor.alias("factor"), most.alias("cap")).where("cap is not null")
    discounted = F.round(F.col("raw") * F.col("factor"), 2)
    return found.withColumn("subtotal", F.least(discounted, F.col("cap")).cast("decimal(18,2)"))


def total_scores(parts: DataFrame) -> DataFrame:
    """(project_id, score): the sum of part scores, 100 at most."""
    return parts.groupBy("project_id").agg(F.least(F.sum("subtotal"), F.lit(100)).cast("decimal(18,2)").alias("score"))


def top_factors(features: DataFrame, most: int = 5) -> DataFrame:
    """The `most` largest positive contributions of each project, then by part and feature; rank counts from 1."""
    place = W.partitionBy("project_id").orderBy(F.desc("contribution"), "part", "feature")
    return features.where("contribution > 0").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)


def coverage(parts: DataFrame) -> DataFrame:
    """(project_id, coverage): the weighted sum of each part's coverage, four decimals; a part that is missing covers nothing."""
    weight = F.lit("0").cast("decimal(6,4)")
    for part, share in COVERAGE_WEIGHTS.items():
        weight = F.when(F.col("part") == part, F.lit(share).cast("decimal(6,4)")).otherwise(weight)
    return parts.groupBy("project_id").agg(F.round(F.sum(F.col("coverage").cast("decimal(12,6)") * weight), 4).cast("decimal(12,4)").alias("coverage"))
