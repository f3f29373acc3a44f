"""Guarded comparisons: pairs in groups, bounds, totals, shares, suppression as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.core import tolerance, tri_state

GROUP_MOST, PER_REASON, PER_DOCUMENT = 10, 10, 2


def guarded_pairs(rows: DataFrame, keys: list[str], order: str, columns: list[str], most: int = GROUP_MOST) -> tuple[DataFrame, DataFrame]:
    """Pairs i < j within groups of at most `most` rows, and the larger groups as suppressed rows (keys, n, reason).

    Larger groups are found by a count that is summed before the shuffle and never meet the join, so no pair of theirs is made.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    small = rows.join(sizes.where(F.col("n") <= most).select(*keys), keys, "left_semi").select(*keys, order, *columns)
    left = small.withColumnsRenamed({c: f"{c}_a" for c in (order, *columns)})
    right = small.withColumnsRenamed({c: f"{c}_b" for c in (order, *columns)})
    pairs = left.join(right, keys).where(F.col(f"{order}_a") < F.col(f"{order}_b"))
    return pairs, sizes.where(F.col("n") > most).withColumn("reason", F.lit("group_too_large"))


def compare_pairs(pairs: DataFrame, value: str, quantum: Column) -> DataFrame:
    """pairs with the tolerance decision on value_a and value_b."""
    return pairs.withColumn("_t", tolerance(F.col(f"{value}_a"), F.col(f"{value}_b"), quantum, quantum)).select(*pairs.columns, "_t.abs_diff", "_t.rel_diff", "_t.mismatch")


def tri_states(pairs: DataFrame, dimensions: list[str]) -> DataFrame:
    """pairs with state_<dimension> and reasons: any conflict or unknown dimension suppresses the pair."""
    states = [tri_state(F.col(f"{d}_a"), F.col(f"{d}_b")).alias(f"state_{d}") for d in dimensions]
    out = pairs.select("*", *states)
    why = F.array(*[F.when(F.col(f"state_{d}") == "unknown", f"unknown_{d}").when(F.col(f"state_{d}") == "conflict", f"conflict_{d}") for d in dimensions])
    return out.withColumn("reasons", F.array_compact(why)).withColumn("suppressed", F.size("reasons") > 0)


def reconcile(stated: DataFrame, parts: DataFrame, key: str, total: str, part: str, quantum: str = "0.01") -> DataFrame:
    """(key, stated, computed, n_parts, abs_diff, mismatch): a stated total against the exact sum of at least two parts; beyond half a quantum and two hundredths of the larger it doesn't agree."""
    exact = "decimal(18,2)"
    sums = parts.groupBy(key).agg(F.sum(F.col(part).cast(exact)).alias("computed"), F.count("*").alias("n_parts")).where("n_parts >= 2")
    both = stated.select(key, F.col(total).cast(exact).alias("stated")).join(sums, key)
    decided = both.withColumn("_t", tolerance(F.col("stated"), F.col("computed"), F.lit(quantum), F.lit("0")))
    return decided.select(key, "stated", F.col("computed").cast(exact).alias("computed"), "n_parts", F.col("_t.abs_diff").cast(exact).alias("abs_diff"), F.col("_t.mismatch").alias("mismatch"))


def share_check(rows: DataFrame, key: str, quantity: str, share: Column, quantum: str = "1") -> DataFrame:
    """rows with the recomputed share of the key's sum, in percent, and flagged where it is over half a point and half a quantum away."""
    sums = rows.groupBy(key).agg(F.sum(F.col(quantity).cast("decimal(18,2)")).alias("_total"))
    both = rows.join(sums, key).where("_total > 0")
    computed = (F.col(quantity).cast("decimal(18,2)") * 100 / F.col("_total")).cast("decimal(24,6)")
    off = F.abs(computed - share.cast("decimal(24,6)"))
    return both.withColumn("computed_share", computed).withColumn("flagged", off > F.lit("0.5").cast("decimal(10,6)") + F.lit(quantum).cast("decimal(10,6)") / 2).drop("_total")


def beyond_bound(rows: DataFrame, actual: Column, bound: Column, quantum: str = "0.01") -> DataFrame:
    """rows with violation: actual above its bound by more than rounding and two hundredths of the bound."""
    over = actual.cast("decimal(24,6)") - bound.cast("decimal(24,6)")
    return rows.withColumn("excess", over).withColumn("violation", (over > F.lit(quantum).cast("decimal(10,6)")) & (over > F.lit("0.02").cast("decimal(6,4)") * bound.cast("decimal(24,6)")))


def sample_suppressed(rows: DataFrame, reason: str, document: str, order: str, per_document: int = PER_DOCUMENT, per_reason: int = PER_REASON) -> DataFrame:
    """The report's samples: the first per_document rows of each reason and document, of those the first per_reason of each reason.

    The first cut is made from per-document minima, so a frequent reason is small before it meets its window.
    """
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(reason, document).orderBy(order))).where(F.col("_k") <= per_document)
    return first.withColumn("_n", F.row_number().over(W.partitionBy(reason).orderBy(order))).where(F.col("_n") <= per_reason).drop("_k", "_n")
