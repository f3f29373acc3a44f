"""Scores: findings to documents to projects, contributions, facets, capped allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.core import SCORE_CAP, SEVERITY_RANK, by_severity, half_even_mean, money, points


def score_documents(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(project_id, document_id, counts by severity, score) for every document, also without findings.

    documents(project_id, document_id), findings(project_id, document_id or null, severity). The score is
    the sum of points, 100 at most. Findings are summed before they are joined.
    """
    per = findings.where("document_id is not null").groupBy("document_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_RANK], F.sum(points(F.col("severity"))).alias("points"))
    counts = [F.coalesce(F.col(f"n_{s}"), F.lit(0)).alias(f"n_{s}") for s in SEVERITY_RANK]
    return documents.join(per, "document_id", "left").select("project_id", "document_id", *counts, F.least(F.lit(SCORE_CAP), F.coalesce("points", F.lit(0))).cast("long").alias("score"))


def score_projects(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(project_id, n_documents, document_mean, package_points, score): mean of all document scores, half to even and 0 without a document, and the points of findings without a document, 100 at most."""
    docs = score_documents(documents, findings).groupBy("project_id").agg(F.count("*").alias("n_documents"), F.sum("score").alias("total"))
    package = findings.where("document_id is null").groupBy("project_id").agg(F.sum(points(F.col("severity"))).alias("package_points"))
    both = docs.join(package, "project_id", "full").fillna(0, ["n_documents", "total", "package_points"]).withColumn("package_points", F.col("package_points").cast("long"))
    both = both.withColumn("document_mean", F.coalesce(half_even_mean(F.col("total"), F.col("n_documents")), F.lit(0).cast("long")))
    return both.select("project_id", "n_documents", "document_mean", "package_points", F.least(F.lit(SCORE_CAP), F.col("document_mean") + F.col("package_points")).cast("long").alias("score"))


def sort_key(findings: DataFrame) -> list[Column]:
    """Total order of findings: project, document (none last), severity, type, id."""
    return [F.col("project_id"), F.coalesce(F.col("document_id").cast("string"), F.lit("~")), by_severity(F.col("severity"), SEVERITY_RANK), F.col("finding_type"), F.col("finding_id")]


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """(facet, value, n): counts of each value of each column, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the greatest on ties."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", value)).alias("m")).select(key, F.col(f"m.{value}").alias("dominant"), F.col("m.n").alias("n"))


def allocate(rows: DataFrame, key: str, order: str, weight: Column, total: Column) -> DataFrame:
    """rows with allocated: each key's total dealt in proportion to weight, in cents half up; the last row with a weight takes what is left.

    The windows span a key's rows: meant for keys with few, such as a score's parts.
    """
    cents = lambda c: (money(c) * 100).cast("long")  # noqa: E731  whole cents: no quotient is rounded twice
    w = rows.withColumn("_w", cents(weight)).withColumn("_t", cents(total))
    every = W.partitionBy(key)
    w = w.withColumn("_sum", F.sum("_w").over(every)).withColumn("_last", F.max(F.when(F.col("_w") > 0, F.col(order))).over(every))
    w = w.withColumn("_c", F.expr("if(_w > 0, (2 * _t * _w + _sum) div (2 * _sum), 0)"))
    w = w.withColumn("_others", F.sum(F.when(F.col(order) != F.col("_last"), F.col("_c")).otherwise(0)).over(every))
    out = F.when(F.col(order) == F.col("_last"), F.col("_t") - F.col("_others")).otherwise(F.col("_c"))
    return w.withColumn("allocated", (out.cast("decimal(18,0)") / 100).cast("decimal(18,2)")).drop("_w", "_t", "_sum", "_last", "_c", "_others")
