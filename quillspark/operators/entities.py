"""Entity resolution, duplicates, vector decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.core import content_id
from quillspark.operators.graph import components

HAMMING, TEMPERATURE, TOP_AFFINITY, MARGIN = 4, 50.0, 0.30, 0.05
#: Query vectors that go to every executor at once, about.
QUERIES = 4096
#: Cosines that a worker holds at once (4 MB), and links that it gathers before they go out.
CELLS, LINKS = 1 << 19, 1 << 16


def resolve_operators(claims: DataFrame) -> DataFrame:
    """(project_id, n_identifiers, n_names, status, entity_id) from claims(project_id, identifier, name, form, designer boolean).

    Names that a project ever sees as its designer are left out. Two identifiers conflict; one confirms;
    without one, a single (name, form) confirms by name and several stay unresolved. A project whose every claim is left out is absent.
    """
    vetoed = claims.where("designer").select("project_id", "name").distinct()
    kept = claims.where("not designer").join(vetoed, ["project_id", "name"], "left_anti")
    found = kept.groupBy("project_id").agg(F.count_distinct("identifier").alias("n_identifiers"), F.count_distinct("name", "form").alias("n_names"), F.min("identifier").alias("_id"), F.min("name").alias("_name"))
    every = claims.select("project_id").distinct().join(found, "project_id", "left").fillna(0, ["n_identifiers", "n_names"])
    status = (
        F.when(F.col("n_identifiers") >= 2, "conflicting_identifier").when(F.col("n_identifiers") == 1, "confirmed_by_identifier")
        .when(F.col("n_names") == 1, "confirmed_by_name").when(F.col("n_names") > 1, "unresolved_names").otherwise("absent")
    )
    named = F.when(status == "confirmed_by_identifier", content_id("org", F.col("_id"))).when(status == "confirmed_by_name", content_id("org", F.col("_name")))
    return every.select("project_id", "n_identifiers", "n_names", status.alias("status"), named.alias("entity_id"))


def identity_findings(operators: DataFrame) -> DataFrame:
    """The rows of operators(status, n_names, n_named, n_documents, more) that are findings, with finding_type, severity and rule_id; status and n_names as resolve_operators has them.

    n_named: documents with a claim that counts; n_documents: all of the project. Two identifiers weigh more under one name.
    What only one document could show is no finding, and a confirmed operator isn't either.
    """
    conflict = F.col("status") == "conflicting_identifier"
    unresolved = (F.col("status") == "unresolved_names") & (F.col("n_named") >= 2)
    absent = (F.col("status") == "absent") & (F.col("n_documents") >= 2)
    kind = F.when(conflict, "conflicting_operator").when(unresolved, "unresolved_entity_identity").when(absent, "insufficient_cross_document_context")
    severity = F.when(conflict & (F.col("n_names") == 1), "medium").when(conflict, "low").otherwise("info")
    rule = F.when(conflict, "P4-A-IDENTIFIER").when(unresolved, "P4-A-UNRESOLVED").when(absent, "P4-A-ABSENT")
    return operators.withColumns({"finding_type": kind, "severity": severity, "rule_id": rule}).where("finding_type is not null")


def period_findings(claims: DataFrame) -> DataFrame:
    """(project_id, periods, claim_ids, n_suppressed) for each project whose documents of one purpose state different periods, or that has claims to set aside.

    claims(project_id, document_id, claim_id, period, core boolean). Core claims conflict if two periods and two documents
    have them: periods is then the sorted list and claim_ids the least claim of each; otherwise both are null. Claims of
    other documents are never compared: n_suppressed counts them where there are core ones. A project has as many periods
    as there are pairs of years at most, so its lists are bounded. Null periods, and rows whose core is null, count for nothing.
    """
    sizes = claims.groupBy("project_id").agg(
        F.count_distinct(F.when(F.col("core"), F.col("document_id"))).alias("docs"), F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("others"))
    stated = claims.where("core and period is not null").groupBy("project_id", "period").agg(F.min("claim_id").alias("claim_id"))
    lists = stated.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("period", "claim_id"))).alias("each"))
    conflict = (F.size("each") >= 2) & (F.col("docs") >= 2)
    found = sizes.where("n_core > 0").join(lists, "project_id").select(
        "project_id", F.when(conflict, F.array_join("each.period", ", ")).alias("periods"), F.when(conflict, F.array_join(F.transform("each", lambda e: e["claim_id"].cast("string")), "|")).alias("claim_ids"), F.col("others").alias("n_suppressed"))
    return found.where("periods is not null or n_suppressed > 0")


def exact_groups(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """(digest, representative, n) of contents that more than one row has; the smallest key represents."""
    return rows.groupBy(F.sha2(content.cast("binary"), 256).alias("digest")).agg(F.min(key).alias("representative"), F.count("*").alias("n")).where("n > 1")


def near_clusters(hashes: DataFrame, distance: int = HAMMING) -> DataFrame:
    """(node, cluster) for rows(node long, h long) whose 64-bit hashes reach each other in steps of `distance` bits or fewer.

    Equal hashes are one. Of distance + 1 bands one is equal in two hashes that near, so bands join and the distance is verified.
    """
    firsts = hashes.groupBy("h").agg(F.min("node").alias("first"))
    width = -(-64 // (distance + 1))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(F.shiftleft("h", max(0, 64 - width * (k + 1))), 64 - (min(64, width * (k + 1)) - width * k)).alias("v")) for k in range(distance + 1)])
    banded = firsts.select("first", "h", F.explode(bands).alias("b")).select("first", "h", "b.band", "b.v")
    other = banded.select(F.col("first").alias("first2"), F.col("h").alias("h2"), "band", "v")
    edges = banded.join(other, ["band", "v"]).where(F.col("first") < F.col("first2")).where(F.bit_count(F.col("h").bitwiseXOR(F.col("h2"))) <= distance).selectExpr("first as a", "first2 as b").distinct()
    roots = components(edges)
    named = firsts.join(roots, firsts["first"] == roots["node"], "left").select("h", F.coalesce("root", "first").alias("cluster"))
    return hashes.join(named, "h").select("node", "cluster")


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda p, q: add(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _unit(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, np.inf)[:, None]


def _met(keys: np.ndarray, vectors: list, ids: np.ndarray, wanted: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (id, key, cosine) of the links of keys' vectors with the unit vectors wanted of ids, some CELLS + LINKS of them at a time at most."""
    step, held, n = max(1, CELLS // max(1, len(ids))), [], 0
    for at in range(0, len(keys), step):
        s = _unit(vectors[at : at + step]) @ wanted.T
        row, col = np.nonzero(s >= least)
        own = keys[at : at + step][row]
        keep = own != ids[col]
        held.append((ids[col][keep], own[keep], s[row, col][keep]))
        n += len(held[-1][0])
        if n >= LINKS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def cosine_links(queries: DataFrame, rows: DataFrame, key: str, vector: str, least: float, block: int = QUERIES) -> DataFrame:
    """(query_id, key, cosine) of `least` and more for each of queries against all rows; a vector isn't met with its own key.

    Queries go out in blocks of about `block` vectors, and some rows at a time meet a block in a matrix product of bounded size. Zero
    vectors and nulls have no link. Vectors have one length. No rows give no rows.
    """
    spark = rows.sparkSession
    queries = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    blocks = -(-queries.count() // block)
    schema = f"query_id long, {key} long, cosine double"

    def against(sent: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, wanted = sent.value
            for batch in batches:
                for found in _met(batch[key].to_numpy(), batch[vector].tolist(), ids, wanted, least):
                    yield pd.DataFrame(dict(zip(("query_id", key, "cosine"), found, strict=True)))

        return meet

    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k).select(key, vector).toArrow()
        if part.num_rows:
            sent = spark.sparkContext.broadcast((part[key].to_numpy(), _unit(part[vector].to_pylist())))
            out = out.unionByName(rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).mapInPandas(against(sent), schema))
    return out


def softmax(values: Column, temperature: float = TEMPERATURE) -> Column:
    """Stable softmax of an array of doubles."""
    raised = F.transform(values, lambda v: F.exp(temperature * (v - F.array_max(values))))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda s, v: s + v))


def decide(affinities: Column) -> Column:
    """Place of the best affinity if it is 0.30 or more and 0.05 or more above the next; else null."""
    ranked = F.sort_array(affinities, asc=False)
    best, second = F.get(ranked, F.lit(0)), F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))
    return F.when((best >= TOP_AFFINITY) & (best - second >= MARGIN), F.array_position(affinities, best) - 1)
