"""Lexical retrieval over an inverted index, with an ensured backstop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.lineage import cut
from quillspark.functions.text import tokens

TOP, LEAST = 5, 0.05
#: Postings up to which every executor gets the index, so that no term is hot; beyond, terms are shuffled.
INDEX_ROWS = 500_000
#: Queries of a task, about, where every executor has the index: what it holds at once is bounded.
QUERY_ROWS = 8192


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("c"))


def retrieve(queries: DataFrame, corpus: DataFrame, top: int = TOP, least: float = LEAST) -> DataFrame:
    """(query_id, requirement_id, score, rank): the `top` requirements of each query whose score is `least` or more.

    queries(query_id, text), corpus(requirement_id, text). score: sum over shared terms of
    (1 + ln count in query) (1 + ln count in requirement) idf, by the requirement's norm, to 6 decimals;
    idf = ln(1 + N / (1 + df)) + 1. Terms join terms, and only terms of the corpus are counted and looked up.
    Where every executor has the index, the one shuffle is that of the queries' texts: counts, sums and ranks stay in place.
    """
    tc = term_counts(corpus, "requirement_id", "text")
    n = corpus.select(F.count("*").alias("n_all"))
    df = tc.groupBy("term").agg(F.count("*").alias("df"))
    total = n.first()["n_all"]
    weights = tc.join(df, "term").withColumn("idf", F.ln(1 + F.lit(float(total)) / (1 + F.col("df"))) + 1).withColumn("w", (1 + F.ln("c")) * F.col("idf"))
    norms = weights.groupBy("requirement_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    index = cut(weights.select("term", "requirement_id", "w"))
    known = index.select("term").distinct()
    if index.count() <= INDEX_ROWS:
        index, known, norms = F.broadcast(index), F.broadcast(known), F.broadcast(norms)
        parts = max(queries.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // QUERY_ROWS))
        queries = queries.repartition(parts, "query_id")
    # outer, as Spark would else add a filter that makes all tokens once more; a null meets nothing
    terms = queries.select("query_id", F.explode_outer(tokens(F.col("text"))).alias("term")).join(known, "term", "left_semi")
    qc = terms.groupBy("query_id", "term").agg((1 + F.ln(F.count("*"))).alias("qw"))
    scored = qc.join(index, "term").groupBy("query_id", "requirement_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot")).join(norms, "requirement_id")
    scored = scored.select("query_id", "requirement_id", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "requirement_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def with_backstop(retrieved: DataFrame, ensured: DataFrame) -> DataFrame:
    """retrieved, and the ensured (query_id, requirement_id) that it lacks, with score 0 and no rank."""
    lacking = ensured.join(retrieved, ["query_id", "requirement_id"], "left_anti").select("query_id", "requirement_id")
    return retrieved.unionByName(lacking.withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(None).cast("int")))
