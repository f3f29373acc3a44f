"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mix, encoding.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and further columns
with any name; all but the last return the columns that they get. See the operators for what each case gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, settle
from quillspark.llm.lines import strip_lines
from quillspark.llm.mixing import apply_mix
from quillspark.llm.pieces import encode
from quillspark.llm.rules import keep_good
from quillspark.llm.shingles import WIDTH, keep_distinct
from quillspark.llm.simhash import keep_first


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without the boilerplate lines of their source; n_chars follows the text."""
    return strip_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies on five-word shingles: the one with the smallest doc_id.

    Fingerprints at 3 or fewer differing bits first; of what is left, texts whose shingles are similar at 0.8 and more,
    which 64 bits can't tell (such texts differ in 10 bits in the mean).
    """
    return keep_distinct(settle(spark, lambda: keep_first(docs, WIDTH)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of each row."""
    return encode(docs, None, "doc_id", "lang", "source").select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("tokens", tokens)]

#: The mix's Newton iterations and the tokenizer have no SQL: tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
