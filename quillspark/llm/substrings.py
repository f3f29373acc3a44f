"""Substring dedup over content-defined chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.chunking import Sizes, cuts, digests
from quillspark.llm.common import cut, hot_keys, join_hot, packed, small_batches, table, unpacked

SIZES = Sizes(8, 24, 144)
#: Characters, or words, of adjoining repeated chunks that make a repeated passage: under what a passage of 50 words keeps between the chunks cut by its edges, and over what common phrases and short lines have.
PASSAGE, PASSAGE_WORDS = 100, 20


def _places(raw: bytes, text: str, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each of (0, *ends): the code points, and the words begun, before that byte."""
    at, data = np.array([0, *ends], np.int64), np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begun = np.concatenate([[0], np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))])[at] if len(raw) else np.zeros(1, np.int64)
    if len(raw) != len(text):  # bytes to code points
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    return at, begun


def chunks(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """(doc_id, text_hash, digest, place) for each chunk of each text; place packs its start and length in code points and the words that begin in it."""
    if sizes.most > 250:
        raise ValueError("a chunk's length has to fit into 8 bits")
    small_batches(docs.sparkSession)

    @F.pandas_udf("digest array<long>, place array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            ends = cuts(raw, sizes)
            at, begun = _places(raw, text or "", ends)
            out.append((digests(raw, ends).view(np.int64), at[:-1] << 16 | np.diff(at) << 8 | np.diff(begun)))
        return pd.DataFrame(out, columns=["digest", "place"])

    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), of(F.col("text")).alias("c"))
    each = found.select("doc_id", "text_hash", F.explode(F.arrays_zip("c.digest", "c.place")).alias("c"))
    return each.select("doc_id", "text_hash", "c.digest", "c.place")


def repeated_spans(docs: DataFrame, sizes: Sizes = SIZES, passage: int = PASSAGE, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, text_hash, span_start, span_chars, n_words, n_chunks, first_doc_id): passages that stand earlier, in order of doc_id and place.

    A chunk's first occurrence is kept, all others are repeats; adjoining repeats of passage characters or
    passage_words words make a span. first_doc_id has the first occurrence of the span's first chunk. Counts are summed
    before the shuffle, so a passage that most documents hold is no hot group; only chunks that occur twice
    go on. Null and empty texts have no chunk. A document is a doc_id and a text (its XXH64, text_hash): rows that
    repeat both count once, and of those that share a doc_id each text is a document of its own. Rows with a
    null doc_id come last. No rows give no rows.
    """
    every = cut(chunks(docs, sizes))
    counts = cut(every.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(counts, "digest", every.count())
    again = cut(join_hot(every, counts.select("digest"), "digest", "left_semi", hot))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "place")
    firsts = cut(again.groupBy("digest").agg(F.min(place).alias("first")))
    later = join_hot(again, firsts, "digest", hot=hot).where(place != F.col("first"))
    order = W.partitionBy("doc_id", "text_hash").orderBy("start")
    later = later.selectExpr("doc_id", "text_hash", "place >> 16 as start", "place >> 8 & 255 as chars", "place & 255 as words", "first.doc_id as first")
    later = later.withColumn("before", F.lag("start").over(order)).where("before is null or before != start")  # rows that repeat a document
    later = later.withColumn("new", F.coalesce(F.lag(F.col("start") + F.col("chars")).over(order) != F.col("start"), F.lit(True)).cast("int"))
    later = later.withColumn("run", F.sum("new").over(order))
    spans = later.groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("span_start"), F.sum("chars").alias("span_chars"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"), F.min_by("first", "start").alias("first_doc_id"))
    return spans.where((F.col("span_chars") >= passage) | (F.col("n_words") >= passage_words)).drop("run")


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans cut from text. A document's spans don't overlap. A null text stays null."""
    per = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_chars"))).alias("_spans"))
    rest = "aggregate(_spans, named_struct('at', 1L, 'out', ''), (s, x) -> named_struct('at', x.span_start + 1 + x.span_chars, 'out', concat(s.out, substring(text, cast(s.at as int), cast(x.span_start + 1 - s.at as int)))), s -> concat(s.out, substring(text, cast(s.at as int))))"
    joined = packed(docs, "doc_id", "text").join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    return unpacked(joined.withColumn("text", F.expr(f"if(_spans is null or text is null, text, {rest})")), docs.columns, ("doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents (see repeated_spans)."""
    return repeated_spans(table(spark, sf_dir, "documents"))
