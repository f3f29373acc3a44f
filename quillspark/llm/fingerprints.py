"""Document fingerprints: sets of content-defined chunks, compared by weighted containment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.chunking import Sizes, cuts, digests
from quillspark.llm.common import small_batches, table

SIZES = Sizes(24, 48, 144)
#: Rows that lie between two cuts of the order, about, and the most cuts: what the driver holds of the order has a bound, and a larger part only streams longer.
ROWS, PARTS = 20_000, 8192


def chunk_set(text: str | None, sizes: Sizes = SIZES) -> np.ndarray:
    """Sorted distinct chunks, each 48 bits of digest and 16 bits of length in bytes. Null and empty texts have none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    ends = cuts(raw, sizes)
    length = np.diff(np.array([0, *ends], np.int64)).astype(np.uint64)
    return np.unique(digests(raw, ends) >> np.uint64(16) << np.uint64(16) | length)


def spelled(chunks: np.ndarray) -> str:
    """The fingerprint as a string: 16 hex digits a chunk."""
    return chunks.astype(">u8").tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a, in bytes of distinct chunks, that b has too. Two empty sets: 1; an empty one and another: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    weight = np.uint64(0xFFFF)
    return float((both & weight).sum() / (a & weight).sum())


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order; each is held until the next one comes. A part ends with the first row of the next part, which is compared with and not returned."""
    held = None
    for batch in batches:
        out = []
        for part, doc_id, text, guest in zip(batch["_part"], batch["_name"], batch["text"], batch["_guest"], strict=True):
            text = text or ""
            own = chunk_set(text)
            if held is not None and held[0] == part:
                _, that_id, that, that_own = held
                keep = len(that) - len(that) // 2
                edited = that[:keep] + text[: len(that) // 2]
                edited_own = chunk_set(edited)
                out.append((that_id, len(that), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), spelled(that_own), spelled(edited_own), containment(that_own, edited_own), containment(that_own, own)))
            held = None if guest else (part, doc_id, text, own)
        yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def neighbours(docs: DataFrame) -> DataFrame:
    """Each row of docs against its edited text and against the next document, ascending doc_id.

    The order is cut into parts at quantiles of doc_id. Each part also gets the first row of the next part
    as a guest (the last gets the very first), so every row meets its neighbour in one task, texts are shuffled once,
    and a task holds two texts at a time.

    Null and empty texts are empty: their fingerprint has no chunk and is like that of another empty text
    only. Null ids come first. Rows that repeat an id are ordered by text, each the neighbour of the one
    before. A single document is its own neighbour. No rows give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = docs.agg(F.count("*").alias("n")).first()["n"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(PARTS, ids // ROWS + 1))
    steps = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)}) if n > 1 else []
    bounds = "array({})".format(", ".join(f"{b}L" for b in steps))
    found = F.expr(  # how many bounds are at or below doc_id, by halving
        f"aggregate(sequence(1, {max(1, len(steps)).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(steps)}), (s, k) -> "
        f"if(s.lo >= s.hi, s, if(get({bounds}, cast((s.lo + s.hi) div 2 as int)) <= doc_id, named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)"
    )
    rows = docs.select("doc_id", "text").withColumn("_part", F.when(F.col("doc_id").isNull() | F.lit(not steps), 0).otherwise(found) if steps else F.lit(0))
    firsts = rows.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("f")).select("_part", "f.id").collect()  # one row a part
    parts = sorted((r["_part"], r["id"]) for r in firsts)
    turn = [(parts[k][1], parts[k - 1][0]) for k in range(len(parts))]
    guests = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(turn, "_id long, _part int")), F.col("doc_id").eqNullSafe(F.col("_id")))
    guests = guests.groupBy("_part", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    both = rows.withColumn("_guest", F.lit(False)).unionByName(guests.select("doc_id", "text", "_part").withColumn("_guest", F.lit(True)))
    dealt = both.repartition(n, "_part").sortWithinPartitions("_part", "_guest", "doc_id", "text")
    named = dealt.select("_part", F.col("doc_id").cast("string").alias("_name"), "text", "_guest")  # as text: pandas would make floats of longs with nulls
    out = named.mapInPandas(_compare, "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its edited text and the next document (see neighbours)."""
    return neighbours(table(spark, sf_dir, "documents"))
