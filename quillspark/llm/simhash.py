"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, join_hot, packed, settle, small_batches, spread, table, unpacked
from quillspark.operators.graph import components

#: Pairs of a probe and a fingerprint that a segment's value may make; beyond, the other half's segments must meet as well.
CROWD = 1 << 16
#: Shingles hashed at a time, which bounds a worker's memory on a very long text.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half the XXH64 (seed 42) of the text's shingles. Null or no word: 0."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and exactly the six separators
    if not found:
        return 0
    digest, join, set_bits, n = xxhash.xxh64_digest, b" ".join, np.zeros(64, np.int64), max(1, len(found) - width + 1)
    for at in range(0, n, BLOCK):
        part = found[at : at + BLOCK + width - 1] if n > 1 else found
        shingles = zip(*(part[k:] for k in range(width)), strict=False) if len(part) >= width else [part]
        raw = b"".join([digest(join(x), 42) for x in shingles])
        set_bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash long, fp long) for each row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), of(F.col("text")).alias("fp"))


def _flips(bits: int) -> str:
    """SQL for the masks of a Hamming ball of radius 1."""
    return f"concat(array(0L), transform(sequence(0, {bits - 1}), k -> shiftleft(1L, k)))"


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all fingerprints at 3 or fewer differing bits.

    fps: one distinct long column fp. Two 32-bit segments: at distance 3 one of them differs in at most
    one bit, so the ball of radius 1 around each segment (33 values) finds it in the table of segments;
    the whole distance is then verified. Before that, fingerprints whose balls of radius 1 meet (distance
    at most 2) are merged, and segment values whose fingerprints are all of one merged class are dropped:
    a dense group of near copies costs rows in proportion to its size and not its square. Links inside a
    merged class are not repeated, as they change no component.
    """
    if distance != 3:
        raise ValueError("the segment table is laid out for 3 bits")
    near = fps.select("fp", F.explode(F.expr(_flips(64))).alias("m")).selectExpr("fp", "fp ^ m as point")
    stars = near.groupBy("point").agg(F.max("fp").alias("a"), F.min("fp").alias("b")).where("a != b").select("a", "b").distinct()
    merged = components(stars)
    classed = cut(fps.join(merged, fps.fp == merged.node, "left").selectExpr("fp", "coalesce(root, fp) as class"))
    segments = classed.selectExpr("fp", "class", "explode(array(named_struct('s', 0L, 'v', fp & 4294967295L), named_struct('s', 4294967296L, 'v', shiftrightunsigned(fp, 32)))) as seg")
    probes = segments.select("fp", "class", "seg", F.explode(F.expr(_flips(32))).alias("m")).selectExpr("fp", "class", "seg.s + (seg.v ^ m) as key", "m = 0 as home")
    met = probes.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n"), F.count_if("home").alias("homes")).where("lo != hi and homes > 0")
    live = cut(spread(probes).join(met.select("key", (F.col("n") * F.col("homes") > CROWD).alias("crowded")), "key"))
    few, many = live.where("not crowded"), live.where("crowded")
    pairs = spread(few).join(few.where("home").selectExpr("key", "fp as b", "class as class_b"), "key").select("fp", "class", "b", "class_b")
    # the other half differs in 3 bits at most, so one of its two segments in one at most
    halves = "if(key < 4294967296L, shiftrightunsigned(fp, 32), fp & 4294967295L) as other"
    finer = many.selectExpr("key", "fp", "class", "home", halves).selectExpr("key", "fp", "class", "home", "explode(array(named_struct('s', 0L, 'v', other & 65535L), named_struct('s', 65536L, 'v', shiftrightunsigned(other, 16)))) as seg")
    sought = finer.select("key", "fp", "class", "seg", F.explode(F.expr(_flips(16))).alias("m")).selectExpr("key", "seg.s + (seg.v ^ m) as sub", "fp", "class")
    pairs = pairs.unionByName(spread(sought).join(finer.where("home").selectExpr("key", "seg.s + seg.v as sub", "fp as b", "class as class_b"), ["key", "sub"]).select("fp", "class", "b", "class_b"))
    far = pairs.where(f"class != class_b and bit_count(fp ^ b) <= {distance}").selectExpr("greatest(fp, b) as a", "least(fp, b) as b")
    return far.unionByName(merged.where("node != root").selectExpr("node as a", "root as b")).distinct()


def _classed(docs: DataFrame, width: int, distance: int) -> DataFrame:
    """(doc_id, fp, text_hash, class, component_id) for each row of docs."""
    own = cut(fingerprints(docs, width))
    firsts = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = settle(docs.sparkSession, lambda: components(links(firsts.select("fp"), distance)))
    classed = firsts.join(roots, firsts.fp == roots.node, "left").selectExpr("fp", "first", "coalesce(root, fp) as class")
    lowest = classed.groupBy("class").agg(F.min("first").alias("component_id"))
    found = join_hot(classed, lowest, "class").select("fp", "class", "component_id")
    return join_hot(own, cut(found), "fp")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id long, text string; more is ignored).

    Null and blank texts have fingerprint zero and link to each other. Repeated rows come back as often as
    they are there. A null doc_id is never a component's smallest; a component of none but null ids has a
    null component_id. No rows give no rows.
    """
    return _classed(docs, width, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """docs with one row of each class of classed(doc_id, text_hash, class, component_id), which has a row for each row of docs.

    Of the rows with the component's smallest doc_id the one whose text has the least hash stays; of rows
    that repeat that doc_id and text, one. Rows with a null doc_id stay, as nothing names them.
    """
    best = classed.where("doc_id = component_id").groupBy("doc_id", "class").agg(F.min("text_hash").alias("_hash")).select(F.col("doc_id").alias("_id"), "_hash").distinct()
    needed = ("doc_id", "text")
    rows = packed(docs, *needed).withColumn("_h", F.xxhash64("text"))
    named = rows.where("doc_id is not null").join(best, (F.col("doc_id") == F.col("_id")) & (F.col("_h") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "_h"])
    return unpacked(named.unionByName(rows.where("doc_id is null")), docs.columns, needed)


def keep_first(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs without near copies by fingerprints of `width`-word shingles: see keep_one for what stays of each component. No rows give no rows."""
    return keep_one(docs, _classed(docs, width, 3))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
