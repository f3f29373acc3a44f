"""Near copies by the share of word shingles: bands of minima find candidates, exact sets decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, join_hot, settle, small_batches, spread
from quillspark.llm.simhash import keep_one
from quillspark.operators.graph import components

#: Words of a shingle; near copies share 4 of 5 shingles (Jaccard).
WIDTH, SHARED, OF = 5, 4, 5
#: Candidates agree in all minima of a band: a pair at similarity 0.8 is missed with probability (1 - 0.8 ** 4) ** 24, 3 in a million.
BANDS, MINIMA = 24, 4
#: Hashes that meet the minima at a time, which bounds a worker's memory on a very long text.
BLOCK = 1 << 12
#: Pairs for each row of the bands up to which all are compared; beyond, groups are merged around one member first.
PAIRS = 8

_RNG = np.random.default_rng(17)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 64, (BANDS * MINIMA, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's shingles; a text of fewer words is one shingle, null and blank have none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    shingles = zip(*(found[k:] for k in range(width)), strict=False) if len(found) >= width else [found]
    raw = b"".join([xxhash.xxh64_digest(b" ".join(x), 42) for x in shingles])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def set_id(hashes: np.ndarray) -> int:
    """64 bits that name a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64)) if len(hashes) else 0


def bands(hashes: np.ndarray) -> list[int]:
    """A hash for each band of minima; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[None, at : at + BLOCK] * _TIMES + _PLUS).min(axis=1))
    found = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, MINIMA))]
    return np.array(found, np.uint64).view(np.int64).tolist()


def _banded(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, n, bands) for each row: the set's name, its size and its bands."""

    @F.pandas_udf("fp long, n int, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame([(set_id(s), len(s), bands(s)) for s in sets], columns=["fp", "n", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), of(F.col("text")).alias("s")).select("doc_id", "text_hash", "s.fp", "s.n", "s.bands")


def _sets(docs: DataFrame) -> DataFrame:
    """(fp, hashes) for each distinct set of the rows."""

    @F.pandas_udf("fp long, hashes array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame([(set_id(s), s.view(np.int64)) for s in sets], columns=["fp", "hashes"])

    return docs.select(of(F.col("text")).alias("s")).select("s.fp", "s.hashes").dropDuplicates(["fp"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b, class_a, class_b) of set names whose sets have a similarity of 0.8 and more, exactly."""
    both = spread(pairs).join(sets.toDF("a", "_a"), "a").join(sets.toDF("b", "_b"), "b")
    return both.where(f"size(array_intersect(_a, _b)) * {SHARED + OF} >= {SHARED} * (size(_a) + size(_b))").select(*pairs.columns)


def _leaders(rows: DataFrame, key: str) -> DataFrame:
    """(key, m, same, top) for the values of key in rows(key, class) that several classes have: rows, the sum of the classes' squares, the largest class if it has several rows."""
    held = rows.groupBy(key, "class").agg(F.count("*").alias("m"))
    top = F.max_by(F.expr("if(m > 1, class, null)"), F.struct("m", "class"))
    return held.groupBy(key).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"), top.alias("top"), F.count("*").alias("classes")).where("classes > 1").drop("classes")


def _by_prefix(live: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b, class_a, class_b) of different classes in live(fp, n, class) that can have a similarity of 0.8 and more.

    Prefix and position filters (Xiao et al., 2008), which lose no pair: with each set's shingles in one order, the
    rarest in live first, the first one in common is among the first fifth of the larger set and the first ninth of the
    smaller, and enough must be left behind it in both. A shingle's largest class isn't compared with itself.
    """
    own = live.select("fp", "n", "class").distinct()
    each = cut(own.join(sets, "fp").select("fp", "n", "class", F.explode("hashes").alias("h")))
    often = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = spread(each).join(often, "h").groupBy("fp", "n", "class").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
    # shingles that no other set has come first and meet nothing
    front = ranked.select("fp", "n", "class", F.expr("n - size(order)").alias("alone"), F.posexplode("order").alias("k", "o")).selectExpr("o.h as h", "fp", "n", "class", "alone + k as at").where("5 * at <= n")
    front = cut(front)
    front = cut(spread(front).join(_leaders(front, "h").select("h", "top"), "h").selectExpr("h", "fp", "n", "class", "at", "coalesce(class = top, false) as main"))
    other = front.selectExpr("h", "fp as b", "n as n_b", "class as class_b", "at as at_b", "main as main_b")
    small = "if(n < n_b or (n = n_b and fp < b), 9 * at <= n, 9 * at_b <= n_b)"
    return spread(front.where("not main")).join(other, "h").where(f"class != class_b and (main_b or fp > b) and {small} and {SHARED + OF} * least(n - at, n_b - at_b) >= {SHARED} * (n + n_b)").select("fp", "class", "b", "class_b")


def links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of set names that connect all candidates of similarity 0.8 and more.

    rows(key, fp, n): the bands that two sets at least have. Where a key's sets make more than PAIRS pairs a
    row, each is compared with the key's member whose keys have the most rows, the likely original, in later
    rounds with one outside the key's largest class; what is similar becomes one class. Pairs within a class
    need no comparison, as they change no component. When rounds merge little, what is left is compared by
    shared rare shingles: no group is capped.
    """
    edges, few = None, False
    live = cut(rows.withColumn("class", F.col("fp")))
    while True:
        sizes = cut(_leaders(live, "key"))
        state = sizes.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("same")) / 2)).first()
        if not state[0]:
            break
        live = cut(spread(live).join(sizes, "key"))
        crowded = state[1] > PAIRS * state[0]
        last = few or not crowded
        if crowded and few:
            met = _by_prefix(live, sets)
        else:
            if crowded:
                fame = live.groupBy("fp").agg(F.sum("m").alias("fame"))
                best = F.max_by(F.struct("fp", "n", "class"), F.struct(F.expr("not coalesce(class = top, false)"), "fame", "fp"))
                other = spread(live).join(fame, "fp").groupBy("key").agg(best.alias("o")).selectExpr("key", "o.fp as b", "o.n as n_b", "o.class as class_b")
            else:
                other = live.selectExpr("key", "fp as b", "n as n_b", "class as class_b")
            met = spread(live).join(other, "key").where(f"class != class_b and {'true' if crowded else 'fp > b'} and {OF} * least(n, n_b) >= {SHARED} * greatest(n, n_b)").select("fp", "class", "b", "class_b")
        pairs = cut(met.selectExpr("greatest(fp, b) as a", "least(fp, b) as b", "greatest(class, class_b) as class_a", "least(class, class_b) as class_b").distinct())
        found = cut(_similar(pairs, sets))
        edges = found.select("a", "b") if edges is None else edges.unionByName(found.select("a", "b"))
        if last:
            break
        before = live.select("class").distinct().count()
        roots = components(found.selectExpr("class_a as a", "class_b as b"))
        live = cut(live.join(roots, live["class"] == roots.node, "left").selectExpr("key", "fp", "n", "coalesce(root, class) as class"))
        few = roots.where("node != root").count() < 0.1 * before
    return sets.sparkSession.createDataFrame([], "a long, b long") if edges is None else edges


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class, component_id) for each row of docs with a doc_id: the smallest doc_id that links of similarity 0.8 and more reach.

    Null and blank texts link to each other. Texts are read twice and only those that share a band go on.
    """
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    own = cut(_banded(docs))
    firsts = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.any_value("bands").alias("bands")))

    def linked() -> DataFrame:
        keys = firsts.select("fp", "n", "first", F.explode("bands").alias("key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
        rows = cut(spread(keys).join(shared, "key", "left_semi"))
        ids = rows.select(F.col("first").alias("doc_id")).distinct()
        sets = cut(_sets(docs.join(ids, "doc_id", "left_semi")))
        return components(links(rows.select("key", "fp", "n"), sets))

    roots = settle(docs.sparkSession, linked)
    classed = firsts.select("fp", "first").join(roots, firsts.fp == roots.node, "left").selectExpr("fp", "first", "coalesce(root, fp) as class")
    lowest = classed.groupBy("class").agg(F.min("first").alias("component_id"))
    found = join_hot(classed, lowest, "class").select("fp", "class", "component_id")
    return join_hot(own.select("doc_id", "text_hash", "fp"), cut(found), "fp").select("doc_id", "text_hash", "class", "component_id")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs without near copies of similarity 0.8 and more: see keep_one for what stays of each component. No rows give no rows."""
    return keep_one(docs, near_copies(docs))
