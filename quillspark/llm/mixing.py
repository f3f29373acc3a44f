"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import cut, packed, quoted, table, unpacked, words

#: Weights of the sources in code point order, repeating; the mix's share of all words; the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of one source and size that are ranked together at most, about, as long as CELLS cells of them do.
CELL, CELLS = 4096, 65536
#: Newton has to come this near to a target, in so many rounds (a step that leaves its bracket halves it, so some dozens do).
NEAR, ROUNDS = 1e-7, 200


def _name(source: Column) -> Column:
    """A source as a key without nulls; "n" is the null source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(src, source_size, n, target) for each source of sizes(src, size).

    A source's target is its weight times one level, or most times its size where that is less; the level
    makes the targets add up to share of all words, which is what resharing the excess by weight ends in. Sources are
    ranked within ranges, and the level is found by sums over them, so there may be as many as there are hosts.
    """
    if share > most:
        raise ValueError("no mix can take more than the most copies of everything")
    total = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = [(F.col("src") == "n"), F.col("src")]
    place = W.partitionBy("part").orderBy(*order)
    dealt = cut(total.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.row_number().over(place) - 1))
    before, starts = 0, []
    for r in dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("source_size").alias("size")).orderBy("part").collect():  # a row a partition
        starts.append((r["part"], before))
        before += r["n"]
    start = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("part")] if starts else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("nth") + start) % len(weights) + 1).cast("int"))
    s = cut(dealt.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most)))
    open_ = s.agg(F.sum("w").alias("w"), F.sum("source_size").alias("size")).first()
    wanted = (open_["size"] or 0) * share
    level, capped = wanted / (open_["w"] or 1), -1
    while True:  # each round caps sources for good
        r = s.agg(F.count_if(F.col("cap") < F.col("w") * level).alias("n"), F.sum(F.when(F.col("cap") < F.col("w") * level, F.col("cap"))).alias("cap"), F.sum(F.when(F.col("cap") >= F.col("w") * level, F.col("w"))).alias("w")).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (wanted - (r["cap"] or 0.0)) / r["w"]
    return s.select("src", "source_size", "n", F.least("cap", F.col("w") * level).alias("target"))


def tilts(histogram: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """(src, lam, mean): a document of size s has rate min(most, exp(lam * s / mean)).

    These rates have the least relative entropy to a rate of one for each document, under the source's word
    total and the bound. lam is the root of the dual's gradient; all sources take a Newton step on its
    logarithm at once, each round one aggregation of the histogram (src, size, n) with partial sums, and a step that leaves
    the bracket found so far halves it. A target of most times the source has lam infinite. The sums are of
    decimals, so their order doesn't matter and reruns agree.
    """
    state = wanted.where("source_size > 0").selectExpr(
        "src", "target", "source_size / n as mean", f"if(target >= source_size * {most} * (1 - 1e-9), double('infinity'), 0.0d) as lam",
        "double('-infinity') as lo", "double('infinity') as hi", f"target >= source_size * {most} * (1 - 1e-9) as done")
    state = cut(state)
    for turn in range(ROUNDS + 1):
        if state.where("not done").isEmpty():
            break
        if turn == ROUNDS:
            raise ArithmeticError(f"a source is still off its target after {ROUNDS} rounds")
        open_ = state.where("not done")
        x, e = "size / mean", "exp(least(700.0d, lam * size / mean))"
        sums = histogram.join(open_.select("src", "lam", "mean"), "src").groupBy("src").agg(
            F.sum(F.expr(f"cast(n * size * least({most}, {e}) as decimal(38, 9))")).cast("double").alias("f"), F.sum(F.expr(f"if({e} < {most}, cast(n * size * {x} * {e} as decimal(38, 9)), 0)")).cast("double").alias("g"))
        step = open_.join(sums, "src").selectExpr("*", "if(f < target, lam, lo) as lo2", "if(f < target, hi, lam) as hi2", "if(g > 0 and f > 0, lam - ln(f / target) * f / g, null) as newton")
        middle = "case when lo2 = double('-infinity') then least(hi2 * 2, hi2 - 1) when hi2 = double('infinity') then greatest(lo2 * 2, lo2 + 1) else (lo2 + hi2) / 2 end"
        step = step.selectExpr(
            "src", "target", "mean", f"abs(f - target) <= {NEAR} * target as near", "lo2", "hi2", "lam as at",
            f"if(newton > lo2 and newton < hi2 and abs(newton - lam) <= greatest(16, 4 * abs(lam)), newton, {middle}) as lam")
        moved = step.selectExpr("src", "target", "mean", "if(near, at, lam) as lam", "lo2 as lo", "hi2 as hi", "near as done")
        state = cut(state.where("done").unionByName(moved))
    return state.select("src", "lam", "mean")


def _fold(sizes: pd.DataFrame) -> pd.DataFrame:
    """Copies for each size of a source, from the largest down; what rounding leaves is carried in words, so that the source's sum ends within about half its smallest document of the target."""
    sizes = sizes.sort_values("size", ascending=False)
    carry, copies = 0.0, []
    for size, n, rate in zip(sizes["size"], sizes["all_n"], sizes["rate"], strict=True):
        want = n * rate * size + carry
        got = max(0, min(MOST * n, round(want / size)))
        carry = want - got * size
        copies.append(got)
    return sizes.assign(all_taken=pd.Series(copies, index=sizes.index, dtype="int64"))[["src", "size", "all_n", "rate", "salts", "all_taken"]]


def mix(docs: DataFrame, source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(doc_id, src, size, source_size, target, rate, copies, taken) for each row of docs.

    size: words of the text, none for null. A document without words gets one copy. Null sources are one
    source, last in order. Repeated rows are rows of their own; which of them gets a copy more doesn't
    matter. Reruns agree: the choice hangs on doc_id and text alone. No rows give no rows.

    Sources of any size are spread: sums are taken over a histogram of sizes, copies are dealt to the sizes of a
    source in one task (as many as its longest text has words, at most), then to salted cells of about CELL
    documents each, and ranked within them.
    """
    return _mixed(docs, source, weights, share).drop("pick")


def _mixed(docs: DataFrame, source: str, weights: tuple[float, ...], share: float) -> DataFrame:
    """What mix() returns, and pick, which parts documents of one source and size."""
    sizes = cut(docs.select("doc_id", _name(F.col(quoted(source))).alias("src"), F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("pick")))
    histogram = cut(sizes.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("n")))
    wanted = cut(targets(sizes, weights, share))
    tilt = tilts(histogram, wanted)
    rates = histogram.join(tilt, "src").selectExpr("src", "size", "n as all_n", f"least({float(MOST)}, exp(least(700.0d, lam * size / mean))) as rate", f"cast(least(ceil(n / {CELL}), {CELLS}) as int) as salts")
    folded = cut(rates.groupBy("src").applyInPandas(_fold, "src string, size long, all_n long, rate double, salts int, all_taken long"))
    # joined from the histogram: one row for each source and size
    dealt = cut(sizes.join(folded, ["src", "size"], "left").withColumn("salt", F.expr("cast(pmod(pick, salts) as int)")))
    cells = dealt.where("size > 0").groupBy("src", "size", "salt").agg(F.count("*").alias("n"), F.max("all_n").alias("all_n"), F.max("all_taken").alias("all_taken"))
    upto = W.partitionBy("src", "size").orderBy("salt")
    cells = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("part", F.expr("cast(cast(all_taken as decimal(19, 0)) * upto div all_n as long)"))
    cells = cells.withColumn("taken", F.col("part") - F.coalesce(F.lag("part").over(upto), F.lit(0))).select("src", "size", "salt", "n", "taken")
    ranked = dealt.where("size > 0").withColumn("rank", F.row_number().over(W.partitionBy("src", "size", "salt").orderBy("pick", "doc_id")))
    ranked = ranked.join(cells, ["src", "size", "salt"]).withColumn("copies", F.expr("cast(taken div n + if(rank <= taken % n, 1, 0) as int)"))
    blank = dealt.where("size = 0").withColumn("copies", F.lit(1)).withColumn("rate", F.lit(1.0))
    columns = ["doc_id", "src", "size", "pick", "rate", "copies"]
    out = ranked.select(columns).unionByName(blank.select(columns)).join(wanted.drop("n"), "src")
    return out.selectExpr("doc_id", "src", "size", "pick", "source_size", "target", "rate", "copies", "copies * size as taken")


def apply_mix(docs: DataFrame, source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, once or twice). See mix() for nulls and repeats; other columns pass through."""
    same = lambda prefix: W.partitionBy(f"{prefix}src", f"{prefix}size", f"{prefix}pick").orderBy(f"{prefix}size")  # noqa: E731  rows that repeat one document
    plan = _mixed(docs, source, WEIGHTS, SHARE).selectExpr("src as _m_src", "size as _m_size", "pick as _m_pick", "copies as _m_copies").withColumn("_m_nth", F.row_number().over(same("_m_")))
    needed = ("doc_id", "text", source)
    rows = packed(docs, *needed).withColumns({"_d_src": _name(F.col(quoted(source))), "_d_size": F.size(words(F.col("text"))).cast("long"), "_d_pick": F.xxhash64("doc_id", "text")}).withColumn("_d_nth", F.row_number().over(same("_d_")))
    match = [F.col(f"_d_{c}") == F.col(f"_m_{c}") for c in ("src", "size", "pick", "nth")]
    both = rows.join(plan, match).where("_m_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_m_copies"))))
    return unpacked(both, docs.columns, needed)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents (see mix)."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
