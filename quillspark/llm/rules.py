"""Quality rules with adaptive thresholds from mergeable sketches, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, packed, table, unpacked, words

#: Rates that the sketches hold, as whole numbers from 0 to 1000, with the slack of a threshold: (name, slack above, slack below or None).
RATES = (("symbol_rate", 60, None), ("dup_line_rate", 300, None), ("repeat_rate", 250, None), ("word_length", 25, 25))
#: A threshold lies SPREAD quartile distances and the slack beyond a quartile; a group under MIN_DOCS documents takes its language's sketch, and so on to the corpus.
SPREAD, MIN_DOCS = 3, 50


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base counts of the whole text in a struct _base. A null text has no words.

    A repeated window: the 64-bit hashes of the 3-word windows are sorted with their positions; those that a
    neighbour equals are found twice or more. Work is n log n in a text's words.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumn("_w", words(F.col("text"))).withColumn("_l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    split = split.withColumn("_n", F.size("_w"))
    windows = "CASE WHEN _n < 4 THEN array() ELSE sort_array(transform(sequence(0, _n - 3), i -> struct(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)) as h, i as p))) END"
    split = split.withColumn("_s", F.expr(f"cast({windows} as array<struct<h:bigint,p:int>>)"))
    found = "array_sort(transform(filter(_s, (x, k) -> coalesce(x.h = get(_s, k + 1).h, false) or (k > 0 and x.h = get(_s, k - 1).h)), x -> x.p))"
    split = split.withColumn("_p", F.expr(found))
    covered = "cast(aggregate(transform(_p, (x, k) -> least(3, coalesce(get(_p, k + 1) - x, 3))), 0L, (a, x) -> a + x) as bigint)"
    joined = F.array_join("_w", "")
    base = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(joined).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    return split.withColumn("_base", base).drop("_w", "_l", "_n", "_s", "_p")


def rated(docs: DataFrame) -> DataFrame:
    """Adds the struct _rates and the verdict of the fixed rules to what measured() returns."""
    rates = [
        "least(1000, 1000 * _base.n_symbols div greatest(1, _base.word_chars)) as symbol_rate",
        "1000 * _base.n_dup_lines div greatest(1, _base.n_lines) as dup_line_rate",
        "1000 * _base.n_repeat_words div greatest(1, _base.n_words) as repeat_rate",
        "least(1000, 10 * _base.word_chars div greatest(1, _base.n_words)) as word_length",
    ]
    failed = "_base.n_words < 50 or 100 * _base.n_repeat_words > 50 * _base.n_words as _failed"
    return docs.selectExpr("*", f"struct({', '.join(rates)}) as _rates", failed)


def _quantile(counts: list[tuple[int, int]], quarters: int) -> int | None:
    """The least value that so many quarters of the counted lie at or below; null of nothing."""
    total, so_far = sum(n for _, n in counts), 0
    for v, n in counts:
        so_far += n
        if so_far * 4 >= total * quarters:
            return v
    return None


def thresholds(rates: DataFrame) -> DataFrame:
    """One row for each (lang, source): a lowest and highest value allowed for each rate.

    The sketch of a group and rate is the count of documents at each of 1001 whole values: sketches merge by
    adding counts, their size has a bound, and their quantiles are exact to a thousandth. Documents without
    a word aren't counted.
    """
    names = [name for name, _, _ in RATES]
    long = rates.where("_base.n_words > 0").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), F.col(f"_rates.{n}").cast("int").alias("v")) for n in names])).alias("r"))
    cells = cut(long.groupBy("lang", "source", "r.rate", "r.v").agg(F.count("*").alias("n")))
    out = cells.select("lang", "source").distinct()
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        by = ", ".join([*keys, "rate"])
        merged = cells.groupBy(*keys, "rate", "v").agg(F.sum("n").alias("n"))
        if not keys:  # of the corpus: at most 1001 counts for each rate
            counts = {n: [] for n in names}
            for r in merged.collect():
                counts[r["rate"]].append((r["v"], r["n"]))
            for n in names:
                lo, hi = (_quantile(sorted(counts[n]), share) for share in (1, 3))
                out = out.withColumn(f"_{n}{level}", F.struct(F.lit(lo).cast("int").alias("lo"), F.lit(hi).cast("int").alias("hi")))
            continue
        by = ", ".join([*keys, "rate"])
        ranked = merged.withColumn("cum", F.expr(f"sum(n) over (partition by {by} order by v)")).withColumn("total", F.expr(f"sum(n) over (partition by {by})"))
        quart = ranked.groupBy(*keys, "rate").agg(F.min(F.expr("if(cum * 4 >= total, v, null)")).alias("lo"), F.min(F.expr("if(cum * 4 >= total * 3, v, null)")).alias("hi"), F.max("total").alias("total"))
        wide = quart.groupBy(*keys).agg(F.max("total").alias(f"_t{level}"), *[F.max(F.when(F.col("rate") == n, F.struct("lo", "hi"))).alias(f"_{n}{level}") for n in names])
        match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        out = out.join(wide.withColumnsRenamed({k: f"_k_{k}" for k in keys}), match).drop(*[f"_k_{k}" for k in keys])
    level = f"case when _t0 >= {MIN_DOCS} then 0 when _t1 >= {MIN_DOCS} then 1 else 2 end"
    out = out.withColumn("_level", F.expr(level))
    for name, above, below in RATES:
        q = F.expr(f"case _level when 0 then _{name}0 when 1 then _{name}1 else _{name}2 end")
        out = out.withColumn(f"_{name}", q)
        out = out.withColumn(f"{name}_max", F.expr(f"_{name}.hi + {SPREAD} * (_{name}.hi - _{name}.lo) + {above}"))
        out = out.withColumn(f"{name}_min", F.expr(f"_{name}.lo - {SPREAD} * (_{name}.hi - _{name}.lo) - {below}") if below is not None else F.lit(-1))
    bounds = [F.struct(F.col(f"{n}_min").alias("lo"), F.col(f"{n}_max").alias("hi")).alias(n) for n in names]
    return out.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(*bounds).alias("_bounds"))


def judged(rates: DataFrame) -> DataFrame:
    """Adds _bounds and the verdict _kept to what rated() returns, from sketches over all its rows.

    Null languages and sources are groups of their own. Repeated rows come back as often as they are there.
    A document without a word fails the fixed rules. No rows give no rows. rates is read twice.
    """
    bounds = thresholds(rates)
    joined = rates.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    within = " and ".join(f"_rates.{n} between _bounds.{n}.lo and _bounds.{n}.hi" for n, _, _ in RATES)
    return joined.withColumn("_kept", F.expr(f"not _failed and coalesce({within}, true)"))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that fail. It needs text, lang and source; other columns pass through. See judged() for nulls, repeats and empty tables."""
    needed = ("text", "lang", "source")
    return unpacked(judged(cut(rated(measured(packed(docs, *needed))))).where("_kept"), docs.columns, needed)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each row of documents (see measured and judged)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counts = [f"_base.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged(cut(rated(measured(docs)).drop("text"))).select("doc_id", *counts, F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


#: CTEs that end in verdicts(doc_id, ..., base_failed, kept), as DuckDB SQL over a view named by {docs} with one row a doc_id.
VERDICT_SQL = r"""
  tokens AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM {docs}),
  grams AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM tokens WHERE len(w) >= 3),
  spelled AS (SELECT doc_id, i, [w[i + 1], w[i + 2], w[i + 3]] AS g FROM grams),
  again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM spelled),
  covered AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM again WHERE c >= 2),
  repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
  base AS (
    SELECT k.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l, coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM tokens k LEFT JOIN repeats r ON k.doc_id = r.doc_id),
  counted AS (
    SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
      (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base),
  rates AS (
    SELECT doc_id, lang, source, n_words, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS rate,
      unnest([least(1000, 1000 * n_symbols // greatest(1, word_chars)), 1000 * n_dup_lines // greatest(1, n_lines), 1000 * n_repeat_words // greatest(1, n_words), least(1000, 10 * word_chars // greatest(1, n_words))]) AS v
    FROM counted),
  by_group AS (SELECT lang, source, rate, count(*) AS n, quantile_disc(v, 0.25) AS lo, quantile_disc(v, 0.75) AS hi FROM rates WHERE n_words > 0 GROUP BY ALL),
  by_lang AS (SELECT lang, rate, count(*) AS n, quantile_disc(v, 0.25) AS lo, quantile_disc(v, 0.75) AS hi FROM rates WHERE n_words > 0 GROUP BY ALL),
  by_all AS (SELECT rate, quantile_disc(v, 0.25) AS lo, quantile_disc(v, 0.75) AS hi FROM rates WHERE n_words > 0 GROUP BY ALL),
  bounds AS (
    SELECT g.lang, g.source, g.rate, CASE WHEN g.n >= 50 THEN g.lo WHEN l.n >= 50 THEN l.lo ELSE a.lo END AS lo, CASE WHEN g.n >= 50 THEN g.hi WHEN l.n >= 50 THEN l.hi ELSE a.hi END AS hi
    FROM by_group g JOIN by_lang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.rate = l.rate JOIN by_all a ON g.rate = a.rate),
  fits AS (
    SELECT r.doc_id, bool_and(coalesce(
        r.v <= b.hi + 3 * (b.hi - b.lo) + CASE r.rate WHEN 'symbol_rate' THEN 60 WHEN 'dup_line_rate' THEN 300 WHEN 'repeat_rate' THEN 250 ELSE 25 END
        AND (r.rate <> 'word_length' OR r.v >= b.lo - 3 * (b.hi - b.lo) - 25), true)) AS fit
    FROM rates r LEFT JOIN bounds b ON r.lang IS NOT DISTINCT FROM b.lang AND r.source IS NOT DISTINCT FROM b.source AND r.rate = b.rate GROUP BY r.doc_id),
  verdicts AS (
    SELECT c.doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed, NOT c.base_failed AND f.fit AS kept
    FROM counted c JOIN fits f ON c.doc_id = f.doc_id)
"""

SQL = f"WITH {VERDICT_SQL.replace('{docs}', 'documents')} SELECT * FROM verdicts"
