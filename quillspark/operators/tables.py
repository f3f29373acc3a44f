"""Tables and numerals: totals over segments, decimal styles, twins, covering headings, package profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: a stated total differs if it is off by more than this share.
TOTAL_TOLERANCE = "0.02"


def totals_above(rows: DataFrame, table: str, order: str, value: Column, total: Column, divider: Column, subset: Column, quantum: str = "0.01") -> DataFrame:
    """(table, total_row, stated, computed, n_parts, abs_diff, mismatch): each total against the rows above it.

    A segment ends at a total or divider row. Its parts are the rows that are neither, and no subset of the row
    before. It is checked with two parts or more, all with a value, unless each equals the total. Flags that are
    null are false. A table's rows are ordered in one task. No rows give no rows.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    is_total = flag(total)
    is_divider = flag(divider) & ~is_total
    r = rows.select(F.col(table), F.col(order), value.cast("decimal(18,2)").alias("_v"), is_total.alias("_total"), is_divider.alias("_divider"), (~is_total & ~is_divider & ~flag(subset)).alias("_part"))
    before = W.partitionBy(table).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumn("_segment", F.coalesce(F.sum((F.col("_total") | F.col("_divider")).cast("int")).over(before), F.lit(0)))
    part = F.when(F.col("_part"), F.col("_v"))
    s = r.groupBy(table, "_segment").agg(
        F.max(F.when(F.col("_total"), F.col(order))).alias("total_row"), F.max(F.when(F.col("_total"), F.col("_v"))).alias("stated"), F.sum(part).cast("decimal(18,2)").alias("computed"),
        F.count_if("_part").alias("n_parts"), F.count(part).alias("_known"), F.min(part).alias("_lo"), F.max(part).alias("_hi"))
    s = s.where((F.col("n_parts") >= 2) & (F.col("_known") == F.col("n_parts")) & F.col("stated").isNotNull() & ~((F.col("_lo") == F.col("stated")) & (F.col("_hi") == F.col("stated"))))
    s = s.withColumn("abs_diff", F.abs(F.col("stated") - F.col("computed")).cast("decimal(18,2)"))
    far = F.col("abs_diff") > F.lit(TOTAL_TOLERANCE).cast("decimal(4,2)") * F.greatest(F.abs("stated"), F.abs("computed"))
    mismatch = (F.col("abs_diff") * 2 > F.lit(quantum).cast("decimal(18,2)")) & ((F.col("stated") == 0) | (F.col("computed") == 0) | far)
    return s.select(table, "total_row", "stated", "computed", "n_parts", "abs_diff", mismatch.alias("mismatch"))


def numeral_styles(text: Column) -> tuple[Column, Column, Column]:
    """(style, comma groups, dot groups): the separator that most plain decimals of a text have, null without a majority, and whether a numeral proves that one groups thousands.

    One separator before exactly three digits has no vote, unless the whole part is 0. A null text proves nothing.
    """
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9.,]+)"), F.lit(1)), lambda r: F.btrim(r, F.lit(".,")))
    plain = F.filter(runs, lambda r: r.rlike("^[0-9]+[.,][0-9]+$") & (~r.rlike("[.,][0-9]{3}$") | r.rlike("^0[.,]")))
    commas = F.size(F.filter(plain, lambda r: r.contains(",")))
    dots = F.size(plain) - commas
    proves = lambda mark: F.exists(runs, lambda r: r.rlike(f"^[0-9]{{1,3}}({mark}[0-9]{{3}}){{2,}}$"))
    return F.when(commas > dots, "comma").when(dots > commas, "dot"), proves(","), proves("[.]")


def settle_numeral(raw: Column, style: Column) -> Column:
    """The value of an ambiguous numeral (one separator) by its document's decimal style; null without a style."""
    mark = F.when(raw.contains(","), "comma").otherwise("dot")
    return F.when(style.isNotNull(), F.when(style == mark, F.translate(raw, ",", ".")).otherwise(F.translate(raw, ",.", ""))).cast("decimal(28,8)")


def from_twins(rows: DataFrame, keys: list[str], evidence: str, order: str) -> DataFrame:
    """rows with evidence filled, where null, by the last row in order that has the same keys and evidence. Null keys have no twin.

    One aggregate a key is shuffled with partial sums; rows of a hot key stay apart.
    """
    known = rows.where(F.col(evidence).isNotNull()).groupBy(*keys).agg(F.max_by(evidence, order).alias("_twin"))
    return rows.join(known, keys, "left").withColumn(evidence, F.coalesce(evidence, "_twin")).select(*rows.columns)


def covering_heading(pages: DataFrame, sections: DataFrame, document: str, page: str, start: str, end: str, title: str, section: str, order: str) -> DataFrame:
    """pages with section and title of the last section, in order, that covers the page; the title is the last one that isn't empty.

    Sections are spread over their pages, which their document bounds, so the join is on equal keys. Reversed or
    null ranges cover nothing; a page that none covers has nulls.
    """
    spread = sections.where(F.col(start) <= F.col(end)).select(F.col(document), F.explode(F.sequence(F.col(start), F.col(end))).alias(page), title, section, order)
    titled = F.when(F.col(title).isNotNull() & (F.col(title) != ""), F.col(order))
    best = spread.groupBy(document, page).agg(F.max_by(title, titled).alias(title), F.max_by(section, order).alias(section))
    return pages.join(best, [document, page], "left")


def token_matches(a: Column, b: Column) -> Column:
    """Equality of two words but for inflection: a long common beginning, or one other last letter. Null if either is null."""
    short = F.least(F.length(a), F.length(b))
    common = F.when(short == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: a.substr(F.lit(1), i) == b.substr(F.lit(1), i))))
    last = (short >= 4) & (F.length(a) == F.length(b)) & (common >= short - 1)
    return (a == b) | last | ((short >= 5) & (common >= F.greatest(F.lit(5), F.ceil(short * 3 / 4), short - 3)))


def concept_in(concept: Column, text: Column) -> Column:
    """Whether a normalised text has a normalised concept, or a match for each of its words. An empty or null concept is in none."""
    of = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != "")
    found = F.forall(of(concept), lambda c: F.exists(of(text), lambda t: token_matches(c, t)))
    return F.coalesce((concept != "") & (F.coalesce(text, F.lit("")).contains(concept) | found), F.lit(False))


def table_errors(rows: Column, cols: Column, cells: Column) -> Column:
    """Array of what breaks a table's contract; empty for a sound one."""
    return F.when(rows.isNull() | cols.isNull() | cells.isNull(), F.array(F.lit("malformed"))).otherwise(F.array_compact(F.array(
        F.when(~F.exists(F.flatten(F.filter(cells, lambda r: r.isNotNull())), lambda c: F.coalesce(F.trim(c) != "", F.lit(False))), "blank"),
        F.when(F.size(cells) != rows, "row_count"),
        F.when(F.exists(cells, lambda r: r.isNull() | (F.size(r) != cols)), "row_width"))))


def profile(types: Column, profiles: list[tuple[str, list[str]]]) -> Column:
    """Name of the profile whose trigger types overlap types most; the first of equals."""
    ranked = [F.struct(F.size(F.array_intersect(types, F.array(*[F.lit(x) for x in triggers]))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, triggers) in enumerate(profiles)]
    return F.array_max(F.array(*ranked)).getField("name")
