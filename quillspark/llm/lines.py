"""Site-relative line dedup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import cut, join_hot, packed, quoted, table, unpacked

#: A line goes if over RATIO thousandths of its host's pages have it, and MIN_PAGES at least.
RATIO, MIN_PAGES = 50, 5
#: Measured bytes of boilerplate hashes up to which every executor gets them all; beyond, pages are joined to them by host.
BROADCAST_BYTES = 8 << 20
#: A host's hashes lie in so many sets, by remainder, so that a line is looked up in a short one.
SETS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Null for a blank line; else a 64-bit hash of the line without white space at its ends."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def _site(host: str) -> Column:
    """A host as a key without nulls; "n" is the null host."""
    return F.coalesce(F.concat(F.lit("s"), F.col(quoted(host)).cast("string")), F.lit("n"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: int = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hashes), host as _site() names it: the lines that over ratio thousandths of a host's pages contain.

    A page counts once for a line however often it has it. Counts are summed before the shuffle, so a host
    or line that most pages have is no hot group. A host's hashes number at most 1000 / ratio times its mean
    number of lines a page, however many pages it has. Pages without a host are one host.
    """
    pages = docs.select(_site(host).alias("host"), F.array_compact(F.array_distinct(F.transform(_lines(F.col("text")), _key))).alias("keys"))
    totals = docs.groupBy(_site(host).alias("host")).agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(F.broadcast(totals) if _small(totals) else totals, "host").where(F.col("n") * 1000 > F.col("pages") * ratio)
    return common.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("hashes"))


def _small(hosts: DataFrame) -> bool:
    """Whether a table of one short row a host is within the bound for broadcasting."""
    return hosts.limit(100_001).count() <= 100_000


def strip_lines(docs: DataFrame, host: str = "source", ratio: int = RATIO, min_pages: int = MIN_PAGES, counts: str | None = None) -> DataFrame:
    """docs with boilerplate lines cut from text; if counts names a column, it gets a struct (n_lines, n_dropped).

    Null texts stay null with no lines. Blank lines stay. A page whose every line goes keeps an empty text.
    Repeated rows come back as often as they are there; other columns pass through. No rows give no rows.
    No text is shuffled for a host that has many of the pages, nor for any while all hosts' hashes are small.
    """
    found = cut(boilerplate(docs, host, ratio, min_pages))
    size = found.agg(F.sum(F.size("hashes") * 8 + 40)).first()[0] or 0
    sets = F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda b: F.filter("hashes", lambda h: F.pmod(h, F.lit(SETS)) == b))
    found = found.select(F.col("host").alias("_site"), sets.alias("_sets"))
    needed = ("text",) if host == "text" else ("text", host)
    rows = packed(docs, *needed).withColumn("_site", _site(host))
    joined = rows.join(F.broadcast(found), "_site", "left") if size <= BROADCAST_BYTES else join_hot(rows, found, "_site", "left")
    split = joined.withColumn("_all", F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(_lines(F.col("text"))))
    stays = lambda x: F.coalesce(~F.array_contains(F.get("_sets", F.pmod(x["k"], F.lit(SETS)).cast("int")), x["k"]), F.lit(True))
    kept = F.filter(F.transform("_all", lambda x: F.struct(x.alias("x"), _key(x).alias("k"))), stays).getField("x")
    split = split.withColumn("_kept", F.when(F.col("_sets").isNull(), F.col("_all")).otherwise(kept))
    n = F.struct(F.size("_all").cast("long").alias("n_lines"), (F.size("_all") - F.size("_kept")).cast("long").alias("n_dropped"))
    counted = split.withColumn("_n", n).withColumn("text", F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")))
    return unpacked(counted, docs.columns, needed, *([F.col("_n").alias(counts)] if counts else []))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lines dropped and a digest of the text left, for each row of documents (see strip_lines)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return strip_lines(docs, counts="n").select("doc_id", "n.n_lines", "n.n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The lines that go, as DuckDB SQL over a view named by {docs}.
GONE_SQL = """
  split_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM {docs} WHERE text IS NOT NULL),
  keyed_lines AS (SELECT DISTINCT doc_id, source, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM split_lines),
  line_pages AS (SELECT source, k, count(*) AS n FROM keyed_lines WHERE k <> '' GROUP BY source, k),
  site_pages AS (SELECT source, count(*) AS pages FROM {docs} GROUP BY source),
  gone AS (SELECT l.source, l.k FROM line_pages l JOIN site_pages s ON l.source IS NOT DISTINCT FROM s.source WHERE l.n >= 5 AND l.n * 1000 > s.pages * 50)
"""

SQL = f"""
WITH {GONE_SQL.format(docs="documents")},
numbered AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
marked AS (SELECT m.doc_id, m.line, m.i, g.k IS NOT NULL AS goes FROM numbered m LEFT JOIN gone g ON m.source IS NOT DISTINCT FROM g.source AND trim(m.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = g.k),
summed AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT goes), '')) AS kept_sha256 FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_dropped, 0)::BIGINT AS n_dropped, coalesce(s.kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""
