"""Sinks: JSON lines in a total order, review templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, *order: Column | str) -> None:
    """JSON lines, range-partitioned and sorted by order: files in name order are in row order."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").json(path, ignoreNullFields=False)


def merge_template(current: DataFrame, edited: DataFrame, key: str = "finding_id") -> tuple[DataFrame, DataFrame]:
    """The new template and the stale rows: current findings keep what a person has entered, entries of findings that are gone go aside. edited has one row a key."""
    fields = [c for c in edited.columns if c != key]
    merged = current.select(key).distinct().join(edited, key, "left").select(key, *fields)
    return merged, edited.join(current.select(key), key, "left_anti")


# Statuses of a finished extraction, and the files that it leaves.
FINISHED = ("success", "partial")
CORE_FILES = ("document.json", "pages.jsonl", "sections.jsonl", "tables.jsonl", "images.jsonl")


def cache_key(sha: Column, parsers: Column, ocr_mode: Column, schema: Column) -> Column:
    """Digest of a source's hash, its parsers (a map of names to versions, in order of name; no version is unknown), how it reads pictures, and the schema's version."""
    named = F.transform(F.array_sort(F.map_entries(parsers)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.when(e["value"] != "", e["value"]), F.lit("unknown"))))
    return F.sha2(F.concat_ws("|", sha, named, F.concat(F.lit("ocr="), ocr_mode), F.concat(F.lit("schema="), schema)), 256)


def unfinished(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work whose cache key has no finished report with all core files; done(cache_key, extraction_status, files)."""
    whole = F.size(F.array_except(F.array(*[F.lit(f) for f in CORE_FILES]), F.coalesce("files", F.array().cast("array<string>")))) == 0
    return work.join(done.where(F.col("extraction_status").isin(*FINISHED) & whole).select("cache_key"), "cache_key", "left_anti")
