"""Strict record sources: manifests, JSON lines, inventories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("document_id", "local_path", "original_filename", "document_type", "role")] + [T.StructField("use_as_model_feature", T.BooleanType())] + [T.StructField(n, T.StringType()) for n in ("file_format", "sha256", "label_timing", "notes")])
MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("schema_version", "project_id", "source_metadata_path", "source_url", "region", "industry")]
    + [T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("company_id", T.StringType()), T.StructField("developer_id", T.StringType()), T.StructField("documents", T.ArrayType(DOCUMENT))]
)
# Why a document isn't selected.
LEAKAGE, ARCHIVE, UNSUPPORTED = "excluded_by_leakage_boundary", "auxiliary_archive_never_ingested", "unsupported_file_format"


def read_strict(spark: SparkSession, path: str, schema: T.StructType, required: list[str], skip_blank: bool = False) -> DataFrame:
    """JSON lines under a declared schema. A line that isn't an object or lacks a required key is an error that quotes it; so is a blank one unless skip_blank."""
    raw = spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("value").alias("keys"))
    lacking = F.size(F.array_except(F.array(*[F.lit(k) for k in required]).cast("array<string>"), F.coalesce("keys", F.array().cast("array<string>")))) > 0
    bad = F.col("keys").isNull() | lacking
    blank = F.lit(skip_blank) & (F.trim("value") == "")  # told apart in one expression: Spark may move a filter behind the error
    checked = raw.withColumn("r", F.when(blank, None).when(bad, F.raise_error(F.concat(F.lit("not a valid record: "), F.substring(F.col("value"), 1, 200))).cast(schema)).otherwise(F.col("r"))).where("r is not null")
    return checked.select("r.*")


def read_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones become rows of nulls."""
    return spark.read.schema(schema).json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of each project: project_id, then the document's fields. Blank lines are skipped; a manifest without a project is an error."""
    projects = read_strict(spark, path, MANIFEST, ["project_id", "documents"], skip_blank=True)
    if projects.isEmpty():
        raise ValueError(f"manifest contains no project records: {path}")
    return projects.select("project_id", F.explode("documents").alias("d")).select("project_id", "d.*")


def route(file_format: Column, role: Column) -> Column:
    """Parser of a document by its declared format; its name is never looked at."""
    form = F.lower(file_format)
    archive = F.coalesce(role == "auxiliary_archive", F.lit(False)) | form.isin("rar", "zip", "7z")
    return F.when(archive, "skip_archive").when(form.isin("pdf", "docx"), form).otherwise("skip_unsupported")


def select_documents(documents: DataFrame, include_label_sources: bool = False, project_id: str | None = None, document_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Selected and skipped documents in scope; the skipped ones have a reason. Label sources never reach features unless asked for."""
    scope = documents
    for column, only in (("project_id", project_id), ("document_id", document_id)):
        scope = scope if only is None else scope.where(F.col(column) == only)
    routed = scope.withColumn("route", route(F.col("file_format"), F.col("role")))
    label = F.coalesce(F.col("role") == "label_source", F.lit(False))
    default = F.coalesce((F.col("role") == "model_input") & F.col("use_as_model_feature") & (F.col("label_timing") == "pre_review"), F.lit(False))
    wanted = default | (label & F.lit(include_label_sources))
    why = F.when(F.col("route") == "skip_archive", ARCHIVE).when(~wanted, LEAKAGE).when(F.col("route") == "skip_unsupported", UNSUPPORTED)
    marked = routed.withColumn("reason", why)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def media_type(content: Column) -> Column:
    """Type of a file by its first bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff").when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), "application/zip")
    )


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, media_type) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), media_type(F.col("content")).alias("media_type"))


def listed_inventory(spark: SparkSession, documents: DataFrame, root: str) -> DataFrame:
    """documents(project_id, document_id, local_path) with bytes, digest and media_type of their files below root: only what the manifest lists, so that outputs can't enter. A missing file has nulls."""
    prefix = root.rstrip("/")
    found = inventory(spark, root).select(F.regexp_extract("path", ".*?" + re.escape(prefix) + "/(.*)$", 1).alias("local_path"), "bytes", F.col("sha256").alias("digest"), "media_type")
    return documents.select("project_id", "document_id", "local_path").join(found, "local_path", "left")


def cells(tables: DataFrame) -> DataFrame:
    """Table grids (array of array of text) as rows (table_id, row, col, text)."""
    rows = tables.select("table_id", F.posexplode("cells").alias("row", "line"))
    return rows.select("table_id", "row", F.posexplode("line").alias("col", "text"))
