"""Cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Tables cut within each settle() that is under way.
_OPEN: list[list[str]] = []
#: Makes Spark remove a query's shuffle files as soon as it ends, in place of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; the warehouse's, which is shared too, only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or spark.conf.get("spark.sql.warehouse.dir")


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the context may be gone at exit; the folder is then the cluster's to clean
        pass


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again.

    Later jobs start from the files: a lost executor costs no recomputation, and Spark knows the size.
    The files go when the process ends, the shuffle files of the writing at once: nothing reads them again.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if base not in _ROOTS:
        _ROOTS[base] = f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex}"
        atexit.register(_sweep, spark, _ROOTS[base])
    path = f"{_ROOTS[base]}/{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """cut(build()); the tables that build has cut on its way, which nothing but its result may read, then go at once."""
    _OPEN.append([])
    try:
        rows = build()
    except BaseException:
        _drop(spark, _OPEN.pop())
        raise
    mine = _OPEN.pop()
    done = cut(rows)
    _drop(spark, mine)
    return done


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _sweep(spark, path)
