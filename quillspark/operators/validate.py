"""Validators: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """child rows whose reference is null or names no parent."""
    return child.join(parent.select(F.col(key).alias("_key")).distinct(), F.col(foreign) == F.col("_key"), "left_anti")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def differences(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one side has, with side."""
    return stored.exceptAll(actual).withColumn("side", F.lit("stored")).unionByName(actual.exceptAll(stored).withColumn("side", F.lit("actual")))


def leave_one_out(rows: DataFrame, group: str, most: int = 1000) -> DataFrame:
    """rows once for each fold, with fold and part: each group is left out once. Over `most` groups are an error, as every row comes that often."""
    folds = rows.select(F.col(group).alias("fold")).distinct()
    n = folds.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} groups to leave out")
    listed = folds.agg(F.sort_array(F.collect_list("fold")).alias("fold")).withColumn("_one", F.lit(1))  # a list of `most` at most
    each = rows.withColumn("_one", F.lit(1)).join(F.broadcast(listed), "_one").drop("_one").withColumn("fold", F.explode("fold"))
    return each.withColumn("part", F.when(F.col(group) == F.col("fold"), "test").otherwise("train")).select("fold", *[c for c in rows.columns if c != group], "part")
