"""Ordered operators: blocks, continuation runs, progress, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blocks(rows: DataFrame, key: str, order: str, heads: Column) -> DataFrame:
    """rows with block: a number that rises at each head within a key; 0 before the first."""
    return rows.withColumn("block", F.sum(heads.cast("long")).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def runs(rows: DataFrame, key: str, order: str, continues: Column) -> DataFrame:
    """rows with run: rows that continue the one before share its number. continues may use _before, the struct of the row before."""
    place = W.partitionBy(key).orderBy(order)
    before = rows.withColumn("_before", F.lag(F.struct(*rows.columns)).over(place))
    return before.withColumn("run", F.sum((~F.coalesce(continues, F.lit(False))).cast("long")).over(place.rowsBetween(W.unboundedPreceding, 0))).drop("_before")


def sessions(rows: DataFrame, key: str, time: str, ttl_seconds: int) -> DataFrame:
    """(key, start, end, n): rows of a key that follow each other within the time to live."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    late = micros(time) - micros(f"_before.{time}") <= ttl_seconds * 1_000_000
    numbered = runs(rows.select(key, time), key, time, late)
    return numbered.groupBy(key, "run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).drop("run")


def recent_log(events: DataFrame, key: str, order: str, value: str, most: int = 200) -> DataFrame:
    """The last `most` events of each key with progress, the greatest value so far."""
    place = W.partitionBy(key).orderBy(order)
    numbered = events.withColumn("progress", F.max(value).over(place.rowsBetween(W.unboundedPreceding, 0))).withColumn("_back", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order))))
    return numbered.where(F.col("_back") <= most).drop("_back")
