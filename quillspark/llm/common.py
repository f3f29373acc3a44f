"""What the corpus operators share: tables, cut lineage, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.lineage import cut, settle  # noqa: F401  for the operators

#: Word separators of every contract: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows, and bytes, of an Arrow batch on its way to Python: texts vary from nothing to megabytes.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: A key is hot if it has over a HOT-th of a table's rows.
HOT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, by rows and by bytes (a single text may be longer), in this session from now on: smaller bounds stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as remainder 0 of an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def some(rows: DataFrame, most: int, key: str) -> DataFrame:
    """All rows, or about `most` of them if there are more: those with the least hashes of key."""
    n = rows.count()
    return rows.where(F.xxhash64(F.col(key), F.lit(1)) < -(1 << 63) + (1 << 64) * most // n) if n > most else rows


def hot_keys(counts: DataFrame, key: str, total: int) -> list:
    """The keys of counts(key, n) that over a HOT-th of all rows have: HOT at most."""
    return [r[key] for r in counts.where(F.col(key).isNotNull() & (F.col("n") * HOT > total)).select(key).collect()]


def join_hot(rows: DataFrame, small: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """rows joined to small, which has one row a key, on key (null meets nothing): hot keys are met by broadcast, so that no task gets all their rows.

    There are HOT of them at most, so the broadcast side has HOT rows at most. how: inner, left or left_semi. Without hot
    the keys are counted first.
    """
    if hot is None:
        hot = hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), key, rows.count())
    if not hot:
        return rows.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how).unionByName(rows.where(~is_hot).join(small.where(~is_hot), key, how))


def spread(rows: DataFrame) -> DataFrame:
    """rows, as a side of a join that is shuffled whatever size Spark takes them for.

    Spark counts nothing for an explode, and a file whose values repeat is far smaller than its rows: such a table may
    be taken for small and go to all executors by way of the driver's memory.
    """
    return rows.hint("merge")


def most_frequent(rows: DataFrame, weight: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with the greatest n, `most` of weight in sum at most, and the others if there are any. Rows whose n is within a twelfth of each other stay together."""
    level = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) * 8)
    levels = sorted(((r["level"], r["w"]) for r in rows.groupBy(level.alias("level")).agg(F.sum(weight).alias("w")).collect()), reverse=True)  # 504 at most
    if sum(w for _, w in levels) <= most:
        return rows, None
    total, least = 0, float("inf")
    for at, w in levels:
        total += w
        if total > most:
            break
        least = float(at)
    return rows.where(level >= least), rows.where(level < least)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in the struct _row, numbered, so that no name of theirs can clash with a helper column."""
    rest = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in needed]
    return docs.select(F.struct(F.lit(True).alias("c"), *rest).alias("_row"), *[F.col(quoted(c)) for c in needed])


def unpacked(rows: DataFrame, columns: list[str], needed: tuple[str, ...], *more: Column) -> DataFrame:
    """The columns of before packed(), in their order, then more."""
    return rows.select(*[(F.col(quoted(c)) if c in needed else F.col("_row").getField(f"c{k}")).alias(c) for k, c in enumerate(columns)], *more)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, also with dots."""
    return "`{}`".format(name.replace("`", "``"))
