"""Number scanner and unit registry."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical unit, kind, unit, factor to the canonical unit.
UNITS = (
    ("t", "mass", "t", "1"), ("t", "mass", "kg", "0.001"), ("t", "mass", "g", "0.000001"),
    ("m3", "volume", "m3", "1"), ("m3", "volume", "l", "0.001"), ("m3", "volume", "km3", "1000000000"),
    ("m", "length", "m", "1"), ("m", "length", "km", "1000"), ("m", "length", "cm", "0.01"), ("m", "length", "mm", "0.001"),
    ("m2", "area", "m2", "1"), ("m2", "area", "ha", "10000"), ("m2", "area", "km2", "1000000"),
    ("%", "share", "%", "1"), ("h", "time", "h", "1"), ("h", "time", "d", "24"),
)
MOST_DIGITS, YEARS = 9, (1900, 2100)

_NUMBER = re.compile(r"(?<![\w.,])([-−–]?)(\d+(?:[  ]\d{3})*(?:[.,]\d+)*)(?![\w])")
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b")
_CODE = re.compile(r"(?:№|#|\b(?:No|ID|BIN|GOST|ISO)\b)\s*$", re.IGNORECASE)
_UNIT = re.compile(r"\s*(%|[^\W\d_]+[23]?)")
_BY_NAME = {u: (canonical, kind, Decimal(f)) for canonical, kind, u, f in UNITS}


def read_numeral(raw: str) -> tuple[Decimal | None, Decimal, list[str]]:
    """Value, quantum of the last digit, flags. One separator before exactly three digits may part thousands or decimals: the value is then ambiguous."""
    flat, flags = re.sub("[  ]", "", raw), []
    marks = [c for c in flat if c in ".,"]
    if len(set(marks)) == 2:
        last = max(flat.rfind("."), flat.rfind(","))
        flat = flat[:last].replace(".", "").replace(",", "") + "." + flat[last + 1 :]
    elif len(marks) > 1:
        flat, flags = flat.replace(marks[0], ""), ["grouped"]
    elif marks:
        whole, _, rest = flat.partition(marks[0])
        flat = f"{whole}.{rest}"
        if len(rest) == 3 and whole.strip("0"):
            flags.append("ambiguous_decimal_grouping")
    if sum(c.isdigit() for c in flat.split(".")[0]) > MOST_DIGITS:
        return None, Decimal(1), ["too_many_digits"]
    value = Decimal(flat)
    return value, Decimal(1).scaleb(value.as_tuple().exponent), flags


def scan(text: str) -> Iterator[tuple[int, int, str, str | None, str | None, str | None, str | None, list[str]]]:
    """(start, end, raw, value, quantum, unit, suppressed, flags) for each number of a text, in order; suppressed says why one isn't a quantity."""
    dates = [m.span() for m in _DATE.finditer(text)]
    for m in _NUMBER.finditer(text):
        raw, (start, end) = m.group(2), m.span(2)
        value, quantum, flags = read_numeral(raw)
        after = _UNIT.match(text, end)
        unit = after.group(1) if after and after.group(1) in _BY_NAME else None
        why = None
        if any(a <= start < b for a, b in dates):
            why = "date"
        elif _CODE.search(text[max(0, start - 8) : start]):
            why = "reference_identifier"
        elif len(raw) > 1 and raw[0] == "0" and raw.isdigit():
            why = "zero_padded_code"
        elif value is None:
            why = "identifier_sequence"
        elif unit is None and raw.isdigit() and YEARS[0] <= int(raw) <= YEARS[1]:
            why = "bare_year_like"
        elif unit is None:
            why = "narrative_unitless"
        sign = -1 if m.group(1) else 1
        yield start, end, raw, None if value is None else f"{value * sign:f}", f"{quantum:f}", unit, why, flags


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id with one row for each number of the text. Null texts have none."""
    schema = "array<struct<start:int,end:int,raw:string,value:string,quantum:string,unit:string,suppressed:string,flags:array<string>>>"

    @F.pandas_udf(schema)
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([list(scan(t or "")) for t in texts], dtype=object)

    return docs.select("doc_id", F.explode(of(F.col(text))).alias("m")).select("doc_id", "m.*")


def registry(spark: SparkSession) -> DataFrame:
    """The unit registry: as many rows as UNITS."""
    rows = [(c, k, u, Decimal(f)) for c, k, u, f in UNITS]
    return spark.createDataFrame(rows, "canonical string, kind string, unit string, factor decimal(16,6)")


def to_canonical(value: Column, factor: Column) -> Column:
    """Exact product: decimal(21,12) by decimal(16,6) is decimal(38,18)."""
    return value.cast("decimal(21,12)") * factor.cast("decimal(16,6)")
