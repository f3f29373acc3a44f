"""Label normalisation, tokens and the section match cascade."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# What a label, and a title, has instead of spaces; numbering before a title; raised digits.
_PUNCTUATION, _TITLE_PUNCTUATION = re.compile(r"[^\w\s%]"), re.compile(r"[^\w\s]")
_NUMBERING = re.compile(r"^[\d\s.\-–—)(]+")
_RAISED = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


def _raised(text: str) -> str:
    """Raised digits as plain ones; after 10 as a power, before nothing but a digit a raised 0 is a degree."""
    text = re.sub(r"(?<=10)[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+", lambda m: "^" + m.group().translate(_RAISED), text)
    return re.sub(r"(?<=\d)⁰(?!\d)", "°", text).translate(_RAISED)


def _each(f: Callable[[str], str], texts: pd.Series) -> pd.Series:
    """f of each distinct text of a batch once; null stays null."""
    known = {t: f(t) for t in texts.dropna().unique()}
    return texts.map(known.get, na_action="ignore")


def _plain(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold().replace("ё", "е")


@F.pandas_udf(StringType())
def normalize_label(text: pd.Series) -> pd.Series:
    """Raised digits and compatibility forms folded, case too, ё as е, punctuation but % to single spaces. Null stays null."""
    return _each(lambda t: " ".join(_PUNCTUATION.sub(" ", _plain(_raised(t))).split()), text)


@F.pandas_udf(StringType())
def normalize_title(text: pd.Series) -> pd.Series:
    """Compatibility forms and case folded, ё as е, without leading numbering and punctuation. Null stays null."""
    return _each(lambda t: " ".join(_TITLE_PUNCTUATION.sub(" ", _NUMBERING.sub(" ", _plain(t))).split()), text)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


# Letters of a token (Latin, Russian, Kazakh) and function words that carry no signal.
LETTERS = "0-9a-zа-яёәғқңөұүһі"
STOPWORDS = (
    "и", "в", "во", "на", "не", "с", "со", "по", "для", "от", "до", "из", "к", "о", "об", "при", "за", "или", "а", "но", "что", "как", "это", "быть",
    "должен", "должна", "должно", "должны", "также", "их", "его", "ее", "её", "все", "том", "числе",
    "және", "мен", "бен", "пен", "үшін", "бойынша", "туралы", "болуы", "тиіс", "керек", "немесе",
    "the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "is", "are", "be", "by", "with", "shall", "must", "should",
)


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case tokens of letters and digits, at least so many, in order, without function words; ё reads as е.

    In the JVM, so compatibility forms (ligatures, full width) aren't folded. Null has none.
    """
    lowered = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е")
    return F.filter(F.split(lowered, f"[^{LETTERS}]+"), lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS))


def squeeze(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed, in the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
