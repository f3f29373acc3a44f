"""Identity keys of organisations, identifiers, periods and places, and safe names of files, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that are no part of a name; legal forms and their short forms; the length of an identifier; the
# years of a period; what the label of a total, and of a part of one, begins with.
QUOTES = "«»“”„‟\"'`‘’"
LEGAL_FORMS = {
    "товарищество с ограниченной ответственностью": "ТОО", "акционерное общество": "АО", "индивидуальный предприниматель": "ИП",
    "тоо": "ТОО", "ао": "АО", "оао": "ОАО", "зао": "ЗАО", "ип кх": "ИП КХ", "ип": "ИП", "гкп": "ГКП",
}
IDENTIFIER_DIGITS, PERIOD_YEARS = 12, (2000, 2100)
TOTALS = ("итого", "всего", "подытог", "сумма", "суммарно", "суммарный", "барлығы", "жиыны", "total")
SUBSETS = ("в том числе", "из них", "оның ішінде", "including")


def display_name(name: Column) -> Column:
    """A name without quotation marks, white space collapsed. Null stays null. Composed and decomposed letters aren't unified, as the JVM has no function for it."""
    return F.trim(F.regexp_replace(F.translate(name, QUOTES, " " * len(QUOTES)), r"(?U)\s+", " "))


def identity_key(text: Column) -> Column:
    """What two spellings of one name, region or address share: display_name in lower case."""
    return F.lower(display_name(text))


def legal_form(name: Column) -> Column:
    """struct(form, rest) of a name: the legal form that it begins with, the longest that fits, and the key without it; form is null where there is none."""
    key = identity_key(name)
    split = F.struct(F.lit(None).cast("string").alias("form"), key.alias("rest"))
    for spelling in sorted(LEGAL_FORMS, key=len):
        rest = F.trim(F.substring(key, len(spelling) + 1, 1 << 30))
        split = F.when((key == spelling) | key.startswith(spelling + " "), F.struct(F.lit(LEGAL_FORMS[spelling]).alias("form"), rest.alias("rest"))).otherwise(split)
    return split


def organisation(name: Column) -> Column:
    """struct(label, key, form): the name to show, the key without its legal form (with it, where nothing else is left), the form."""
    split = legal_form(name)
    key = F.when(split["rest"] != "", split["rest"]).otherwise(identity_key(name))
    return F.struct(display_name(name).alias("label"), key.alias("key"), split["form"].alias("form"))


def identifier(raw: Column) -> Column:
    """The twelve digits of an identifier, whatever stands between them; null for fewer or more."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) == IDENTIFIER_DIGITS, digits)


def period(start: Column, end: Column) -> Column:
    """start-end for two years in the window and in order; null otherwise, also where one is no whole number."""
    a, b = (F.trim(x.cast("string")).try_cast("int") for x in (start, end))
    low, high = PERIOD_YEARS
    return F.when(a.between(low, high) & b.between(low, high) & (a <= b), F.concat_ws("-", a, b))


def begins_with_any(label: Column, openings: tuple[str, ...]) -> Column:
    """If a normalised label begins with one of them; TOTALS and SUBSETS are meant."""
    found = F.lit(False)
    for opening in openings:
        found = found | label.startswith(opening)
    return F.coalesce(found, F.lit(False))


def safe_path(path: Column) -> Column:
    """If a path stays below the folder that it is relative to; null doesn't."""
    return F.coalesce(~path.startswith("/") & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def safe_posix_path(path: Column) -> Column:
    """safe_path, and neither empty nor with a backslash."""
    return safe_path(path) & (path != "") & ~path.contains("\\")


def safe_component(name: Column) -> Column:
    """If a name can be one part of a path: not empty, no separators, no two dots; null can't."""
    return F.coalesce((name != "") & ~name.contains("/") & ~name.contains("\\") & ~name.contains(".."), F.lit(False))


def safe_identifier(name: Column) -> Column:
    """safe_component, and no dot in front."""
    return safe_component(name) & ~name.startswith(".")
