"""Typing of text cells and the lattice of column types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: words that are booleans -------------------------------------------------
TRUE_WORDS = ("true", "sim", "yes")
FALSE_WORDS = ("false", "não", "nao", "no")

INTEGER = r"^[-+]?(0|[1-9][0-9]*)$"
DECIMAL = r"^[-+]?[0-9]+\.[0-9]+$"
DECIMAL_COMMA = r"^[-+]?[0-9]+,[0-9]+$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[-+][0-9]{2}:[0-9]{2})?$"
TIME = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,6})?)?$"


def kind(value: Column, delimiter: Column | str = ";") -> Column:
    """Type of a stripped cell: empty, boolean, integer, number, date, datetime, time or string."""
    comma = (F.lit(delimiter) if isinstance(delimiter, str) else delimiter) == ","
    low = F.lower(value)
    day = F.substring(value, 1, 10).try_cast("date").isNotNull()
    moment = F.regexp_replace(value, "T", " ").try_cast("timestamp").isNotNull()
    return (
        F.when(value.isNull() | (value == ""), "empty")
        .when(low.isin(*TRUE_WORDS, *FALSE_WORDS), "boolean")
        .when(value.rlike(INTEGER), "integer")
        .when(value.rlike(DECIMAL) | (~comma & value.rlike(DECIMAL_COMMA)), "number")
        .when(value.rlike(DATE) & day, "date")
        .when(value.rlike(DATETIME) & day & moment, "datetime")
        .when(value.rlike(TIME), "time")
        .otherwise("string")
    )


def literal(value: Column, of: Column) -> Column:
    """The JSON literal of a cell of a type (integers keep all their digits; null for empty)."""
    bare = F.regexp_replace(value, r"^\+", "")
    number = F.regexp_replace(bare, ",", ".").cast("double").cast("string")
    return (
        F.when(of == "empty", F.lit(None).cast("string"))
        .when(of == "boolean", F.when(F.lower(value).isin(*TRUE_WORDS), "true").otherwise("false"))
        .when(of == "integer", F.when(bare.isin("-0"), "0").otherwise(bare))
        .when(of == "number", number)
        .otherwise(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))
    )


def lattice(kinds: Column) -> Column:
    """The column type of a set of cell types (an array without repeats)."""
    found = F.array_sort(F.array_except(kinds, F.array(F.lit("empty"))))
    within = lambda *names: F.size(F.array_except(found, F.array(*map(F.lit, names)))) == 0
    return (
        F.when(F.size(found) == 0, "empty")
        .when(within("integer", "number"), F.when(F.array_contains(found, "number"), "number").otherwise("integer"))
        .when(within("date", "datetime"), F.when(F.array_contains(found, "datetime"), "datetime").otherwise("date"))
        .when(F.size(found) == 1, F.element_at(found, 1))
        .otherwise("mixed")
    )
