"""Constraint rules of records as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import folded, stripped

# -- fixed values -------------------------------------------------------------------------
TYPES = ("empty", "boolean", "integer", "number", "date", "datetime", "time", "string", "mixed")
SOURCE_KINDS = ("csv", "worksheet_range", "excel_table")
VISIBILITIES = ("visible", "hidden", "very_hidden")
EXTRACTION_METHODS = ("embedded_text", "ocr", "none")


def columns(cols: DataFrame) -> DataFrame:
    """Per dataset of ``(dataset, idx, name)``: indices from 1, names filled and unique whatever their case."""
    return cols.groupBy("dataset").agg(
        F.bool_and(F.col("idx") >= 1).alias("index_ok"), F.bool_and(stripped(F.col("name")) != "").alias("name_ok"), (F.count_distinct(folded(F.col("name"))) == F.count("*")).alias("unique_ok")
    )


def range_ok(start: Column, end: Column, n: Column, total: Column) -> Column:
    """A segment's range: none if it is empty, else as long as its rows and within the total."""
    empty = (n == 0) & start.isNull() & end.isNull()
    return F.coalesce(empty | ((end == start + n - 1) & (end <= total)), F.lit(False))


def source_name_ok(name: Column) -> Column:
    """A bare file name."""
    return F.coalesce((name != "") & ~name.rlike(r"[/\\]") & ~name.isin(".", ".."), F.lit(False))


def finite_ok(value: Column) -> Column:
    return value.isNull() | (~F.isnan(value) & (F.abs(value) < float("inf")))


def dialect_ok(delimiter: Column, quote: Column, escape: Column, terminator: Column) -> Column:
    single = lambda c: c.isNull() | (F.length(c) == 1)
    return F.coalesce((F.length(delimiter) == 1) & single(quote) & single(escape) & (F.length(terminator) > 0), F.lit(False))


def section_ok(level: Column, start: Column, end: Column) -> Column:
    return F.coalesce((level.isNull() | (level >= 1)) & (start >= 1) & (end >= start), F.lit(False))


def page_ok(page: Column, method: Column) -> Column:
    return F.coalesce((page >= 1) & method.isin(*EXTRACTION_METHODS), F.lit(False))


def formula_ok(reference: Column, formula: Column) -> Column:
    return F.coalesce((stripped(reference) != "") & F.startswith(formula, F.lit("=")), F.lit(False))


def looks_like_header(cells: Column) -> Column:
    """All cells are filled text and differ whatever their case."""
    bare = F.transform(cells, lambda c: folded(stripped(c)))
    return F.coalesce(F.forall(bare, lambda c: c != "") & (F.size(F.array_distinct(bare)) == F.size(cells)), F.lit(False))


def enforced(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, failing where a rule is broken."""
    return df.where(F.assert_true(ok, message).isNull())
