"""Delimited tables: dialect, header, names, types and ragged rows, as relations.

A file is a table of lines ``(dataset, line_no, line)``; a cell table has
``(dataset, row_no, col_no, raw)``.  Deciding what a file looks like is
aggregation over these, so any number of files is handled at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.cells import kind, lattice, literal
from docmill.functions.text import folded, stripped, unaccented

#: Delimiters in order of preference, and what is looked at to decide.
DELIMITERS = (",", ";", "\t", "|")
SAMPLE_CHARACTERS = 65_536


def delimiter_scores(rows: DataFrame, dataset: str = "dataset", order: str = "line_no", line: str = "line") -> DataFrame:
    """``(dataset, delimiter, frequency, width, occurrences)``: the modal width over one and how many rows have it.

    Of equally frequent widths the one seen first counts.  Quoted fields are for
    the reader; here a delimiter is a delimiter.
    """
    options = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(i).alias("preference")) for i, d in enumerate(DELIMITERS)])
    each = rows.where(stripped(F.col(line)) != "").select(F.col(dataset).alias("dataset"), F.col(order).alias("line_no"), F.col(line).alias("line"), F.inline(options))
    counted = each.withColumn("hits", (F.length("line") - F.length(F.replace("line", F.col("delimiter"), F.lit("")))).cast("bigint"))
    widths = counted.groupBy("dataset", "delimiter", "preference", "hits").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    wide = F.col("hits") > 0
    best = F.max(F.when(wide, F.struct(F.col("n"), (-F.col("first")).alias("f"), F.col("hits").alias("h"))))
    scores = widths.groupBy("dataset", "delimiter", "preference").agg(best.alias("b"), F.sum(F.col("n") * F.col("hits")).alias("all"))
    return scores.select(
        "dataset", "delimiter", "preference", F.coalesce("b.n", F.lit(0)).cast("bigint").alias("frequency"), F.coalesce(F.col("b.h") + 1, F.lit(0)).cast("bigint").alias("width"),
        F.when(F.col("b").isNotNull(), F.col("all")).otherwise(0).cast("bigint").alias("occurrences"),
    )


def best_delimiter(scores: DataFrame) -> DataFrame:
    """The delimiter of the best score; ties by preference; no score: a comma and a warning."""
    rank = F.struct("frequency", "width", "occurrences", (-F.col("preference")).alias("p"))
    return scores.groupBy("dataset").agg(F.max_by("delimiter", rank).alias("found"), F.max("frequency").alias("frequency")).select(
        "dataset", F.when(F.col("frequency") > 0, F.col("found")).otherwise(",").alias("delimiter"),
        F.when(F.col("frequency") == 0, "csv_dialect_detection_failed_comma_assumed").alias("warning"),
    )


def cells(rows: DataFrame, delimiter: Column | str) -> DataFrame:
    """Cells ``(dataset, row_no, col_no, raw)`` of lines ``(dataset, row_no, line)``, blank rows left out."""
    by = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    parts = F.split(F.col("line"), F.concat(F.lit("\\Q"), by, F.lit("\\E")), -1)
    kept = rows.withColumn("parts", parts).where(F.exists("parts", lambda c: stripped(c) != ""))
    return kept.select("dataset", "row_no", F.posexplode("parts").alias("col_no", "raw")).withColumn("col_no", F.col("col_no") + 1)


def has_header(table: DataFrame, delimiter: Column | str = ";") -> DataFrame:
    """``(dataset, has_header, warning)`` by the rules, in order: under two rows: yes, with a warning;
    a blank or non-text cell in the first row: no; a later non-text cell under it: yes;
    else whether the first row's cells differ."""
    value = stripped(F.col("raw"))
    typed = table.withColumn("kind", kind(value, delimiter)).withColumn("value", value)
    other = ~F.col("kind").isin("string", "empty")
    # a row of a table first, so that no task holds a table
    per_row = typed.groupBy("dataset", "row_no").agg(
        F.max("col_no").alias("width"), F.bool_or(F.col("kind") == "empty").alias("blank"), F.min(F.when(other, F.col("col_no"))).alias("least"), F.count_distinct(folded(F.col("value"))).alias("different")
    )
    found = per_row.groupBy("dataset").agg(F.count("*").alias("rows"), F.min_by(F.struct("width", "blank", "least", "different"), "row_no").alias("head"), F.min("least").alias("least"))
    # where the first row has text only, the least column of another kind is a later row's
    later = F.coalesce(F.col("least") <= F.col("head.width"), F.lit(False))
    few = F.col("rows") < 2
    return found.select(
        "dataset",
        F.when(few, True).when(F.col("head.blank") | F.col("head.least").isNotNull(), False).when(later, True).otherwise(F.col("head.different") == F.col("head.width")).alias("has_header"),
        F.when(few, "csv_header_detection_insufficient_rows_first_row_assumed").alias("warning"),
    )


def named_columns(heads: DataFrame) -> DataFrame:
    """``(dataset, col_no, source_name, name)``: plain lower-case names, repeats numbered from 2."""
    plain = F.regexp_replace(F.regexp_replace(unaccented(F.coalesce("source_name", F.lit(""))), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    base = heads.withColumn("base", F.lower(plain))
    base = base.withColumn("base", F.when(F.col("base") == "", F.concat(F.lit("coluna_"), F.col("col_no").cast("string"))).otherwise(F.col("base")))
    n = F.row_number().over(Window.partitionBy("dataset", "base").orderBy("col_no"))
    return base.withColumn("n", n).select("dataset", "col_no", "source_name", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))).alias("name"))


def typed_cells(table: DataFrame, delimiter: Column | str = ";") -> DataFrame:
    """Adds ``kind`` and ``json`` to a cell table."""
    value = stripped(F.col("raw"))
    typed = table.withColumn("kind", kind(value, delimiter))
    return typed.withColumn("json", literal(value, F.col("kind")))


def column_types(typed: DataFrame, demote: bool = True) -> DataFrame:
    """``(dataset, col_no, inferred_type, nullable, rows)``; a mixed column with text becomes text (``demote``)."""
    seen = F.collect_set("kind")  # nine types at most
    types = typed.groupBy("dataset", "col_no").agg(seen.alias("kinds"), F.bool_or(F.col("kind") == "empty").alias("nullable"), F.count("*").alias("rows"))
    found = types.withColumn("inferred_type", lattice(F.col("kinds")))
    text = (F.col("inferred_type") == "mixed") & F.array_contains("kinds", "string") if demote else F.lit(False)
    return found.select("dataset", "col_no", F.when(text, "string").otherwise(F.col("inferred_type")).alias("inferred_type"), "nullable", "rows")


def demoted(typed: DataFrame) -> DataFrame:
    """Cells of mixed columns that hold text, as their text again.

    Types are a row a column, so they go to the cells by a join that Spark may
    broadcast when it is small.
    """
    types = column_types(typed).select("dataset", "col_no", "inferred_type")
    back = (F.col("inferred_type") == "string") & ~F.col("kind").isin("empty", "string")
    value = stripped(F.col("raw"))
    return typed.join(types, ["dataset", "col_no"]).select(
        "dataset", "row_no", "col_no", "raw", F.when(back, "string").otherwise(F.col("kind")).alias("kind"), F.when(back, literal(value, F.lit("string"))).otherwise(F.col("json")).alias("json")
    )


def shape(rows: DataFrame, delimiter: str) -> DataFrame:
    """``(dataset, width, ragged, blank, rows)`` of lines ``(dataset, row_no, line)``.

    Ragged are the rows whose width is not the greatest; blank ones are counted
    apart and ignored otherwise.
    """
    parts = F.split(F.col("line"), "\\Q" + delimiter + "\\E", -1)
    sized = rows.select("dataset", F.exists(parts, lambda c: stripped(c) != "").alias("filled"), F.size(parts).alias("n"))
    per_width = sized.groupBy("dataset", "filled", "n").agg(F.count("*").alias("c"))
    out = per_width.groupBy("dataset").agg(F.max(F.when(F.col("filled"), F.struct("n", "c"))).alias("m"), F.sum(F.when(F.col("filled"), F.col("c")).otherwise(0)).alias("rows"), F.sum(F.when(~F.col("filled"), F.col("c")).otherwise(0)).alias("blank"))
    return out.select("dataset", F.coalesce("m.n", F.lit(0)).alias("width"), (F.col("rows") - F.coalesce("m.c", F.lit(0))).alias("ragged"), "blank", "rows")


def padded(parts: Column, width: Column | int) -> Column:
    """A row's cells filled up with empty ones, or cut, to a width."""
    n = F.lit(width) if isinstance(width, int) else width
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), F.greatest(n - F.size(parts), F.lit(0)))), F.lit(1), n)


def used_range(cells: DataFrame, sheet: str) -> DataFrame:
    """Per sheet of cells ``(sheet, row_no, col_no, filled)``: the first and last row and column with a filled cell (null without any), and how many are."""
    own = lambda c: F.when(F.col("filled"), F.col(c))
    return cells.groupBy(sheet).agg(
        F.min(own("row_no")).alias("first_row"), F.max(own("row_no")).alias("last_row"), F.min(own("col_no")).alias("first_col"), F.max(own("col_no")).alias("last_col"),
        F.count_if("filled").alias("filled"), F.count("*").alias("cells"),
    )
