"""Plain text and Markdown files as ``text_document`` records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docmill.functions.decoding import decoded
from docmill.functions.text import cleaned
from docmill.operators import structure
from docmill.sources.files import binary, envelope, processing

HEADINGS = ArrayType(StructType([StructField("level", IntegerType()), StructField("text", StringType()), StructField("line_number", IntegerType())]))
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
NO_PARAGRAPH = re.compile(r"^ {0,3}(?:>|[-*+][ \t]|\d{1,9}[.)][ \t]|(?:[-*_][ \t]*){3,}$|<[a-zA-Z/!?])")


def markdown_headings(text: str) -> list[tuple[int, str, int]]:
    """Block-level headings of a Markdown text: ATX and setext, not within code."""
    out: list[tuple[int, str, int]] = []
    fence, paragraph, start = None, [], 0
    for n, line in enumerate(text.split("\n"), 1):
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
            continue
        if mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence, paragraph = mark[1], []
            continue
        atx, under = ATX.match(line), SETEXT.match(line)
        if atx:
            out.append((len(atx[1]), (atx[2] or "").strip(), n))
            paragraph = []
        elif under and paragraph:
            out.append((1 if under[1][0] == "=" else 2, "\n".join(paragraph).strip(), start))
            paragraph = []
        elif not line.strip() or NO_PARAGRAPH.match(line) or (not paragraph and line.startswith(("    ", "\t"))):
            paragraph = []
        else:
            start = start if paragraph else n
            paragraph.append(line.strip())
    return out


@F.pandas_udf(HEADINGS)
def markdown_outline(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"level": a, "text": b, "line_number": c} for a, b, c in markdown_headings(t or "")])


def read(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One record a file; ``.md`` and ``.markdown`` are Markdown, all else plain text.

    Markdown and plain files take separate branches, so that the Python outline
    sees Markdown only.
    """
    files = binary(spark, path, glob)
    opened = files.withColumn("d", decoded(F.col("content"))).drop("content")
    ready = opened.withColumn("text", cleaned(F.col("d.content"))).withColumn("markdown", F.lower("file_name").rlike(r"\.(md|markdown)$"))
    lined = structure.with_lines(ready)
    plain = structure.with_headings(ready.where("not markdown"))
    marked = lined.where("markdown").withColumn("headings", markdown_outline("text"))
    kind = "array<struct<level:int,text:string,line_number:int>>"
    both = plain.withColumn("headings", F.col("headings").cast(kind)).unionByName(marked.withColumn("headings", F.col("headings").cast(kind)))
    data = F.struct(
        F.get("headings", F.lit(0))["text"].alias("title"), F.col("d.encoding").alias("encoding"), F.when(F.col("markdown"), "markdown").otherwise("plain_text").alias("content_format"),
        F.col("text").alias("content"), "headings", structure.sections(F.col("text"), F.col("lines"), F.col("headings")).alias("sections"),
    )
    return both.select(*envelope("text_document", "text", "text", data, processing(F.col("d.warnings"))))
