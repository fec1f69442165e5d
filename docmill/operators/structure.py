"""Lines, headings, sections and Markdown bodies of plain texts.

A document's structure is worked out within its own row: lines are an array,
the heading rules are array expressions over a line and its neighbours, and
sections are slices between headings.  So nothing is shuffled and a document is
never split between tasks; ``exploded`` forms are there for line-wise work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import lines, stripped

# -- fixed values of the heading rules ----------------------------------------------------
ATX = r"(?U)^\s*(#{1,6})\s+(.+?)\s*#*\s*$"
UNDERLINE = r"(?U)^\s*(={3,}|-{3,})\s*$"
NUMBERED = r"(?U)^\s*(\d+(?:\.\d+)*\.)\s+(.+?)\s*$"
CLOSING = (".", "!", "?", ":", ";")
SHORTEST, LONGEST, MOST_WORDS = 3, 100, 12


def _line(found: Column, i: Column) -> Column:
    return F.coalesce(F.get(found, i), F.lit(""))


def _rule(found: Column, bare: Column, i: Column) -> Column:
    """Which rule makes line i (from 0) a heading, as far as neighbours decide it.

    A look at a line's first character or at its length spares most lines the patterns.
    """
    own, first = _line(bare, i), F.substring(_line(bare, i), 1, 1)
    upper = (
        F.length(own).between(SHORTEST, LONGEST)
        & (own == F.upper(own))
        & ((i == 0) | (_line(bare, i - 1) == ""))
        & ((i == F.size(found) - 1) | (_line(bare, i + 1) == ""))
        & ~F.substring(own, -1, 1).isin(*CLOSING)
        & own.rlike(r"\p{L}")
        & (F.size(F.split(own, r"(?U)\s+")) <= MOST_WORDS)
    )
    return (
        F.when(own == "", "none")
        .when((first == "#") & _line(found, i).rlike(ATX), "atx")
        .when(F.substring(_line(bare, i + 1), 1, 1).isin("=", "-") & _line(found, i + 1).rlike(UNDERLINE), "underlined")
        .when(first.rlike(r"(?U)\d") & _line(found, i).rlike(NUMBERED), "numbered")
        .when(upper, "upper")
        .otherwise("none")
    )


def headings(found: Column, bare: Column) -> Column:
    """``array<struct<level, text, line_number>>`` of a plain text's lines, and the same lines stripped.

    Both should be columns of their own, so that lines are split and stripped once.
    An underline that an underlined heading has used is no heading itself, so rules
    are applied in order with the used line carried along.
    """
    at = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    # only lines that could be headings go through the fold
    ruled = F.filter(F.transform(at, lambda i: F.struct(i.alias("i"), _rule(found, bare, i).alias("rule"))), lambda r: r["rule"] != "none")
    none = F.array().cast("array<struct<i:int,rule:string>>")
    kept = F.aggregate(
        ruled,
        F.struct(F.lit(-1).alias("used"), none.alias("out")),
        lambda acc, r: F.when(acc["used"] == r["i"], F.struct(F.lit(-1).alias("used"), acc["out"].alias("out"))).otherwise(
            F.struct(F.when(r["rule"] == "underlined", r["i"] + 1).otherwise(-1).alias("used"), F.concat(acc["out"], F.array(r)).alias("out"))
        ),
        lambda acc: acc["out"],
    )

    def made(r: Column) -> Column:
        line = _line(found, r["i"])
        number = F.regexp_extract(line, NUMBERED, 1)
        level = (
            F.when(r["rule"] == "atx", F.length(F.regexp_extract(line, ATX, 1)))
            .when(r["rule"] == "underlined", F.when(F.startswith(stripped(_line(found, r["i"] + 1)), F.lit("=")), 1).otherwise(2))
            .when(r["rule"] == "numbered", F.least(F.lit(6), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))))
            .otherwise(1)
        )
        title = F.when(r["rule"] == "atx", F.regexp_extract(line, ATX, 2)).otherwise(stripped(line))
        return F.struct(level.cast("int").alias("level"), title.alias("text"), (r["i"] + 1).cast("int").alias("line_number"))

    return F.transform(kept, made)


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("lines", lines(F.coalesce(F.col(text), F.lit(""))))


def with_headings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lines`` and ``headings``."""
    both = with_lines(docs, text).withColumn("bare_", F.transform("lines", stripped))
    return both.withColumn("headings", headings(F.col("lines"), F.col("bare_"))).drop("bare_")


def sections(text: Column, all_: Column, found: Column) -> Column:
    """``array<struct<title, level, content, start_line, end_line>>`` between headings of a text and its lines."""
    n = F.size(all_)
    body = lambda a, b: stripped(F.array_join(F.when(b >= a, F.slice(all_, a, F.greatest(b - a + 1, F.lit(0)))).otherwise(F.array().cast("array<string>")), "\n"))

    def section(title: Column, level: Column, content: Column, start: Column, end: Column) -> Column:
        return F.struct(title.cast("string").alias("title"), level.cast("int").alias("level"), content.alias("content"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))

    null = F.lit(None)
    whole = F.array(section(null, null, stripped(F.coalesce(text, F.lit(""))), F.lit(1), n))
    first = F.get(found, F.lit(0))["line_number"]
    preamble = body(F.lit(1), first - 1)
    start = F.when((first > 1) & (preamble != ""), F.array(section(null, null, preamble, F.lit(1), first - 1))).otherwise(F.array().cast("array<struct<title:string,level:int,content:string,start_line:int,end_line:int>>"))

    def of(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get(found, i + 1)["line_number"] - 1, n)
        begin = h["line_number"] + 1
        begin = begin + F.when(_line(all_, begin - 1).rlike(UNDERLINE), 1).otherwise(0)
        return section(h["text"], h["level"], body(begin, end), h["line_number"], end)

    return F.when(n == 0, F.array().cast("array<struct<title:string,level:int,content:string,start_line:int,end_line:int>>")).when(F.size(found) == 0, whole).otherwise(F.concat(start, F.transform(found, of)))


def markdown_body(text: Column, all_: Column, found: Column) -> Column:
    """The text with its headings as ``#`` lines; used underlines go, a final line break stays."""
    starts = F.map_from_arrays(F.transform(found, lambda h: h["line_number"]), F.transform(found, lambda h: F.concat(F.repeat(F.lit("#"), F.least(F.greatest(h["level"], F.lit(1)), F.lit(6))), F.lit(" "), h["text"])))

    def of(line: Column, i: Column) -> Column:
        own = F.element_at(starts, i + 1)
        after = F.element_at(starts, i).isNotNull() & line.rlike(UNDERLINE)
        return F.coalesce(own, F.when(~F.coalesce(after, F.lit(False)), line))

    kept = F.filter(F.transform(all_, of), lambda x: x.isNotNull())
    return F.concat(F.array_join(kept, "\n"), F.when(text.rlike(r"[\n\r]\z"), "\n").otherwise(""))


def part_header(name: Column, number: Column, count: Column, start: Column, end: Column) -> Column:
    """The line that says where a part comes from."""
    source = F.concat(F.lit("> Fonte: "), F.when(F.coalesce(name, F.lit("")) != "", name).otherwise("não informada"))
    part = F.format_string(" — parte %d/%d (linhas %d–%d)", number, count, start, end)
    return F.concat(source, F.when(number.isNotNull() & count.isNotNull(), part).otherwise(""))


def outline(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row a heading: ``(key, level, text, line_number)``."""
    # inline_outer: the filter that Spark derives from inline would be pushed below and work out the headings again
    return with_headings(docs, text).select(key, F.inline_outer("headings")).where("line_number is not null")
