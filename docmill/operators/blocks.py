"""Blocks of rich documents: sections by level, list islands, tables and page units."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.plans.storage import written


def sections_by_level(blocks: DataFrame) -> DataFrame:
    """Sections of blocks ``(doc, idx, level, text)`` with a null level for plain blocks.

    A heading reaches to just before the next heading of its level or a lower
    one.  Headings of a document are one array, so the look-ahead is within a row;
    blocks that are no headings only give the document's end.
    """
    heads = F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("idx", "level", "text"))))
    per_doc = blocks.groupBy("doc").agg(heads.alias("heads"), F.max("idx").alias("last"))
    end = lambda h: F.array_min(F.transform(F.filter("heads", lambda x: (x["idx"] > h["idx"]) & (x["level"] <= h["level"])), lambda x: x["idx"]))
    made = F.transform("heads", lambda h: F.struct(h["text"].alias("title"), h["level"].alias("level"), h["idx"].alias("start_block"), F.coalesce(end(h) - 1, F.col("last")).alias("end_block")))
    return per_doc.select("doc", F.inline(made))


def list_islands(blocks: DataFrame) -> DataFrame:
    """Runs of list items of ``(doc, idx, kind)``: ``(doc, start_block, end_block, items)``."""
    n = F.row_number().over(Window.partitionBy("doc").orderBy("idx"))
    items = blocks.where("kind = 'list_item'").withColumn("island", F.col("idx") - n)
    return items.groupBy("doc", "island").agg(F.min("idx").alias("start_block"), F.max("idx").alias("end_block"), F.count("*").alias("items")).drop("island")


def list_item(text: Column, level: Column, ordered: Column) -> Column:
    mark = F.when(ordered, "1.").otherwise("-")
    return F.concat(F.repeat(F.lit("    "), F.greatest(level, F.lit(0))), mark, F.lit(" "), F.translate(text, "\r\n", "  "))


def table_cell(c: Column) -> Column:
    escaped = F.replace(c, F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(escaped, F.lit("\r\n"), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))


def table_markdown(rows: Column, has_header: Column) -> Column:
    """A table (``array<array<string>>``) in Markdown; rows are padded, missing headers numbered."""
    width = F.array_max(F.transform(rows, F.size))
    filled = F.transform(rows, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), table_cell))
    numbered = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Coluna "), i.cast("string")))
    head = F.when(has_header, F.get(filled, F.lit(0))).otherwise(numbered)
    body = F.when(has_header, F.slice(filled, F.lit(2), F.size(filled))).otherwise(filled)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.coalesce(width, F.lit(0)) > 0, F.array_join(F.concat(F.array(line(head), rule), F.transform(body, line)), "\n")).otherwise("_Tabela vazia._")


def page_unit(number: Column, text: Column, segment: Column, segments: Column) -> Column:
    """A page in Markdown; a page without text says so."""
    part = F.when(segment.isNotNull() & segments.isNotNull(), F.format_string(" — trecho %d/%d", segment, segments)).otherwise("")
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    body = F.when(bare != "", bare).otherwise("_Nenhum texto incorporado foi extraído desta página. OCR não foi aplicado._")
    return F.concat(F.lit("## Página "), F.coalesce(number, F.lit(0)).cast("string"), part, F.lit("\n\n"), body)


def page_notes(first: Column, last: Column, images: Column, files: Column) -> Column:
    """The note of a part of pages: their range, images and files left out."""
    notes = F.array_compact(F.array(
        F.when(first.isNotNull(), F.format_string("Páginas %d–%d", first, last)),
        F.when(images > 0, F.format_string("%d imagem(ns) não extraída(s)", images)),
        F.when(files > 0, F.format_string("%d arquivo(s) incorporado(s) não extraído(s)", files)),
    ))
    return F.when(F.size(notes) > 0, F.concat(F.lit("\n> "), F.array_join(notes, "; "), F.lit("."))).otherwise("")


def group_pages(units: DataFrame, max_bytes: int) -> DataFrame:
    """Greedy groups of rendered pages ``(doc, page, bytes)``: adds ``part`` from 1.

    A document's pages are folded within one row; two bytes part neighbours.
    """
    pages = F.array_sort(F.collect_list(F.struct("page", "bytes")))
    per_doc = units.groupBy("doc").agg(pages.alias("pages"))
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("part"), F.array().cast("array<struct<page:bigint,part:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        joins = (acc["part"] > 0) & (acc["held"] + p["bytes"] + 2 <= max_bytes)
        part = F.when(joins, acc["part"]).otherwise(acc["part"] + 1)
        return F.struct(
            F.when(joins, acc["held"] + p["bytes"] + 2).otherwise(p["bytes"]).alias("held"), part.alias("part"),
            F.concat(acc["out"], F.array(F.struct(p["page"].cast("bigint").alias("page"), part.alias("part")))).alias("out"),
        )

    return per_doc.select("doc", F.inline(F.aggregate("pages", start, step, lambda a: a["out"])))


def outline_depths(nodes: DataFrame) -> DataFrame:
    """Depth of each node of an adjacency table ``(doc, node, parent)``, level by level, to any depth.

    Every round joins the last level only, a written table, so plans stay small;
    nodes that no root leads to have no depth.
    """
    nodes = written(nodes.select("doc", "node", "parent"), "nodes")
    level, levels, depth = written(nodes.where("parent is null").select("doc", "node", F.lit(1).alias("depth")), "level"), [], 1
    while not level.isEmpty():
        levels.append(level)
        depth += 1
        level = written(nodes.join(level.select("doc", F.col("node").alias("parent")), ["doc", "parent"]).select("doc", "node", F.lit(depth).alias("depth")), "level")
    return functools.reduce(DataFrame.union, levels, level)
