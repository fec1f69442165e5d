"""Workbooks as cell tables.

A task opens a package, guards it, and emits the cells of every dataset: each
table of a sheet, else the sheet's used range, else one empty dataset.  Typing,
naming and segments are relational from there on.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.cells import lattice
from docmill.operators import tabular
from docmill.plans.storage import written
from docmill.sources.files import binary
from docmill.sources.packages import XLSX_PARTS, InvalidPackage, opened

# -- fixed values: namespaces, and number formats that are dates ------------------------------
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57}
TIME_FORMATS = {18, 19, 20, 21}
SCHEMA = (
    "file_name string, size_bytes bigint, sheet_index int, sheet string, visibility string, used_range string, dataset string, source_kind string, reference string, has_header boolean, "
    "merged_ranges int, hidden_rows int, hidden_columns int, total_rows_omitted int, external_links int, row_no bigint, col_no int, kind string, json string, cell string, formula string, cached boolean, error string"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def place(reference: str) -> tuple[int, int]:
    """Row and column of a cell reference, from 1."""
    letters, digits = re.match(r"\$?([A-Za-z]+)\$?(\d+)", reference).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return int(digits), col


def letters_of(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def box(reference: str) -> tuple[int, int, int, int]:
    a, _, b = reference.partition(":")
    (r1, c1), (r2, c2) = place(a), place(b or a)
    return r1, c1, r2, c2


def _relations(package, part: str) -> dict[str, tuple[str, str]]:
    folder, name = posixpath.split(part)
    try:
        root = ET.fromstring(package.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    at = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
    return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], at(r.get("Target", ""))) for r in root}


def _styles(package) -> list[str]:
    """Of each cell style: date, time or empty."""
    try:
        root = ET.fromstring(package.read("xl/styles.xml"))
    except KeyError:
        return []
    custom = {}
    for f in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower()
        custom[int(f.get("numFmtId"))] = "date" if re.search("[yd]", code) else "time" if re.search("[hs]", code) else ""
    formats = root.find(f"{MAIN}cellXfs")
    out = []
    for x in formats if formats is not None else ():
        n = int(x.get("numFmtId", "0"))
        out.append(custom.get(n, "date" if n in DATE_FORMATS else "time" if n in TIME_FORMATS else ""))
    return out


def _value(c, shared: list[str], styles: list[str], base: datetime) -> tuple[str, str | None]:
    """Type and JSON literal of a cell element."""
    import json

    v = c.find(f"{MAIN}v")
    t = c.get("t", "n")
    if t == "inlineStr":
        s = "".join(x.text or "" for x in c.iter(f"{MAIN}t"))
        return ("string", json.dumps(s, ensure_ascii=False)) if s else ("empty", None)
    if v is None or v.text is None:
        return "empty", None
    if t == "s":
        return "string", json.dumps(shared[int(v.text)], ensure_ascii=False)
    if t in ("str", "e"):
        return "string", json.dumps(v.text, ensure_ascii=False)
    if t == "b":
        return "boolean", "true" if v.text == "1" else "false"
    if t == "d":
        return ("datetime" if "T" in v.text else "date"), json.dumps(v.text)
    n = float(v.text)
    style = styles[int(c.get("s", "0"))] if c.get("s") and int(c.get("s")) < len(styles) else ""
    if style == "time" or (style and 0 <= n < 1):
        return "time", json.dumps((datetime(1900, 1, 1) + timedelta(seconds=round(n % 1 * 86400))).time().isoformat())
    if style:
        return "datetime", json.dumps((base + timedelta(seconds=round(n * 86400))).isoformat())
    if n.is_integer() and "." not in v.text and "e" not in v.text.lower():
        return "integer", str(int(n))
    return "number", repr(n)


def datasets(name: str, size: int, data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA for one workbook."""
    package = opened(data, XLSX_PARTS)
    names = set(package.namelist())
    external = sum(bool(re.fullmatch(r"xl/externalLinks/externalLink\d+\.xml", n)) for n in names)
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(package.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    styles = _styles(package)
    book = ET.fromstring(package.read("xl/workbook.xml"))
    properties = book.find(f"{MAIN}workbookPr")
    base = datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
    links = _relations(package, "xl/workbook.xml")
    for index, sheet in enumerate(book.iter(f"{MAIN}sheet"), 1):
        kind, part = links.get(sheet.get(LINK), ("", ""))
        if kind != "worksheet":
            continue
        root = ET.fromstring(package.read(part))
        cells = {place(c.get("r")): c for c in root.iter(f"{MAIN}c") if c.get("r")}
        merged = [m.get("ref") for m in root.iter(f"{MAIN}mergeCell")]
        covered = set()
        for r1, c1, r2, c2 in map(box, merged):
            covered |= {(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)} - {(r1, c1)}
        cells = {p: c for p, c in cells.items() if p not in covered}  # only a merged range's corner has a value
        hidden_rows = sum(r.get("hidden") in ("1", "true") for r in root.iter(f"{MAIN}row"))
        hidden_cols = sum(int(c.get("max")) - int(c.get("min")) + 1 for c in root.iter(f"{MAIN}col") if c.get("hidden") in ("1", "true"))
        filled = [p for p, c in cells.items() if (c.find(f"{MAIN}v") is not None or c.find(f"{MAIN}is") is not None or c.find(f"{MAIN}f") is not None)]
        used = None
        if filled:
            rs, cs = [p[0] for p in filled], [p[1] for p in filled]
            used = (min(rs), min(cs), max(rs), max(cs))
        text = lambda b: f"{letters_of(b[1])}{b[0]}:{letters_of(b[3])}{b[2]}"
        head = (name, size, index, sheet.get("name"), {"hidden": "hidden", "veryHidden": "very_hidden"}.get(sheet.get("state"), "visible"), text(used) if used else None)
        counts = (len(merged), hidden_rows, hidden_cols)
        ranges = []
        for kind, part_name in _relations(package, part).values():
            if kind == "table":
                t = ET.fromstring(package.read(part_name))
                ranges.append((t.get("displayName") or t.get("name"), "excel_table", box(t.get("ref")), t.get("headerRowCount", "1") != "0", int(t.get("totalsRowCount", "0"))))
        if not ranges and used:
            row = [_value(cells[used[0], c], shared, styles, base) if (used[0], c) in cells else ("empty", None) for c in range(used[1], used[3] + 1)]
            words = [j for k, j in row if k == "string" and j.strip('"').strip()]
            ranges.append((sheet.get("name"), "worksheet_range", used, len(words) == len(row) and len({w.casefold() for w in words}) == len(row), 0))
        for title, source, b, has_header, totals in ranges:
            yield from _range(head, counts, external, title, source, text(b), b, has_header, totals, cells, shared, styles, base)
        if not ranges:
            yield (*head, sheet.get("name"), "worksheet_range", None, False, *counts, 0, external, *[None] * 7, None)


def _range(head, counts, external, title, source, reference, b, has_header, totals, cells, shared, styles, base) -> Iterator[tuple]:
    fixed = (*head, title, source, reference, has_header, *counts, totals, external)
    for r in range(b[0], b[2] + 1 - totals):
        row_no = r - b[0] + (0 if has_header else 1)  # the header is row 0
        for c in range(b[1], b[3] + 1):
            e = cells.get((r, c))
            kind, json = _value(e, shared, styles, base) if e is not None else ("empty", None)
            f = e.find(f"{MAIN}f") if e is not None else None
            formula = None if f is None else f"={(f.text or '').removeprefix('=')}"
            yield (*fixed, row_no, c - b[1] + 1, kind, json, f"{letters_of(c)}{r}", formula, None if f is None else json is not None, None)


def cells(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The cell table of all workbooks; a file that cannot be read gives one row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, size, content in zip(batch["file_name"], batch["size_bytes"], batch["content"], strict=True):
                held = []
                try:
                    for row in datasets(name, size, bytes(content)):
                        held.append(row)
                        if len(held) == 20_000:
                            yield pd.DataFrame(held, columns=COLUMNS)
                            held = []
                except (InvalidPackage, ET.ParseError, KeyError, ValueError, AttributeError) as e:
                    held.append((name, size, *[None] * (len(COLUMNS) - 3), type(e).__name__))
                yield pd.DataFrame(held, columns=COLUMNS).astype(object).where(lambda d: d.notna(), None)

    return binary(spark, path, glob).select("file_name", "size_bytes", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, glob: str | None = None, per_segment: int = 1000) -> dict[str, DataFrame]:
    """Relations of all workbooks: ``datasets``, ``columns``, ``segments``, ``formulas`` and ``errors``."""
    table = written(cells(spark, path, glob), "xlsx")
    key = ["file_name", "sheet_index", "sheet", "dataset"]
    good = table.where("error is null")
    body = good.where("row_no >= 1")
    info = good.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("visibility", "used_range", "source_kind", "reference", "has_header", "merged_ranges", "hidden_rows", "hidden_columns", "total_rows_omitted", "external_links")],
        F.coalesce(F.max("row_no"), F.lit(0)).alias("total_rows"), F.count_if(F.col("formula").isNotNull() & (F.col("row_no") >= 1)).alias("formula_cells"), F.count_if(~F.col("cached")).alias("without_cache"),
    )
    notes = F.array_compact(F.array(
        F.when(F.col("visibility") != "visible", F.concat(F.lit("xlsx_hidden_sheet_included:"), "sheet")), F.when(F.col("external_links") > 0, F.concat(F.lit("xlsx_external_links_not_followed:"), "external_links")),
        F.when(F.col("used_range").isNull(), "xlsx_empty_sheet"), F.when(F.col("without_cache") > 0, F.concat(F.lit("xlsx_formulas_without_cached_value:"), "without_cache")),
        F.when(F.col("total_rows_omitted") > 0, F.concat(F.lit("xlsx_table_total_rows_omitted:"), "total_rows_omitted")),
    ))
    wide = [*key[:2], "dataset"]
    one_key = F.concat_ws(":", F.col("file_name"), F.col("sheet_index").cast("string"), F.col("dataset"))
    names = tabular.named_columns(good.where("col_no is not null").withColumn("d", one_key).groupBy("d", "col_no").agg(F.max(F.when(F.col("row_no") == 0, F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v"))).alias("source_name")).withColumnRenamed("d", "dataset"))
    types = body.groupBy(*wide, "col_no").agg(lattice(F.collect_set("kind")).alias("inferred_type"), F.bool_or(F.col("kind") == "empty").alias("nullable"))
    columns = types.withColumn("d", one_key).join(names.select(F.col("dataset").alias("d"), "col_no", "name", "source_name"), ["d", "col_no"]).drop("d")
    each = body.groupBy(*wide, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "json"))).alias("c"))
    rows = each.select(*wide, "row_no", F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: F.coalesce(x["json"], F.lit("null"))), ","), F.lit("]")).alias("row"))
    segment = F.floor((F.col("row_no") - 1) / per_segment).cast("bigint") + 1
    segments = rows.groupBy(*wide, segment.alias("segment")).agg(F.min("row_no").alias("row_start"), F.max("row_no").alias("row_end"), F.array_sort(F.collect_list(F.struct("row_no", "row"))).alias("r"))
    segments = segments.withColumn("rows", F.transform("r", lambda x: x["row"])).drop("r")
    formulas = body.where("formula is not null").select(*wide, segment.alias("segment"), "row_no", F.col("cell").alias("cell_reference"), "formula", F.when(F.col("cached"), F.col("json")).alias("cached_value"))
    return {"datasets": info.withColumn("warnings", notes), "columns": columns, "segments": segments, "formulas": formulas, "errors": table.where("error is not null").select("file_name", "error")}
