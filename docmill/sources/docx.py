"""Word documents as blocks.

A task reads a package and emits facts: a paragraph's text, styles, numbering,
boldness and size; a table's rows and marks.  What is a heading, a list item or a
header row follows from these facts by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import cleaned, mojibake, stripped
from docmill.operators import blocks
from docmill.plans.storage import written
from docmill.sources.files import binary
from docmill.sources.packages import DOCX_PARTS, InvalidPackage, opened

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CELL = "struct<text:string,bold:boolean,shaded:boolean>"
SCHEMA = (
    "file_name string, size_bytes bigint, idx int, tag string, text string, style string, style_id string, outline int, numbered boolean, num_level int, num_ordered boolean, "
    f"inherited boolean, bold boolean, size double, rows array<array<{CELL}>>, header_mark boolean, meta_title string, meta_author string, images int, headers_footers boolean, features array<string>, error string"
)
COLUMNS = [x.split()[0] for x in re.sub(r"<.*?>>>", "", SCHEMA).split(", ")]
# -- fixed values: features left out, in the order they are named, and where they show ---------
FEATURE_PARTS = (
    ("footnotes", r"word/footnotes\.xml"), ("endnotes", r"word/endnotes\.xml"), ("comments", r"word/comments\.xml"), ("charts", r"word/charts/.+"), ("embedded_objects", r"word/embeddings/.+"),
    ("diagrams", r"word/diagrams/.+"), ("macros", r"word/vbaProject\.bin"),
)
FEATURE_TAGS = (("tracked_changes", ("ins", "del")), ("text_boxes", ("txbxContent",)))
HEADING_NAME, HEADING_ID = r"(?iU)^(?:Heading|Título)\s*([1-9])$", r"(?i)^Heading([1-9])$"
NUMBERED_START = r"(?U)^\s*(\d+(?:\.\d+)*)(?:[.)])?\s+\S"


class Package:
    """What is needed of a document's parts."""

    def __init__(self, data: bytes) -> None:
        self.zip = opened(data, DOCX_PARTS, encrypted_ok=True)
        self.names = self.zip.namelist()
        self.body = self._part("word/document.xml").find(f"{W}body")
        self.styles = {s.get(f"{W}styleId"): s for s in (self._part("word/styles.xml") if "word/styles.xml" in self.names else ()) if s.tag == f"{W}style"}
        self.default = next((i for i, s in self.styles.items() if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true")), None)
        numbering = self._part("word/numbering.xml") if "word/numbering.xml" in self.names else ()
        bullets = {(a.get(f"{W}abstractNumId"), v.get(f"{W}ilvl")): _val(v.find(f"{W}numFmt")) == "bullet" for a in numbering if a.tag == f"{W}abstractNum" for v in a.iter(f"{W}lvl")}
        self.abstract = {n.get(f"{W}numId"): _val(n.find(f"{W}abstractNumId")) for n in numbering if n.tag == f"{W}num"}
        self.bullets = bullets

    def _part(self, name: str) -> ET.Element:
        return ET.fromstring(self.zip.read(name))

    def chain(self, style: str | None) -> Iterator[ET.Element]:
        """A style and those it is based on."""
        seen = set()
        while style in self.styles and style not in seen:
            seen.add(style)
            yield self.styles[style]
            style = _val(self.styles[style].find(f"{W}basedOn"))

    def ordered(self, number: str | None, level: int) -> bool:
        return not self.bullets.get((self.abstract.get(number), str(level)), False)

    def numbering(self, properties: ET.Element | None) -> tuple[int, bool] | None:
        n = properties.find(f"{W}numPr") if properties is not None else None
        if n is None:
            return None
        level = int(_val(n.find(f"{W}ilvl")) or 0)
        return level, self.ordered(_val(n.find(f"{W}numId")), level)

    def facts(self, p: ET.Element) -> tuple:
        """Facts of a paragraph, from its text to its size."""
        props = p.find(f"{W}pPr")
        style_id = (_val(props.find(f"{W}pStyle")) if props is not None else None) or self.default
        styles = list(self.chain(style_id))
        name = _val(styles[0].find(f"{W}name")) if styles else None
        all_props = [x for x in (props, *(s.find(f"{W}pPr") for s in styles)) if x is not None]
        outline = next((int(v) for x in all_props if (v := _val(x.find(f"{W}outlineLvl"))) and v.isdigit()), None)
        direct = self.numbering(props)
        inherited = next((n for s in styles if (n := self.numbering(s.find(f"{W}pPr")))), None)
        number = direct or inherited
        runs = [r for r in p.iter(f"{W}r") if _text(r).strip()]
        style_fonts = [f for s in styles if (f := s.find(f"{W}rPr")) is not None]
        bold = bool(runs) and all(self.is_bold(r, style_fonts) for r in runs)
        sizes = [s for r in runs if (s := _size(r.find(f"{W}rPr")))] or [s for f in style_fonts if (s := _size(f))][:1]
        return (_text(p), name.title() if name and name.lower() == name and name != "normal" else name, style_id, outline, number is not None, number[0] if number else None, number[1] if number else None, direct is None, bold, max(sizes, default=0.0))

    def is_bold(self, run: ET.Element, style_fonts: list[ET.Element]) -> bool:
        own = run.find(f"{W}rPr")
        styled = [f for s in self.chain(_val(own.find(f"{W}rStyle")) if own is not None else None) if (f := s.find(f"{W}rPr")) is not None]
        for f in (own, *styled, *style_fonts):
            b = f.find(f"{W}b") if f is not None else None
            if b is not None:
                return b.get(f"{W}val", "1") not in ("0", "false", "off")
        return False

    def table(self, t: ET.Element) -> tuple[list, bool]:
        rows = []
        for tr in t.findall(f"{W}tr"):
            row = []
            for tc in tr.findall(f"{W}tc"):
                ps = tc.findall(f"{W}p")
                shade = tc.find(f"{W}tcPr/{W}shd")
                fill = (shade.get(f"{W}fill") or "").lower() if shade is not None else ""
                texts = [x for p in ps if (x := _text(p).strip())]
                filled = [p for p in ps if _text(p).strip()]
                cell = {"text": "\n".join(texts), "bold": all(self.facts(p)[8] for p in filled) if filled else None, "shaded": fill not in ("", "auto", "none", "ffffff")}
                span = tc.find(f"{W}tcPr/{W}gridSpan")
                row += [cell] * (int(_val(span)) if span is not None else 1)
            rows.append(row)
        first = t.find(f"{W}tr")
        marked = first is not None and first.find(f"{W}trPr/{W}tblHeader") is not None
        look = t.find(f"{W}tblPr/{W}tblLook")
        return rows, marked or (look is not None and look.get(f"{W}firstRow") in ("1", "true"))

    def about(self) -> tuple:
        """Title, author, images, whether there are headers or footers with text, and features."""
        title = author = None
        if "docProps/core.xml" in self.names:
            for e in self._part("docProps/core.xml"):
                title = (e.text or "").strip() or None if e.tag.endswith("}title") else title
                author = (e.text or "").strip() or None if e.tag.endswith("}creator") else author
        images = sum(bool(re.fullmatch(r"word/media/.+", n)) for n in self.names)
        edges = any(_text(self._part(n)).strip() for n in self.names if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
        tags = {e.tag.rsplit("}", 1)[-1] for e in self.body.iter()}
        found = [f for f, pattern in FEATURE_PARTS if any(re.fullmatch(pattern, n) for n in self.names)]
        nested = any(tc.find(f"{W}tbl") is not None for tc in self.body.iter(f"{W}tc"))
        found += ["nested_tables"] if nested else []
        found += [f for f, names in FEATURE_TAGS if tags & set(names)]
        found += ["equations"] if tags & {"oMath", "oMathPara"} else []
        return title, author, images, edges, found


def _val(e: ET.Element | None) -> str | None:
    return e.get(f"{W}val") if e is not None else None


def _text(e: ET.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join((x.text or "") if x.tag == f"{W}t" else marks.get(x.tag, "") for x in e.iter())


def _size(fonts: ET.Element | None) -> float:
    v = _val(fonts.find(f"{W}sz")) if fonts is not None else None
    return int(v) / 2 if v and v.isdigit() else 0.0


def _rows(name: str, size: int, data: bytes) -> Iterator[tuple]:
    package = Package(data)
    about = package.about()
    yield (name, size, -1, "about", *[None] * 12, *about, None)
    for i, e in enumerate(package.body):
        if e.tag == f"{W}p":
            yield (name, size, i, "p", *package.facts(e), None, None, *[None] * 5, None)
        elif e.tag == f"{W}tbl":
            rows, marked = package.table(e)
            yield (name, size, i, "t", *[None] * 10, rows, marked, *[None] * 5, None)


def facts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The facts of all documents; a file that cannot be read gives one row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, size, content in zip(batch["file_name"], batch["size_bytes"], batch["content"], strict=True):
                try:
                    held = list(_rows(name, size, bytes(content)))
                except (InvalidPackage, ET.ParseError, KeyError, ValueError, AttributeError) as e:
                    held = [(name, size, *[None] * (len(COLUMNS) - 3), type(e).__name__)]
                yield pd.DataFrame(held, columns=COLUMNS).astype(object).where(lambda d: d.notna(), None)

    return binary(spark, path, glob).select("file_name", "size_bytes", "content").mapInPandas(run, SCHEMA)


def heading_level() -> Column:
    """Level by style, else by outline level."""
    styled = F.coalesce(F.nullif(F.regexp_extract("style_id", HEADING_ID, 1), F.lit("")), F.nullif(F.regexp_extract("style", HEADING_NAME, 1), F.lit("")))
    return F.coalesce(styled.cast("int"), F.when(F.col("outline") < 9, F.col("outline") + 1))


def list_info() -> Column:
    """``struct<level, ordered>``: direct numbering, then a list style's name, then inherited numbering."""
    label = F.lower(F.concat_ws(" ", "style", "style_id"))
    listed = label.rlike("list|lista")
    ordered = F.when(listed & label.rlike("bullet|marcador"), False).when(listed & label.rlike("number|número|numero"), True)
    suffix = F.regexp_extract(F.concat_ws(" ", "style", "style_id"), "([2-9])$", 1)
    level = F.coalesce(F.nullif(suffix, F.lit("")).cast("int") - 1, F.lit(0))
    number = F.struct(F.col("num_level").alias("level"), F.col("num_ordered").alias("ordered"))
    return F.when(F.col("numbered") & ~F.col("inherited"), number).when(ordered.isNotNull(), F.struct(level.alias("level"), ordered.alias("ordered"))).when(F.col("numbered"), number)


def inferred_level(text: Column) -> Column:
    """Level of a bold paragraph that reads like a heading: by its number, or by its size."""
    able = ~F.coalesce(F.col("style_id").isin("Title", "Subtitle"), F.lit(False)) & ~F.contains(text, F.lit("\n")) & (F.length(text) <= 160) & F.col("bold")
    number = F.nullif(F.regexp_extract(text, NUMBERED_START, 1), F.lit(""))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(able, F.when(number.isNotNull(), F.least(dots + 1, F.lit(6))).when((F.length(text) <= 120) & (F.col("size") >= 14), 1))


def header_inferred() -> Column:
    """Does a table's first row look like a header though nothing marks it?"""
    first = F.get("rows", F.lit(0))
    text = F.transform(first, lambda c: F.regexp_replace(c["text"], r"(?U)\s+", " "))
    short = F.forall(text, lambda t: (t != "") & (F.length(t) <= 60) & (F.size(F.split(t, " ")) <= 6) & ~F.substring(t, -1, 1).isin(".", "?", "!", ";", ":"))
    one_line = F.forall(first, lambda c: ~F.contains(c["text"], F.lit("\n")))
    unique = F.size(F.array_distinct(F.transform(text, F.lower))) == F.size(first)
    styled = F.forall(first, lambda c: F.coalesce(c["bold"], F.lit(True))) | F.forall(first, lambda c: c["shaded"])
    longest = F.array_max(F.transform(text, F.length))
    body = F.transform(F.flatten(F.slice("rows", F.lit(2), F.size("rows"))), lambda c: F.regexp_replace(c["text"], r"(?U)\s+", " "))
    long_ = F.exists(body, lambda t: (t != "") & ((F.length(t) > F.greatest(F.lit(32), longest * 2)) | (F.size(F.split(t, " ")) > 7)))
    return F.coalesce((F.size("rows") >= 2) & (F.size(first) >= 2) & short & one_line & unique & (styled | long_), F.lit(False))


def read(spark: SparkSession, path: str, glob: str | None = None) -> dict[str, DataFrame]:
    """Relations: ``blocks``, ``sections``, ``documents`` (title, author, counts, warnings) and ``errors``."""
    raw = written(facts(spark, path, glob), "docx")
    text = stripped(cleaned(F.coalesce("text", F.lit(""))))
    some = raw.where("tag in ('p', 't')").withColumn("text", text)
    marked = some.withColumn("explicit", heading_level()).withColumn("list", list_info())
    marked = marked.withColumn("guess", F.when(F.col("list").isNull(), inferred_level(F.col("text")))).withColumn("guessed", header_inferred())
    kept = marked.where(((F.col("tag") == "p") & (F.col("text") != "")) | ((F.col("tag") == "t") & F.exists(F.flatten("rows"), lambda c: c["text"] != "")))
    table = F.col("tag") == "t"
    kind = F.when(table, "table").when(F.col("explicit").isNotNull(), "heading").when(F.col("list").isNotNull(), "list_item").when(F.col("guess").isNotNull(), "heading").otherwise("paragraph")
    order = F.expr("row_number() over (partition by file_name order by idx) - 1")
    found = kept.withColumn("type", kind).withColumn("block", order).select(
        "file_name", "size_bytes", "block", "type", "text", F.when(F.col("type") == "paragraph", F.col("style")).alias("style"),
        F.when(F.col("type") == "heading", F.coalesce("explicit", "guess")).when(F.col("type") == "list_item", F.col("list.level")).alias("level"), F.when(F.col("type") == "list_item", F.col("list.ordered")).alias("ordered"),
        ((F.col("type") == "heading") & F.col("explicit").isNull()).alias("inferred"), F.transform("rows", lambda r: F.transform(r, lambda c: c["text"])).alias("rows"),
        F.when(table, F.col("header_mark") | F.col("guessed")).alias("has_header"), F.when(table, ~F.col("header_mark") & F.col("guessed")).alias("header_inferred"),
    )
    found = written(found, "blocks")
    sections = blocks.sections_by_level(found.select(F.col("file_name").alias("doc"), F.col("block").alias("idx"), F.when(F.col("type") == "heading", F.col("level")).alias("level"), "text")).withColumnRenamed("doc", "file_name")
    suspicious = F.when(F.col("type") == "table", F.aggregate(F.flatten("rows"), F.lit(0), lambda a, c: a + mojibake(c))).otherwise(mojibake(F.col("text")))
    counts = found.groupBy("file_name").agg(
        *[F.count_if(F.col("type") == t).alias(n) for t, n in (("paragraph", "paragraphs"), ("heading", "headings"), ("list_item", "list_items"), ("table", "tables"))],
        F.count_if("inferred").alias("inferred_headings"), F.count_if("header_inferred").alias("inferred_table_headers"), F.sum(suspicious).alias("suspicious_text_sequences"),
        F.min_by("text", F.when((F.col("type") == "paragraph") & (F.col("style") == "Title"), F.col("block"))).alias("t1"),
        F.min_by("text", F.when((F.col("type") == "heading") & (F.col("level") == 1), F.col("block"))).alias("t2"),
    )
    about = raw.where("tag = 'about'").select("file_name", "size_bytes", "meta_title", "meta_author", "images", "headers_footers", "features")
    docs = about.join(counts, "file_name", "left")
    notes = F.array_compact(F.concat(
        F.array(F.when(F.col("images") > 0, F.concat(F.lit("word_images_omitted:"), "images")), F.when(F.col("headers_footers"), "word_headers_footers_omitted")),
        F.transform("features", lambda f: F.concat(F.lit("word_feature_omitted:"), f)),
        F.array(F.when(F.col("suspicious_text_sequences") > 0, F.concat(F.lit("word_suspected_text_encoding_corruption:"), "suspicious_text_sequences")), F.when(F.col("paragraphs").isNull(), "word_document_without_extractable_blocks")),
    ))
    docs = docs.withColumn("title", F.coalesce("meta_title", "t1", "t2")).withColumn("warnings", notes).withColumnRenamed("meta_author", "author").drop("meta_title", "t1", "t2")
    return {"blocks": found, "sections": sections, "documents": docs, "errors": raw.where("error is not null").select("file_name", "error")}


def markdown(found: DataFrame) -> DataFrame:
    """Render units of blocks: ``(file_name, block_start, block_end, kind, text)``, runs of list items as one."""
    head = F.concat(F.repeat(F.lit("#"), F.least(F.greatest("level", F.lit(1)), F.lit(6))), F.lit(" "), "text")
    body = F.when(F.col("style") == "Title", F.concat(F.lit("# "), "text")).when(F.col("style") == "Subtitle", F.concat(F.lit("_"), "text", F.lit("_"))).otherwise(F.col("text"))
    line = (
        F.when(F.col("type") == "heading", head).when(F.col("type") == "list_item", blocks.list_item(F.col("text"), F.col("level"), F.col("ordered")))
        .when(F.col("type") == "table", blocks.table_markdown(F.col("rows"), F.col("has_header"))).otherwise(body)
    )
    lined = found.withColumn("line", line)
    single = lined.where("type <> 'list_item'").select("file_name", F.col("block").alias("block_start"), F.col("block").alias("block_end"), F.col("type").alias("kind"), F.col("line").alias("text"))
    island = F.col("block") - F.expr("row_number() over (partition by file_name order by block)")
    runs = lined.where("type = 'list_item'").withColumn("island", island).groupBy("file_name", "island").agg(F.array_sort(F.collect_list(F.struct("block", "line"))).alias("l"))
    lists = runs.select("file_name", F.get("l", F.lit(0))["block"].alias("block_start"), F.element_at("l", -1)["block"].alias("block_end"), F.lit("list").alias("kind"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return single.union(lists)
