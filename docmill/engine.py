"""Conversion of sources into bounded, ready-to-use parts with a report."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.cancellation import Cancellation
from docmill.functions.formats import FORMATS
from docmill.functions.text import rule_report
from docmill.operators import blocks, email, packing, structure
from docmill.operators.reports import catalogue
from docmill.plans.shipping import ship
from docmill.plans.storage import written
from docmill.sinks import parts as sink
from docmill.sources.reports import REPORT, conversions_of

README, READY = "LEIA-ME.txt", "PRONTO_PARA_IA"  # fixed values
SEGMENTED, TOO_LARGE = "oversized_message_segmented", "record_exceeds_partition_limits"  # fixed values


class UnknownFormat(ValueError):
    """No converter takes this file."""


@dataclass(frozen=True)
class Settings:
    """Limits and form of the output: ``platform`` writes JSON arrays, ``api`` JSON lines."""

    max_mib: float = 50
    max_tokens: int = 500_000
    profile: str = "platform"
    include_html: bool = False
    rows_per_segment: int = 1000

    def __post_init__(self) -> None:
        if self.max_mib <= 0 or self.max_tokens <= 0 or self.rows_per_segment <= 0:
            raise ValueError("limits must be positive")
        if self.profile not in ("platform", "api"):
            raise ValueError(f"unknown profile {self.profile}")

    @property
    def max_bytes(self) -> int:
        return int(self.max_mib * (1 << 20))

    @property
    def as_array(self) -> bool:
        return self.profile == "platform"


#: Converters by record type; :func:`register` adds to them.
CONVERTERS: dict[str, Callable] = {}
SUFFIXES: dict[str, str] = {}


def register(record_type: str, suffixes: list[str], convert: Callable) -> None:
    """Add a converter for suffixes, all of them or, on a conflict, none."""
    plain = ["." + s.lower().lstrip(".") for s in suffixes]
    taken = [s for s in plain if SUFFIXES.get(s, record_type) != record_type]
    if taken or not all(len(s) > 1 for s in plain):
        raise ValueError(f"suffixes taken or empty: {taken or plain}")
    CONVERTERS[record_type] = convert
    SUFFIXES.update(dict.fromkeys(plain, record_type))


def resolve(path: str) -> str:
    """The record type that takes a file."""
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in SUFFIXES:
        raise UnknownFormat(f"no converter for {suffix or 'a file without suffix'}")
    return SUFFIXES[suffix]


def convert(
    spark: SparkSession, path: str, out: str, settings: Settings | None = None, progress: Callable[[str], None] | None = None, cancellation: Cancellation | None = None
) -> dict:
    """Convert a file into ``out`` (which must be empty or new); returns the report that is also written.

    The report names earlier conversions of the same file beside ``out``.  A
    conversion that is cancelled keeps the parts that are complete, and says so in
    its report.
    """
    settings = settings or Settings()
    kind = resolve(path)
    ship(spark)
    tell = progress or (lambda stage: None)
    started = datetime.now(UTC)
    ready = sink.prepare(out, READY)
    tell("converting")
    try:
        if cancellation:
            cancellation.enter()
            cancellation.check()
        found = CONVERTERS[kind](spark, path, ready, settings)
    except Exception:
        if not (cancellation and cancellation.asked):
            raise
        found = {"result": "cancelled", "size_bytes": sink.size_of(path), "counts": {}, "warnings": [], "cleaning": {}, "parts": [{"file": n, "size_bytes": size} for n, size in sink.listed(ready)], "errors": []}
    finally:
        if cancellation:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    finished = datetime.now(UTC)
    name = path.rsplit("/", 1)[-1]
    report = {
        "conversion_id": uuid.uuid4().hex, "record_type": kind, "result": found["result"], "started_at": started.isoformat(), "finished_at": finished.isoformat(),
        "duration_seconds": max(0.0, round((finished - started).total_seconds(), 2)), "sources": [{"file_name": name, "size_bytes": found["size_bytes"]}],
        "limits": {"max_bytes": settings.max_bytes, "max_tokens": settings.max_tokens}, "counts": found["counts"], "warnings": found["warnings"], "cleaning": found["cleaning"], "parts": found["parts"], "errors": found["errors"],
        "possible_duplicates": conversions_of(spark, out.rstrip("/").rsplit("/", 1)[0], name, found["size_bytes"]),
    }
    sink.write_json(f"{out}/{REPORT}", report)
    sink.write_text(f"{out}/{README}", readme(report))
    tell("done")
    return report


def readme(report: dict) -> str:
    """What was made, for people."""
    lines = [f"Fonte: {report['sources'][0]['file_name']}", f"Resultado: {report['result']}", f"Partes em {READY}: {len(report['parts'])}"]
    lines += [f"- {p['file']}: {p['size_bytes']} bytes" + (f", {p['estimated_tokens']} tokens estimados" if "estimated_tokens" in p else "") for p in report["parts"]]
    return "\n".join([*lines, *(f"Aviso: {w}" for w in report["warnings"])]) + "\n"


def _cleaning(df: DataFrame, column: str) -> dict:
    rules = {r.rule: r.changes for r in rule_report(df, column).collect()}  # a row a rule
    return {"total_changes": sum(rules.values()), "by_rule": dict(sorted(rules.items()))}


def _emit(records: DataFrame, ready: str, s: Settings, prefix: str, date: bool) -> list[dict]:
    """Pack ``(ord, json, date?)`` records, write the parts, and return their manifest."""
    size = records.select(F.lit("").alias("source"), "ord", F.octet_length("json").alias("bytes"))
    wrapper = 1 if s.as_array else 0
    numbered = packing.packed(size, s.max_bytes, s.max_tokens, "source", "ord", "bytes", wrapper=wrapper)
    extension = "json" if s.as_array else "jsonl"
    numbered = written(numbered.join(records, "ord"), "numbered")
    table = packing.manifest(numbered, wrapper, prefix=prefix, extension=extension, date="date" if date else None)
    named = numbered.withColumn("file", F.format_string(f"{prefix}_parte_%04d.{extension}", "part"))
    sink.write(sink.joined(named, s.as_array), ready)
    return [r.asDict() for r in table.drop("source", "part").orderBy("file").collect()]  # a row a part


def _result(converted: int, failed: int, trouble: bool) -> str:
    return "failure" if not converted and failed else "success_with_warnings" if trouble or failed else "success"


def _mail(spark: SparkSession, path: str, ready: str, s: Settings) -> dict:
    from docmill.sources import mbox

    raw = written(mbox.read(spark, path, s.include_html), "mail")
    good = raw.where("error is null").withColumn("at", F.concat_ws("\0", "source.file_name", F.lpad(F.col("offset").cast("string"), 20, "0")))
    limit = packing.limit_of(s.max_bytes - (2 if s.as_array else 1), s.max_tokens - 1)
    # the envelope that a piece would have: no body, no HTML, a warning more and its numbers
    json = lambda data, own: F.to_json(F.struct("record_id", "source", data.alias("data"), own.alias("processing")), {"ignoreNullFields": "false"})
    own, data = F.col("processing"), F.col("data")
    noted = own.withField("warnings", F.concat("processing.warnings", F.array(F.lit(SEGMENTED)))).withField("segment_number", F.lit(1)).withField("segment_count", F.lit(packing.UNKNOWN_COUNT))
    bare = data.withField("body_text", F.lit(""))
    bare = bare.withField("body_html", F.lit(None).cast("string")) if s.include_html else bare
    sized = good.withColumn("n", F.octet_length(json(data, own))).withColumn("frame", F.octet_length(json(bare, noted)))
    text = F.col("data.body_text")
    large = (F.col("n") > limit) & (text != "")
    none = F.lit(None).cast("int")
    whole = sized.where(~large).select("at", "data", none.alias("number"), none.alias("count"), text.alias("body"), (F.col("n") > limit).alias("oversized"))
    pieces = packing.mail_segments(sized.where(large).select("at", "frame", text.alias("body")), "at", "body", "frame", limit).join(good.select("at", "data"), "at")
    cut = pieces.select(
        "at", "data", F.when(~F.col("oversized"), F.col("segment")).alias("number"), F.when(~F.col("oversized"), F.col("segments")).alias("count"), F.substring(text, F.col("start") + 1, F.col("length")).alias("body"), "oversized"
    )
    every = written(whole.unionByName(cut), "bodies")
    d = lambda k: F.col(f"data.{k}")
    fields = {k: d(k) for k in ("date", "from", "to", "cc", "bcc", "subject", "thread_id", "attachments")} | {"body": F.col("body"), "segment_number": F.col("number"), "segment_count": F.col("count")}
    if s.include_html:
        fields["html"] = F.when(F.col("number").isNull(), d("body_html"))
    ord_ = F.concat_ws("\0", "at", F.lpad(F.coalesce("number", F.lit(0)).cast("string"), 10, "0"))
    records = every.select(ord_.alias("ord"), email.compact(fields).alias("json"), d("date").alias("date"))
    made = _emit(written(records, "compact"), ready, s, "emails", True)
    c = raw.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("converted"), F.coalesce(F.sum(F.size("data.attachments")), F.lit(0)).alias("attachments"), F.max("source.size_bytes").alias("size")).first()
    over = every.agg(F.count_if("oversized").alias("oversized"), F.count_if(F.col("number") == 1).alias("segmented")).first()
    failed = c.total - c.converted
    warnings = {r.w for r in good.select(F.explode("processing.warnings").alias("w")).distinct().collect()}  # a row a warning
    warnings |= {w for w, n in ((SEGMENTED, over.segmented), (TOO_LARGE, over.oversized)) if n}
    errors = [{"file": r.f, "offset": r.offset, "error": r.error} for r in raw.where("error is not null").select(F.col("source.file_name").alias("f"), "offset", "error").orderBy("f", "offset").toLocalIterator()]
    counts = {"messages": c.total, "converted": c.converted, "failed": failed, "segmented": over.segmented, "oversized": over.oversized, "attachments": c.attachments}
    return {"result": _result(c.converted, failed, bool(over.segmented or over.oversized)), "size_bytes": c.size, "counts": counts, "warnings": sorted(warnings), "cleaning": _cleaning(good.select(F.col("data.body_text").alias("t")), "t"), "parts": made, "errors": errors}


def _table(spark: SparkSession, path: str, ready: str, s: Settings) -> dict:
    from docmill.sources import csv

    r = csv.read(spark, path, per_segment=s.rows_per_segment)
    columns = r["columns"].groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "source_name", "name"))), lambda c: F.struct(c["source_name"].alias("source_name"), c["name"].alias("name"))).alias("columns"))
    json = packing.compact_tabular(F.col("dataset"), F.col("row_start"), F.col("row_end"), F.col("total_rows"), F.coalesce("columns", F.array().cast("array<struct<source_name:string,name:string>>")), F.col("rows"))
    records = written(r["segments"].join(columns, "dataset", "left").select(F.col("segment").cast("bigint").alias("ord"), json.alias("json"), "total_rows", "dataset"), "segments")
    made = _emit(records.select("ord", "json"), ready, s, "dados", False)
    limit = packing.limit_of(s.max_bytes - 2, s.max_tokens - 1)
    summary = catalogue(records.select(F.col("dataset").alias("key"), "ord", "total_rows", (F.octet_length("json") > limit).alias("oversized"))).first()
    info = r["files"].first()
    warnings = [*info.warnings, *(["tabular_segment_exceeds_configured_limit"] if summary.oversized else [])]
    return {"result": _result(1, 0, bool(warnings)), "size_bytes": info.size_bytes, "counts": {"rows": info.total_rows, "columns": info.width, "segments": summary.segments, "oversized": summary.oversized}, "warnings": warnings, "cleaning": _cleaning(r["cells"].select("raw"), "raw"), "parts": made, "errors": []}


def _workbook(spark: SparkSession, path: str, ready: str, s: Settings) -> dict:
    from docmill.sources import xlsx

    r = xlsx.read(spark, path, per_segment=s.rows_per_segment)
    errors = [x.asDict() for x in r["errors"].collect()]
    key = ["file_name", "sheet_index", "dataset"]
    names = r["columns"].groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "source_name", "name"))), lambda c: F.struct(c["source_name"].alias("source_name"), c["name"].alias("name"))).alias("columns"))
    formulas = r["formulas"].groupBy(*key, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.col("cell_reference").alias("cell"), "formula"))), lambda f: F.struct(f["cell"].alias("cell"), f["formula"].alias("formula"))).alias("formulas"))
    all_ = r["datasets"].join(r["segments"], key, "left").join(names, key, "left").join(formulas, [*key, "segment"], "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    json = packing.compact_tabular(
        F.col("file_name"), F.col("row_start"), F.col("row_end"), F.col("total_rows"), none("columns", "array<struct<source_name:string,name:string>>"), none("rows", "array<string>"), F.col("sheet"), F.col("reference"), none("formulas", "array<struct<cell:string,formula:string>>")
    )
    ord_ = F.expr("row_number() over (order by sheet_index, dataset, segment)").cast("bigint")  # segments of one workbook
    records = written(all_.select(ord_.alias("ord"), json.alias("json")), "segments")
    made = _emit(records, ready, s, "dados", False) if not errors else []
    info = r["datasets"].agg(F.sum("total_rows").alias("rows"), F.sum("formula_cells").alias("formulas"), F.countDistinct("sheet_index").alias("sheets"), F.count("*").alias("datasets")).first()
    warnings = [w.w for w in r["datasets"].select(F.explode("warnings").alias("w")).distinct().orderBy("w").collect()]
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    return {"result": _result(info.rows or 0, len(errors), bool(warnings)), "size_bytes": size, "counts": {"rows": info.rows or 0, "sheets": info.sheets, "datasets": info.datasets, "formulas": info.formulas or 0}, "warnings": warnings, "cleaning": {"total_changes": 0, "by_rule": {}}, "parts": made, "errors": errors}


def _write_markdown(rows: DataFrame, ready: str, prefix: str) -> list[dict]:
    """Rows ``(number, content)`` as Markdown parts."""
    files = written(rows.select(F.format_string(f"{prefix}_parte_%04d.md", "number").alias("file"), "content"), "markdown")
    sink.write(files, ready)
    made = files.select("file", F.octet_length("content").alias("size_bytes"), F.floor((F.octet_length("content") + 1) / 2).alias("estimated_tokens")).orderBy("file")
    return [r.asDict() for r in made.collect()]


def _text(spark: SparkSession, path: str, ready: str, s: Settings) -> dict:
    from docmill.sources import text

    r = written(text.read(spark, path), "text")
    body = F.when(F.col("data.content_format") == "markdown", F.col("data.content")).otherwise(structure.markdown_body(F.col("data.content"), F.col("lines"), F.col("data.headings")))
    whole = structure.with_lines(r.withColumn("c", F.col("data.content")), "c").select(F.col("source.file_name").alias("name"), body.alias("body"))
    pieces = packing.segments(whole.withColumn("k", F.lit(0)), "k", "body", s.max_bytes, s.max_tokens, "name").drop("k").crossJoin(F.broadcast(whole))  # one document
    number = F.when(F.col("segments") > 1, F.col("segment"))
    header = structure.part_header(F.col("name"), number, F.when(number.isNotNull(), F.col("segments")), F.col("line_start"), F.col("line_end"))
    chunk = F.regexp_replace(F.substring(F.col("body"), F.col("start") + 1, F.col("length")), r"(?U)\s+\z", "")
    made = _write_markdown(pieces.select(F.col("segment").alias("number"), F.concat(header, F.lit("\n\n"), chunk, F.lit("\n")).alias("content")), ready, "documento")
    info = r.select(F.size("data.headings").alias("h"), F.size("data.sections").alias("s"), "processing.warnings", F.col("source.size_bytes").alias("n")).first()
    return {"result": _result(1, 0, bool(info.warnings) or len(made) > 1), "size_bytes": info.n, "counts": {"headings": info.h, "sections": info.s}, "warnings": info.warnings, "cleaning": _cleaning(spark.read.format("binaryFile").load(path).select(F.expr("try_cast(content as string)").alias("t")).where("t is not null"), "t"), "parts": made, "errors": []}


def _grouped(units: DataFrame, ready: str, s: Settings, name: str, notes: Callable[[DataFrame], DataFrame] | None = None) -> list[dict]:
    """Units ``(ord, text)`` cut to size, grouped greedily, and written."""
    limit = packing.limit_of(s.max_bytes, s.max_tokens) - 512  # room for the header and notes
    units = written(units, "units")
    rest, between = units, None
    if "kind" in units.columns:  # long tables between rows, with their header again; those that do not go so as text
        tables = units.where("kind = 'table'").where(F.octet_length("text") > limit).withColumn("lines", F.split("text", "\n")).where(F.size("lines") > 2).withColumn("frame", F.lit(0))
        parts = written(packing.table_segments(tables, "ord", "lines", "frame", limit).where("fits"), "tables")
        body = F.concat(F.slice("lines", 1, 2), F.slice(F.col("lines"), F.col("row_start") + 2, F.col("row_end") - F.col("row_start") + 1))
        between = parts.join(tables, "ord").select("ord", "segment", F.array_join(body, "\n").alias("text"))
        rest = units.join(parts.select("ord").distinct(), "ord", "left_anti")
    cut = packing.segments(rest, "ord", "text", limit, limit // 2 + 1)
    pieces = cut.join(rest, "ord").select("ord", "segment", F.substring(F.col("text"), F.col("start") + 1, F.col("length")).alias("text"))
    if between is not None:
        pieces = pieces.union(between)
    pieces = pieces.select((F.col("ord") * 100_000 + F.col("segment")).cast("bigint").alias("page"), "ord", "text")
    sized = written(pieces.withColumn("doc", F.lit(0)).withColumn("bytes", F.octet_length("text").cast("bigint")), "units")
    placed = blocks.group_pages(sized.select("doc", "page", "bytes"), limit).join(sized.select("page", "ord", "text"), "page")
    made = placed.groupBy("part").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    total = made.count()
    made = notes(made) if notes else made.withColumn("note", F.lit(""))
    part = F.format_string(f" — parte %d/{total}", "part") if total > 1 else F.lit("")
    return _write_markdown(made.select(F.col("part").alias("number"), F.concat(F.lit(f"> Fonte: {name}"), part, "note", F.lit("\n\n"), F.regexp_replace("body", r"(?U)\s+\z", ""), F.lit("\n")).alias("content")), ready, "documento")


def _word(spark: SparkSession, path: str, ready: str, s: Settings) -> dict:
    from docmill.sources import docx

    r = docx.read(spark, path)
    errors = [x.asDict() for x in r["errors"].collect()]
    info = r["documents"].first()
    made = [] if errors else _grouped(docx.markdown(r["blocks"]).select(F.col("block_start").alias("ord"), "text", "kind"), ready, s, path.rsplit("/", 1)[-1])
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    counts = {k: info[k] for k in ("paragraphs", "headings", "list_items", "tables", "images")} if info else {}
    warnings = info.warnings if info else []
    return {"result": _result(int(not errors), len(errors), bool(warnings) or len(made) > 1), "size_bytes": size, "counts": counts, "warnings": warnings, "cleaning": _cleaning(r["blocks"].select("text"), "text"), "parts": made, "errors": errors}


def _pdf(spark: SparkSession, path: str, ready: str, s: Settings) -> dict:
    from docmill.sources import pdf

    r = pdf.read(spark, path)
    errors = [x.asDict() for x in r["errors"].collect()]
    info = r["documents"].first()
    made = []
    if not errors:
        none = F.lit(None).cast("int")
        units = r["pages"].select(F.col("page_number").alias("ord"), blocks.page_unit(F.col("page_number"), F.col("text"), none, none).alias("text"))
        images = r["images"]

        def notes(parts: DataFrame) -> DataFrame:
            per_page = images.groupBy("page_number").agg(F.count("*").alias("n"))
            counted = parts.join(per_page, F.col("page_number").between(F.col("first"), F.col("last")), "left").groupBy("part", "first", "last", "body").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            return counted.withColumn("note", blocks.page_notes(F.col("first"), F.col("last"), F.col("n"), F.lit(info.embedded_files)))

        made = _grouped(units, ready, s, path.rsplit("/", 1)[-1], notes)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    counts = {k: info[k] for k in ("page_count", "pages_with_text", "images", "outline_items", "embedded_files")} if info else {}
    warnings = info.warnings if info else []
    return {"result": _result(int(not errors), len(errors), bool(warnings) or len(made) > 1), "size_bytes": size, "counts": counts, "warnings": warnings, "cleaning": _cleaning(r["pages"].select("text"), "text"), "parts": made, "errors": errors}


for _type, _convert in (("email_message", _mail), ("tabular_dataset", _table), ("spreadsheet_workbook", _workbook), ("text_document", _text), ("word_document", _word), ("pdf_document", _pdf)):
    register(_type, [f[0] for f in FORMATS if f[5] == _type], _convert)

