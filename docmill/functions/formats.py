"""Source formats: identifiers, labels and units by file name suffix, as a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffix, format, label, unit, units, record type.
FORMATS = (
    (".mbox", "mbox", "MBOX", "mensagem", "mensagens", "email_message"),
    (".txt", "txt", "TXT", "documento", "documentos", "text_document"),
    (".md", "markdown", "Markdown", "documento", "documentos", "text_document"),
    (".markdown", "markdown", "Markdown", "documento", "documentos", "text_document"),
    (".pdf", "pdf", "PDF", "página", "páginas", "pdf_document"),
    (".docx", "docx", "DOCX", "bloco", "blocos", "word_document"),
    (".csv", "csv", "CSV", "linha", "linhas", "tabular_dataset"),
    (".xlsx", "xlsx", "XLSX", "linha", "linhas", "spreadsheet_workbook"),
)


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "suffix string, format_id string, label string, unit string, units string, record_type string")


def dispatched(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds the format columns; suffixes that are not known get their own as format and no record type."""
    suffix = F.lower(F.regexp_extract(F.col(name), r"[^/\\]+(\.[^./\\]+)$", 1))
    found = files.withColumn("suffix", suffix).join(F.broadcast(table(files.sparkSession)), "suffix", "left")  # eight rows
    bare = F.regexp_replace("suffix", r"^\.", "")
    return (
        found.withColumn("format_id", F.coalesce("format_id", F.when(bare != "", bare), F.lit("unknown")))
        .withColumn("label", F.coalesce("label", F.lit("Desconhecido")))
        .withColumn("unit", F.coalesce("unit", F.lit("documento")))
        .withColumn("units", F.coalesce("units", F.lit("documentos")))
    )
