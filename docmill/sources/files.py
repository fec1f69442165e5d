"""Files as rows, and the record envelope all sources share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import record_id

SCHEMA_VERSION = "1.0"  # fixed value


def binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, file_name, size_bytes, content)``; files beyond two gigabytes need a splitting source."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", file_name(F.col("path")).alias("file_name"), F.col("length").cast("bigint").alias("size_bytes"), "content")


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"\+", "%2B"))


def envelope(record_type: str, prefix: str, file_type: str, data: Column, processing: Column, logical_key: Column | str = "document") -> list[Column]:
    """The columns of a record: version, type, id, source, data and processing."""
    key = F.lit(logical_key) if isinstance(logical_key, str) else logical_key
    return [
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(record_type).alias("record_type"),
        record_id(prefix, F.lit(record_type), F.col("file_name"), F.col("size_bytes"), key).alias("record_id"),
        F.struct("file_name", F.lit(file_type).alias("file_type"), "size_bytes").alias("source"), data.alias("data"), processing.alias("processing"),
    ]


def processing(warnings: Column, **more: Column) -> Column:
    return F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("converted_at"), F.lit(True).alias("unicode_cleaned"), warnings.alias("warnings"), *[c.alias(k) for k, c in more.items()])
