"""Reports of earlier conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.reports import possible_duplicates

REPORT = "relatorio_conversao.json"  # fixed value
SCHEMA = "sources array<struct<file_name:string,size_bytes:bigint>>"


def earlier(spark: SparkSession, root: str) -> DataFrame:
    """``(folder, file_name, size_bytes)`` of the first source of each report one level below ``root``; unreadable ones are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", REPORT).option("recursiveFileLookup", "true").load(root)
    below = F.regexp_extract("path", r"([^/]*)/([^/]*)/[^/]*$", 1) == root.rstrip("/").rsplit("/", 1)[-1]
    read = F.from_json(F.expr("try_cast(content as string)"), SCHEMA)
    found = files.where(below).select(F.url_decode(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)).alias("folder"), F.get(read["sources"], F.lit(0)).alias("s"))
    return found.where("s.file_name is not null").select("folder", "s.file_name", "s.size_bytes")


def conversions_of(spark: SparkSession, root: str, file_name: str, size_bytes: int) -> list[str]:
    """Folders below ``root`` with a conversion of a file of this name and size, the latest last."""
    source = spark.createDataFrame([(file_name, size_bytes)], "file_name string, size_bytes bigint")
    return [r.folder for r in possible_duplicates(earlier(spark, root), source).select("folder").orderBy("folder").collect()]  # a row a report of this file
