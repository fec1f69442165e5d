"""Run reports: counters, status and duplicates of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(flow: str, converted: Column, failed: Column, split: Column, oversized: Column, warnings: Column, cancelled: Column | None = None) -> Column:
    """Four-way result of a run; flows differ in what counts as a warning.

    Mail ignores record warnings, documents count warnings and splits, tables
    count warnings and oversized segments (splits are normal there).
    """
    trouble = {"email": (failed + split + oversized) > 0, "document": (failed + warnings + split + oversized) > 0, "tabular": (failed + warnings + oversized) > 0}[flow]
    out = F.when((converted == 0) & (failed > 0), "failure").when(trouble, "success_with_warnings").otherwise("success")
    return out if cancelled is None else F.when(cancelled, "cancelled").otherwise(out)


def possible_duplicates(sources: DataFrame, earlier: DataFrame) -> DataFrame:
    """Sources whose name and size an earlier report has."""
    return sources.join(earlier.select("file_name", "size_bytes").distinct(), ["file_name", "size_bytes"], "left_semi")


def union_of(warnings: Column) -> Column:
    """Distinct warnings of arrays that were collected, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(warnings)))


def catalogue(segments: DataFrame) -> DataFrame:
    """Per dataset key of segments ``(key, ord, total_rows, oversized)``: rows once, segments, and whether it was split."""
    per_key = segments.groupBy("key").agg(F.min_by("total_rows", "ord").alias("total_rows"), F.count("*").alias("segments"), F.count_if("oversized").alias("oversized"))
    return per_key.withColumn("segmented", F.col("segments") > 1)
