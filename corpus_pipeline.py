"""A corpus pipeline over ``documents``: five stages, each written as Parquet and reread by the next.

Language identification drops documents without letters, quality those voted
low, near-dedup keeps one row, that with the smallest id, of each group of near
copies, decontamination drops documents that benchmark passages cover, and the
rest is encoded (and decoded) by byte-level BPE.

Ids and languages may be null and ids repeated: rows are rows, told apart by a
number of their own where that matters.  Null and empty texts have no letter and
go with the first stage; texts may be of any length; columns besides those of
documents are left out, and empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe, decontaminate, langid, quality, simhash
from docmill.llm.runtime import documents, fresh_path, scratch, table, written
from docmill.plans.storage import deleted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told."""
    return langid.predict(docs, keep=docs.columns).where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for."""
    return quality.predict(docs, table(spark, sf_dir, "labels"), keep=docs.columns).where("predicted = 1").select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest id (null ids last), of several such rows the first by row number.

    Rows are told apart by a number fixed in a written table, not by their ids,
    which may be null or repeated.
    """
    numbered = written(docs.withColumn("row_", F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("row_").alias("row"))
    groups = simhash.near_duplicates(numbered.select(key.alias("key"), "text"), "key")
    kept = groups.where("key = component_id").select(F.col("key.row").alias("row_"))
    # by sort-merge whatever the sizes: the kept rows grow with the corpus, so no broadcast of them
    return numbered.join(kept.hint("merge"), "row_", "left_semi").select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not cover."""
    return decontaminate.kept(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("n_bytes")


STAGES = [
    ("language", language),
    ("quality", good),
    ("near_dedup", deduplicated),
    ("decontamination", uncontaminated),
    ("tokens", tokens),
]

#: Training and automata are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table and what it wrote on the way go when the next one's is there."""
    docs, before = documents(spark, sf_dir).select(COLUMNS), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            deleted(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
