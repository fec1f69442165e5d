"""The registered queries of the ten operators and, where SQL can express them, their twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe, decontaminate, langid, quality, sharding, simhash, topk, toxicity, urlfilter, warc
from docmill.llm.runtime import documents, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digest(topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(toxicity.predict(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.digest(urlfilter.judged(table(spark, sf_dir, "pages")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(langid.predict(documents(spark, sf_dir)))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.predict(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.sharded(documents(spark, sf_dir)))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN).drop("n_bytes")


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_histogram_sort": op9_histogram_sort,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op3_exact_top_k": topk.ORACLE,
    "op5_url_filter": urlfilter.ORACLE,
}
