"""Shared plumbing: the folder all executors see, tables written there, text in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.plans.storage import scratch, shared_dir, written

__all__ = ["documents", "fresh_path", "kept", "looked_up", "map_texts", "released", "remainder", "scratch", "shared_dir", "table", "utf8", "written"]

T = TypeVar("T")
#: Keys at most that :func:`looked_up` broadcasts: those with at least one in so many rows.
HOT = 512


_kept: dict[object, object] = {}


def kept(name: object, make: Callable[[], T]) -> T:
    """The one large object that a Python worker keeps for its next tasks; another name's takes its place."""
    released(name)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def released(but: object = None) -> None:
    """Free what the worker keeps for tasks of another kind."""
    if but not in _kept:
        _kept.clear()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/docmill/{label}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: Column | str) -> Column:
    """A text as its UTF-8 bytes: Arrow hands them to Python without decoding."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: the empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def looked_up(
    left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, early: Callable[[DataFrame, Column], DataFrame] | None = None, salt: Column | None = None
) -> DataFrame:
    """``left`` with the further columns of ``right`` (unique by ``keys``; null where it has no row), hot keys spread.

    ``right[count]`` says how many of the ``total`` rows of ``left`` have the key.
    Of keys with at least 1 in ``HOT`` rows there are ``HOT`` at most: these are
    broadcast, and a salt spreads their rows over all tasks of the join that finds
    the others.  The salt is a hash of the row's place, for which ``left`` must be
    read from tables, so that a recomputed task gives its rows the same salts; or of
    ``salt``, which should differ from row to row.  ``early`` may change rows between the two joins; its
    second argument says whether a row's key was a hot one.
    """
    least = max(1, -(-total // HOT))
    values = F.struct(*[c for c in right.columns if c not in keys and c != count])
    hot = right.where(F.col(count) >= least).select(*keys, values.alias("hot_"))
    cold = right.where(F.col(count) < least).select(*keys, F.lit(0).cast("bigint").alias("salt_"), values.alias("cold_"))
    spread = 1 + F.pmod(F.xxhash64(F.monotonically_increasing_id() if salt is None else salt), F.lit(1 << 20))
    found = left.join(F.broadcast(hot), keys, "left").withColumn("salt_", F.when(F.col("hot_").isNull(), F.lit(0).cast("bigint")).otherwise(spread))
    if early is not None:
        found = early(found, F.col("hot_").isNotNull())
    out = found.join(cold, [*keys, "salt_"], "left")
    made = [F.when(F.col("hot_").isNotNull(), F.col(f"hot_.{c}")).otherwise(F.col(f"cold_.{c}")).alias(c) for c in right.columns if c not in keys and c != count]
    return out.select(*left.columns, *made)


def map_texts(
    df: DataFrame,
    per_text: Callable[[], Callable[[bytes | None], tuple]],
    fields: str,
    keep: Iterable[str],
    text: str,
    names: list[str],
    keeps: object = None,
) -> DataFrame:
    """Apply a function to every whole text, carrying the ``keep`` columns along.

    ``per_text`` is called once a task and returns the function, so that models
    are unpacked where they are used.  ``fields`` is the DDL of the columns that
    the function's tuple fills, called ``names``; kept columns of these names
    are replaced.  ``keeps`` is the name of what the function's model is :func:`kept` as.
    """
    made_ = {n.lower() for n in names}
    keep = [c for c in keep if c.lower() not in made_]
    ddl = ", ".join(x for x in (_ddl(df, keep), fields) if x)
    types = _arrow_types(df.sparkSession, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released(keeps)
        score = per_text()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            rows = [score(x.as_py()) for x in texts]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [pa.array([r[i] for r in rows], types[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns + made, keep + names)

    return df.select(*keep, utf8(text).alias("bytes_")).mapInArrow(run, ddl)


def _ddl(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)


def _arrow_types(spark: SparkSession, fields: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(fields).fields]
