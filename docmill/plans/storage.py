"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written within each :func:`scratch` that is open.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is made where nothing names one, in local mode only.

    On a cluster every machine would have a temporary folder of its own, so there
    a folder must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="docmill-shared-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and fixes what is not deterministic.

    The innermost open :func:`scratch` deletes it in the end, with ``keep`` the one around that.
    """
    path = f"{shared_dir(df.sparkSession)}/docmill/{label}-{uuid.uuid4().hex}"
    at = -2 if keep else -1
    if len(_open) >= -at:
        _open[at].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, in the end, the tables :func:`written` within that were not to be kept."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            deleted(spark, path)
