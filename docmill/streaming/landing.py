"""Landing folders: new files become cleaned, measured records as they arrive."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmill.functions.decoding import decoded
from docmill.functions.text import cleaned, tokens
from docmill.sources.files import file_name

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def texts(spark: SparkSession, folder: str, glob: str = "*.{txt,md,markdown}", files_per_batch: int = 100) -> DataFrame:
    """A stream of ``(file_name, text, encoding, warnings, bytes, tokens)``."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    opened = files.select(file_name(F.col("path")).alias("file_name"), "modificationTime", decoded(F.col("content")).alias("d"))
    ready = opened.select("file_name", "modificationTime", cleaned(F.col("d.content")).alias("text"), "d.encoding", "d.warnings")
    return ready.withColumn("bytes", F.octet_length("text").cast("bigint")).withColumn("tokens", tokens(F.col("text")))


def packed(records: DataFrame, limit: int, source: str = "source", size: str = "bytes") -> DataFrame:
    """Part numbers of a stream by source: the open part's bytes are kept as state between batches."""
    out = "source string, ord bigint, bytes bigint, part bigint"

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        held, part = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
        parts = []
        for n in rows["bytes"]:
            if part == 0 or held + n + 1 > limit:
                held, part = 0, part + 1
            held += int(n) + 1
            parts.append(part)
        state.update((held, part))
        yield pd.DataFrame({"source": key[0], "ord": rows["ord"], "bytes": rows["bytes"], "part": parts})

    slim = records.select(F.col(source).alias("source"), "ord", F.col(size).cast("bigint").alias("bytes"))
    return slim.groupBy("source").applyInPandasWithState(step, out, "held bigint, part bigint", "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, out: str, checkpoint: str):
    """Write all that is there to Parquet, once; started again it takes only what is new."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
