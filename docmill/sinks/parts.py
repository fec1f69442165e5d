"""Named part files, written by the tasks and made visible by the driver's commit.

Spark's own writers name files themselves; this data source takes rows
``(file, content)``, writes each under a temporary name next to its place, and
renames all of them only when every task has succeeded.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from docmill.functions.text import slug


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary and final name


class PartWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        fs, path = opened(self.folder)
        out = []
        for row in iterator:
            held = f"{path}/.{row.file}.{uuid.uuid4().hex}"
            with fs.open_output_stream(held, compression=None) as f:
                f.write(row.content.encode())
            out.append((held, f"{path}/{row.file}"))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.folder)
        for m in messages:
            for held, final in m.files if m else ():
                fs.move(held, final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.folder)
        for m in messages:
            for held, _ in m.files if m else ():
                fs.delete_file(held)


class PartFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "partfiles"

    def schema(self) -> str:
        return "file string, content string"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"])


def prepare(folder: str, ready: str = "PRONTO_PARA_IA") -> str:
    """Refuse a folder that holds something; make the one for finished parts."""
    fs, path = opened(folder)
    info = fs.get_file_info(path)
    if info.type == arrow_fs.FileType.File or (info.type == arrow_fs.FileType.Directory and fs.get_file_info(arrow_fs.FileSelector(path))):
        raise FileExistsError(f"{folder} is not empty")
    fs.create_dir(f"{path}/{ready}", recursive=True)
    return f"{folder}/{ready}"


def fresh_folder(spark: SparkSession, source: str, root: str, started: datetime) -> str:
    """A folder in ``root`` named after the file and the time; taken names are numbered from 2."""
    stem = source.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    name = f"{spark.range(1).select(slug(F.lit(stem))).first()[0]}__{started:%Y%m%d_%H%M%S}"
    fs, path = opened(root)
    taken = {i.base_name for i in fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))}
    return f"{root}/" + next(n for n in itertools.chain([name], (f"{name}__{i:02d}" for i in itertools.count(2))) if n not in taken)


def listed(folder: str) -> list[tuple[str, int]]:
    """Names and sizes of the complete files in a folder."""
    fs, path = opened(folder)
    return sorted((i.base_name, i.size) for i in fs.get_file_info(arrow_fs.FileSelector(path)) if i.type == arrow_fs.FileType.File and not i.base_name.startswith("."))


def size_of(uri: str) -> int:
    fs, path = opened(uri)
    return fs.get_file_info(path).size


def write(files: DataFrame, folder: str) -> None:
    """Write ``(file, content)`` rows."""
    files.sparkSession.dataSource.register(PartFiles)
    files.select("file", "content").write.format("partfiles").mode("append").save(folder)


def joined(records: DataFrame, as_array: bool) -> DataFrame:
    """The contents of parts: records ``(file, ord, json)`` in order, as an array or as lines.

    A part is bounded by its limits, so gathering it is too.
    """
    each = records.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]).alias("r"))
    body = F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")) if as_array else F.concat(F.array_join("r", "\n"), F.lit("\n"))
    return each.select("file", body.alias("content"))


def write_text(uri: str, text: str) -> None:
    """One small file, whole or not at all."""
    fs, path = opened(uri)
    folder, _, name = path.rpartition("/")
    held = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(held, compression=None) as f:
            f.write(text.encode())
        fs.move(held, path)
    except BaseException:
        if fs.get_file_info(held).type != arrow_fs.FileType.NotFound:
            fs.delete_file(held)
        raise


def write_json(uri: str, value: object) -> None:
    write_text(uri, json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n")


