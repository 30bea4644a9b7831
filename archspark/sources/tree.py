"""Source trees: listing with pruned folders, reading, and joining sources to snapshots again."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from archspark.functions.names import EXCLUDED_DIRECTORIES, in_excluded_directory, language_of_extension
from archspark.sources.files import file_system

SCHEMA = "path string, language string, content binary, error string"
_CPP, _PYTHON = (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"), (".py", ".pyi")


def language_of(path: str) -> str | None:
    end = os.path.splitext(path)[1]
    return "cpp" if end in _CPP else "python" if end in _PYTHON else None


def is_excluded(name: str) -> bool:
    return name in EXCLUDED_DIRECTORIES or (len(name) > 1 and name.startswith(".") and name != "..")


def walk(root: str) -> list[str]:
    """Relative paths of source files; excluded folders are not entered, unreadable ones are skipped."""
    system, top = file_system(root)
    found, folders = [], [top]
    while folders:
        try:
            inner = system.get_file_info(fs.FileSelector(folders.pop()))
        except OSError:
            continue
        for x in inner:
            if x.type == fs.FileType.Directory:
                if not is_excluded(x.base_name):
                    folders.append(x.path)
            elif language_of(x.path):
                found.append(x.path[len(top.rstrip("/")) + 1 :])
    return sorted(found)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.files = options["path"], int(options.get("filesPerPartition", "256"))

    def partitions(self) -> list[InputPartition]:
        paths = walk(self.root)
        return [InputPartition(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, top = file_system(self.root)
        held: list[tuple] = []
        size = 0
        for path in partition.value:
            try:
                with system.open_input_stream(f"{top.rstrip('/')}/{path}") as f:
                    held.append((path, language_of(path), f.read(), None))
            except OSError as e:  # the file counts as failed, the scan goes on
                held.append((path, language_of(path), None, str(e)))
            size += len(held[-1][2] or b"")
            if size > BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)


#: Bytes of source after which a reader hands a batch to the engine.
BATCH_BYTES = 16 << 20


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("path", "language", "content", "error"), (pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(names))


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: the sources under a folder on any file system."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def read(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").load(root)


def read_anywhere(spark: SparkSession, root: str) -> DataFrame:
    """The same from any Hadoop file system (which hides dot files): the binary file scan, folders filtered by path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    relative = F.expr(f"substring(full, {len(os.path.abspath(root)) + 2})")
    rows = raw.select(full.alias("full"), "content").select(relative.alias("path"), "content")
    return rows.where(~in_excluded_directory(F.col("path"))).select("path", language_of_extension(F.col("path")).alias("language"), "content").where("language is not null")


def with_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``files`` with the content of each path, null where the source cannot be read any more."""
    return files.join(sources.where("content is not null").select("path", "content"), "path", "left")
