"""Binary syntax snapshots as a Spark data source, and their writer.

Little-endian: four magic bytes, version, number of files, then for each file its path, its number of nodes and the
nodes ``kind:u8 name start:u32 end:u32 first_child:u32 child_count:u32 parent:i32``; strings are a u32 length and UTF-8
bytes.  Each snapshot file is one partition, decoded as a stream, so a reader holds one record at a time.
"""

from __future__ import annotations

import fnmatch
import io
import itertools
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from archspark.sources.files import file_system, list_files

VERSION = 2
#: The four bytes every snapshot begins with; another writer's can be given as the option ``magic``.
MAGIC = b"ASTS"
MAX_STRING = 1 << 20
MAX_KIND = 7
SCHEMA = "snapshot string, file_ordinal int, path string, node_id int, kind tinyint, name string, byte_start bigint, byte_end bigint, first_child_index bigint, child_count bigint, parent_index int"
_NODE = struct.Struct("<IIIIi")


class SnapshotError(ValueError):
    """The bytes are no snapshot."""


class InvalidMagicError(SnapshotError):
    """It does not begin with the magic bytes."""


class UnsupportedSchemaVersionError(SnapshotError):
    """It has another version."""

    def __init__(self, found: int, expected: int = VERSION) -> None:
        super().__init__(f"snapshot version {found} found, {expected} expected")
        self.found, self.expected = found, expected


class TruncatedSnapshotError(SnapshotError):
    """It ends too early."""

    def __init__(self, offset: int) -> None:
        super().__init__(f"snapshot ends within the record at byte {offset}")
        self.offset = offset


def _take(f: BinaryIO, n: int) -> bytes:
    at = f.tell()
    data = f.read(n)
    if len(data) != n:
        raise TruncatedSnapshotError(at)
    return data


def _u32(f: BinaryIO) -> int:
    return struct.unpack("<I", _take(f, 4))[0]


def _string(f: BinaryIO) -> str:
    n = _u32(f)
    if n > MAX_STRING:
        raise SnapshotError(f"a string of {n} bytes is implausible")
    try:
        return _take(f, n).decode("utf-8")
    except UnicodeDecodeError as e:
        raise SnapshotError(f"a string is not UTF-8: {e}") from e


def read_header(f: BinaryIO, magic: bytes = MAGIC) -> tuple[int, int]:
    """(version, number of files) from the first twelve bytes."""
    if f.read(4) != magic:
        raise InvalidMagicError("the magic bytes do not match")
    version = _u32(f)
    if version != VERSION:
        raise UnsupportedSchemaVersionError(version)
    return version, _u32(f)


def decode(f: BinaryIO, magic: bytes = MAGIC) -> Iterator[tuple]:
    """Rows ``file_ordinal, path, node_id, kind, name, ...`` in the order of the file."""
    _, files = read_header(f, magic)
    for ordinal in range(files):
        path = _string(f)
        for node in range(_u32(f)):
            kind = _take(f, 1)[0]
            if kind > MAX_KIND:
                raise SnapshotError(f"node kind {kind} is unknown")
            name = _string(f)
            start, end, first, count, parent = _NODE.unpack(_take(f, _NODE.size))
            yield ordinal, path, node, kind, name, start, end, first, count, parent


def encode(files: Iterable[tuple[str, list[tuple]]], f: BinaryIO, magic: bytes = MAGIC) -> int:
    """Write ``(path, [(kind, name, start, end, first, count, parent), ...])`` records; returns the number of files."""
    f.write(magic + struct.pack("<II", VERSION, 0))
    n = 0
    for path, nodes in files:
        raw = path.encode()
        f.write(struct.pack("<I", len(raw)) + raw + struct.pack("<I", len(nodes)))
        for kind, name, start, end, first, count, parent in nodes:
            text = name.encode()
            f.write(struct.pack("<BI", kind, len(text)) + text + _NODE.pack(start, end, first, count, parent))
        n += 1
    f.seek(8)
    f.write(struct.pack("<I", n))
    return n


#: Rows of one batch a reader hands to the engine.
BATCH_ROWS = 16_384
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "tinyint": pa.int8()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (column.split() for column in SCHEMA.split(", "))])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.magic = options["path"], options.get("magic", MAGIC.decode()).encode()

    def partitions(self) -> list[InputPartition]:
        system, path = file_system(self.path)
        if system.get_file_info(path).type == fs.FileType.Directory:
            paths = [p for p in list_files(system, path) if p.endswith(".bin")]
        else:
            folder, _, pattern = path.rpartition("/")
            known = system.get_file_info(folder or "/").type == fs.FileType.Directory
            paths = [p for p in list_files(system, folder or "/") if fnmatch.fnmatchcase(p.rpartition("/")[2], pattern)] if known else []
        if not paths:
            raise FileNotFoundError(self.path)
        for p in paths:  # a wrong header fails before any task starts
            with io.BufferedReader(system.open_input_file(p)) as f:
                read_header(f, self.magic)
        return [InputPartition(p) for p in paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        with io.BufferedReader(system.open_input_file(partition.value), 1 << 20) as f:
            rows = decode(f, self.magic)
            while part := list(itertools.islice(rows, BATCH_ROWS)):
                columns = [[partition.value] * len(part), *zip(*part)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


class SnapshotSource(DataSource):
    """``spark.read.format("ast_snapshot").load(path)``: a file, a pattern or a folder of ``*.bin`` on any file system."""

    @classmethod
    def name(cls) -> str:
        return "ast_snapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def read(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("ast_snapshot").option("magic", magic.decode()).load(path)


def write(nodes: DataFrame, folder: str, partitions: int | None = None, magic: bytes = MAGIC) -> int:
    """One snapshot for each partition of files in a shared folder; returns the number of files written."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    columns = ["path", "node_id", "kind", "name", "byte_start", "byte_end", "first_child_index", "child_count", "parent_index"]
    spread = nodes.select(columns).repartition(*([partitions] if partitions else []), "path").sortWithinPartitions("path", "node_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        first = next(rows, None)
        if first is None:
            return
        own, place = file_system(folder)
        name = f"{place}/part-{uuid.uuid4().hex}.bin"
        with tempfile.TemporaryFile() as f:  # the header's count is known at the end, and shared streams do not seek back
            n = encode(((p, [(r[2], r[3] or "", r[4], r[5], r[6] or 0, r[7] or 0, -1 if r[8] is None else r[8]) for r in g]) for p, g in itertools.groupby(itertools.chain([first], rows), key=lambda r: r[0])), f, magic)
            f.seek(0)
            with own.open_output_stream(name + ".tmp") as out:
                while block := f.read(1 << 20):
                    out.write(block)
        own.move(name + ".tmp", name)  # a task that is run again leaves no half file
        yield pa.record_batch({"file": [name], "n": [n]})

    done = spread.mapInArrow(run, "file string, n bigint").collect()
    kept = {r["file"].rpartition("/")[2] for r in done}
    for path in list_files(system, root):  # of attempts that were lost after or while writing
        name = path.rpartition("/")[2]
        if name.startswith("part-") and name not in kept:
            system.delete_file(path)
    return sum(r["n"] for r in done)
