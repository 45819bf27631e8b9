"""Sequence files as a data source of Spark: text key, byte payload, read and written as Arrow batches.

Files are cut into splits, and a split reads from the first sync marker in its range up to the first one behind it, so that each record
is read once. Small files share a task. Written files appear when all tasks are done; ``_SUCCESS`` comes last.

Compressed files, and other types of keys and values, are refused here; see :func:`voxelloom.sources.sequence.read_sequence`.
Paths are mounted folders or URIs that pyarrow can open; files whose names begin with ``_`` or ``.`` are passed over.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from weakref import WeakSet

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "voxelloom-sequence"
#: Bytes of files that one task reads, and of payload that one batch holds.
SPLIT_BYTES, BATCH_BYTES = 128 << 20, 32 << 20
#: The layout of the files. Fixed values.
MAGIC, VERSION = b"SEQ", 6
TEXT, BYTES = "org.apache.hadoop.io.Text", "org.apache.hadoop.io.BytesWritable"
ESCAPE, SYNC_SIZE, SYNC_INTERVAL = b"\xff\xff\xff\xff", 16, 102_400


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the place in it that a path or URI names."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def packed_length(n: int) -> bytes:
    """A length as the files hold it: one byte up to 127, else the number of bytes and the bytes."""
    if n <= 127:
        return bytes([n])
    size = (n.bit_length() + 7) // 8
    return struct.pack("b", -112 - size) + n.to_bytes(size, "big")


def read_length(file: io.BufferedIOBase) -> int:
    first = struct.unpack("b", _exactly(file, 1))[0]
    if first >= 0:
        return first
    if not -120 <= first <= -113:
        raise ValueError("negative length")
    return int.from_bytes(_exactly(file, -112 - first), "big")


def _exactly(file: io.BufferedIOBase, n: int) -> bytes:
    found = file.read(n)
    if len(found) != n:
        raise EOFError
    return found


def _text(file: io.BufferedIOBase) -> str:
    return _exactly(file, read_length(file)).decode()


def _packed_text(text: str) -> bytes:
    return packed_length(len(own := text.encode())) + own


def read_header(file: io.BufferedIOBase) -> bytes:
    """The sync marker of a file whose header is read up to the first record."""
    if _exactly(file, 4) != MAGIC + bytes([VERSION]):
        raise ValueError("not a sequence file of version 6")
    kinds = _text(file), _text(file)
    if any(_exactly(file, 2)):
        raise ValueError("compressed")
    if kinds != (TEXT, BYTES):
        raise ValueError(f"holds {' and '.join(kinds)}")
    for _ in range(2 * struct.unpack(">i", _exactly(file, 4))[0]):
        _text(file)
    return _exactly(file, SYNC_SIZE)


def _first_mark(file: io.BufferedIOBase, mark: bytes, start: int, end: int) -> int | None:
    """Place of the first marker that begins in [start, end)."""
    file.seek(start)
    kept, at = b"", start
    while at < end:
        part = file.read(min(1 << 20, end + len(mark) - 1 - at - len(kept)))
        kept += part
        if (found := kept.find(mark)) >= 0:
            return at + found if at + found < end else None
        if not part:
            return None
        moved = max(0, len(kept) - len(mark) + 1)
        kept, at = kept[moved:], at + moved
    return None


def records(file: io.BufferedIOBase, start: int, end: int) -> Iterator[tuple[str, bytes]]:
    """The records of a file that belong to the split [start, end)."""
    file.seek(0)
    sync = read_header(file)
    if start > 0:
        first = _first_mark(file, ESCAPE + sync, max(start, file.tell()), end)
        if first is None:
            return
        file.seek(first)
    while head := file.read(4):
        if head == ESCAPE:
            place = file.tell() - 4
            if _exactly(file, SYNC_SIZE) != sync:
                raise ValueError("broken sync marker")
            if place >= end:
                return
            continue
        if len(head) != 4:
            raise EOFError
        size, key_size = struct.unpack(">i", head)[0], struct.unpack(">i", _exactly(file, 4))[0]
        body = _exactly(file, size)
        key = io.BytesIO(body[:key_size])
        yield _text(key), body[key_size + 4 : key_size + 4 + struct.unpack_from(">i", body, key_size)[0]]


@dataclass(frozen=True)
class Splits(InputPartition):
    """(file, start, end) of what one task reads."""

    pieces: tuple[tuple[str, int, int], ...]


class Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def _files(self) -> list[tuple[str, int]]:
        system, root = located(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"[PATH_NOT_FOUND] {self.path}")
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Splits]:
        out: list[Splits] = []
        group, held = [], 0
        for file, size in self._files():
            for start in range(0, size, self.split_bytes):
                end = min(start + self.split_bytes, size)
                if group and held + end - start > self.split_bytes:
                    out.append(Splits(tuple(group)))
                    group, held = [], 0
                group.append((file, start, end))
                held += end - start
        return [*out, Splits(tuple(group))]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.path)
        keys, values, held = [], [], 0
        for path, start, end in partition.pieces:
            try:
                with io.BufferedReader(system.open_input_file(path), 1 << 20) as file:
                    for key, value in records(file, start, end):
                        keys.append(key)
                        values.append(value)
                        held += len(key) + len(value)
                        if held >= BATCH_BYTES:
                            yield _batch(keys, values)
                            keys, values, held = [], [], 0
            except EOFError:
                raise ValueError(f"{path} ends within a record") from None
            except ValueError as error:
                raise ValueError(f"{path}: {error}") from None
        if keys:
            yield _batch(keys, values)


def _batch(keys: list[str], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], names=["path", "content"])


@dataclass
class Written(WriterCommitMessage):
    """The unfinished file of a task, and the name it gets."""

    partial: str | None
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.partial = path, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{TaskContext.get().partitionId():05d}"
        system, root = located(self.path)
        partial, file = f"{root}/{self.partial}/{uuid.uuid4().hex}", None
        sync = os.urandom(SYNC_SIZE)
        marked = 0
        try:
            for batch in iterator:
                for key, value in zip(batch.column(0), batch.column(1)):
                    if not (key.is_valid and value.is_valid):
                        raise ValueError("a record needs a key and a payload")
                    if file is None:
                        system.create_dir(f"{root}/{self.partial}", recursive=True)
                        file = system.open_output_stream(partial)
                        file.write(MAGIC + bytes([VERSION]) + _packed_text(TEXT) + _packed_text(BYTES) + bytes(2 + 4) + sync)
                    if file.tell() >= marked + SYNC_INTERVAL:
                        file.write(ESCAPE + sync)
                        marked = file.tell()
                    own, payload = _packed_text(key.as_py()), value.as_buffer()
                    file.write(struct.pack(">ii", len(own) + 4 + payload.size, len(own)) + own + struct.pack(">i", payload.size))
                    file.write(payload)
        finally:
            if file is not None:
                file.close()
        return Written(partial if file is not None else None, name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            if message is not None and message.partial:
                system.move(message.partial, f"{root}/{message.name}")
        self.abort(messages)
        system.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/{self.partial}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.partial}")


class SequenceFiles(DataSource):
    """``path`` (the key) and ``content`` of every record; written are the first two columns, text and bytes, of any table."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        if [f.dataType for f in schema] != [T.StringType(), T.BinaryType()]:
            raise ValueError("a sequence file is written from a text and a byte column")
        return Writer(self.options["path"])


_known: WeakSet[SparkSession] = WeakSet()


def registered(spark: SparkSession) -> SparkSession:
    """The session, which knows the format from now on."""
    if spark not in _known:
        # sources are registered in the active session, which this one is as soon as it has made a table
        spark.createDataFrame([], "none int")
        spark.dataSource.register(SequenceFiles)
        _known.add(spark)
    return spark
