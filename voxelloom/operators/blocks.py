"""Cut tiles into pieces of target blocks and paste pieces back into whole blocks.

Pieces are the only payload that is shuffled. Where several tiles cover a voxel the greatest value wins: that
rule needs no order, so copies collapse map-side and a block is pasted from a stream of any length in
memory bounded by the block itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from voxelloom.functions.batches import binary_column, ints, payload_view

Row = tuple[tuple, np.ndarray]

# Pieces a task holds back, in bytes, to merge copies before they reach the shuffle.
HELD_BYTES = 64 << 20
# What a held piece counts besides its voxels: its identity as a tuple, the array around the voxels and its columns when it goes out take
# about a kilobyte. The rest keeps small pieces few: an executor has several Python workers a core.
PIECE_BYTES = 4 << 10

BLOCK = ["bx", "by", "bz", "bw", "bh", "bd"]
PIECE = ["px", "py", "pz", "pw", "ph", "pd"]


def cut(stack: np.ndarray, origin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The part [low, high) of one (z, y, x) stack; all coordinates absolute, in x, y, z order."""
    (x0, y0, z0), (x1, y1, z1) = low - origin, high - origin
    return stack[z0:z1, y0:y1, x0:x1]


class PieceBuffer:
    """Collects pieces by identity, keeping the greatest value per voxel, and emits Arrow batches."""

    def __init__(self, schema: pa.Schema, held_bytes: int = HELD_BYTES):
        self.schema = schema
        self.held_bytes = held_bytes
        self.pieces: dict[tuple, np.ndarray] = {}
        self.size = 0

    def add(self, identity: tuple, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = self.pieces.get(identity)
        if held is not None:
            np.maximum(held, values, out=held)
            return
        self.pieces[identity] = values.copy()
        self.size += values.size + PIECE_BYTES
        if self.size >= self.held_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.pieces:
            return
        columns = zip(*self.pieces)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
        arrays.append(binary_column([v.reshape(-1) for v in self.pieces.values()]))
        self.pieces, self.size = {}, 0
        yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def paste(canvas: np.ndarray, origin: np.ndarray, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> None:
    """Merge one piece into the canvas, greatest value first."""
    target = cut(canvas, origin, low, high)
    np.maximum(target, values, out=target)


class _Decoded:
    """Columns of one batch, each converted once."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.known: dict = {}

    def get(self, key, read: Callable):
        if key not in self.known:
            self.known[key] = read()
        return self.known[key]


class Part:
    """Consecutive rows of one group within one batch."""

    def __init__(self, decoded: _Decoded, start: int, end: int):
        self.decoded, self.start, self.end = decoded, start, end

    def ints(self, names: list[str]) -> np.ndarray:
        """Integer columns as a (rows, columns) array."""
        batch = self.decoded.batch
        return self.decoded.get(tuple(names), lambda: ints(batch, names))[self.start : self.end]

    def texts(self, name: str) -> list[str]:
        column = self.decoded.batch.column(name)
        return self.decoded.get(name, column.to_pylist)[self.start : self.end]

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows with voxels as (row of this part, low, high, values); empty rows only announce their block."""
        column = self.decoded.batch.column("pixels")
        data, starts = self.decoded.get("pixels", lambda: payload_view(column))
        for row, box in enumerate(self.ints(PIECE)):
            if box[3]:
                at = self.start + row
                yield row, box[:3], box[:3] + box[3:], data[starts[at] : starts[at + 1]].reshape(box[:2:-1])


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Part]]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        decoded = _Decoded(batch)
        values = ints(batch, keys)
        starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], batch.num_rows]
        for start, end in zip(starts.tolist(), ends.tolist()):
            yield tuple(values[start].tolist()), Part(decoded, start, end)


def fold_blocks(
    pieces: DataFrame,
    keys: list[str],
    schema: pa.Schema,
    fold: Callable[[tuple, Iterator[Part]], Iterable[Row]],
    tasks: int | None = None,
) -> DataFrame:
    """Shuffle pieces by integer keys and turn the pieces of each key into rows.

    ``fold`` reads its group as a stream of parts, so a group may be larger than memory, and yields rows
    as (all columns but the payload, payload). The number of tasks is the session's number of shuffle
    partitions unless the caller, who knows the bytes, gives another one; it is not reduced for small data: the work is
    in Python, not in the bytes.
    """
    tasks = tasks or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pieces.repartition(tasks, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = PieceBuffer(schema)
        for key, group in groupby(_runs(batches, keys), key=lambda found: found[0]):
            for head, payload in fold(key, (part for _, part in group)):
                yield from buffer.add(head, payload)
        yield from buffer.flush()

    return placed.mapInArrow(run, from_arrow_schema(schema))
