"""Zero-copy views of tile payloads inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from voxelloom.schema import DIMS

# Voxels handed to a kernel at once; bounds the working memory of a task and keeps it near the cache.
STACK_VOXELS = 1 << 20


def ints(batch: pa.RecordBatch, names: Iterable[str]) -> np.ndarray:
    """Integer columns as one (rows, columns) array."""
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)


def payload_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte data and row offsets of a binary column, without copying."""
    if column.null_count:
        raise ValueError("tile payload is NULL")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)
    starts = starts[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values, starts


def binary_column(chunks: list[np.ndarray]) -> pa.Array:
    """Flat uint8 chunks as a binary column, one row per chunk."""
    offsets = np.zeros(len(chunks) + 1, np.int32)
    np.cumsum([c.size for c in chunks], out=offsets[1:])
    data = np.concatenate(chunks) if chunks else np.zeros(0, np.uint8)
    return pa.BinaryArray.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def stacks(batch: pa.RecordBatch, max_voxels: int = STACK_VOXELS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal shape as ``(row numbers, uint8 array (rows, z, y, x))``."""
    if batch.num_rows == 0:
        return
    values, starts = payload_view(batch.column("pixels"))
    dims = ints(batch, DIMS)
    volume = dims.prod(axis=1)
    wrong = np.flatnonzero((np.diff(starts) != volume) | (dims <= 0).any(axis=1))
    if wrong.size:
        row = int(wrong[0])
        raise ValueError(f"payload of {int(starts[row + 1] - starts[row])} bytes does not fill box {dims[row].tolist()}")
    shapes, member = np.unique(dims, axis=0, return_inverse=True)
    for s, (w, h, d) in enumerate(shapes.tolist()):
        rows = np.flatnonzero(member.ravel() == s)
        step = max(1, max_voxels // (w * h * d))
        for first in range(0, rows.size, step):
            part = rows[first : first + step]
            if part[-1] - part[0] + 1 == part.size:
                flat = values[starts[part[0]] : starts[part[-1] + 1]]
            else:
                flat = np.concatenate([values[starts[r] : starts[r + 1]] for r in part])
            yield part, flat.reshape(part.size, d, h, w)


def per_slices(stack: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Run a kernel over the slices of an (n, z, y, x) stack, a bounded number of voxels at a time."""
    slices = stack.reshape(-1, *stack.shape[2:])
    step = max(1, STACK_VOXELS // (slices.shape[1] * slices.shape[2]))
    if len(slices) <= step:
        return kernel(slices).reshape(stack.shape)
    parts = [kernel(slices[i : i + step]) for i in range(0, len(slices), step)]
    return np.concatenate(parts).reshape(stack.shape)


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, pa.field(name, column.type), column)


def map_payloads(kernel: Callable[[np.ndarray], np.ndarray]):
    """A ``mapInArrow`` function that replaces ``pixels`` by ``kernel(stack)``, shape kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks: list[np.ndarray] = [None] * batch.num_rows
            for rows, stack in stacks(batch):
                result = kernel(stack)
                if result.shape != stack.shape or result.dtype != np.uint8:
                    raise ValueError(f"filter returned {result.dtype}{result.shape} for uint8{stack.shape}")
                for i, r in enumerate(rows):
                    chunks[r] = result[i].ravel()
            yield with_column(batch, "pixels", binary_column(chunks))

    return run
