"""Tiles of 8 and 16 bit and of floating grey values.

A table of typed tiles has a column ``pixel_type`` beside the payload: ``uint8``, ``uint16`` or ``float32``, little-endian, in the
same order of voxels as 8-bit tiles. A table without the column holds ``uint8``. Kernels keep the type of each tile; types may
differ between tiles of one table. 8-bit results equal those of the 8-bit operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.functions.batches import STACK_VOXELS, binary_column, ints, payload_view, with_column
from voxelloom.operators import gauss
from voxelloom.operators.bandpass import Band, filter_slices, to_grey
from voxelloom.operators.histogram import stretch
from voxelloom.operators.threshold import binarise
from voxelloom.schema import AXES, BOX, DIMS, ORIGIN, TILE_META, VOLUME

DTYPES = {"uint8": np.dtype("u1"), "uint16": np.dtype("<u2"), "float32": np.dtype("<f4")}
#: Grey levels that a threshold method tells apart; wider ranges are cut into as many equal bins.
BINS = 256


def as_typed(tiles: DataFrame) -> DataFrame:
    """The table with a ``pixel_type``; 8 bits where it had none."""
    return tiles if "pixel_type" in tiles.columns else tiles.withColumn("pixel_type", F.lit("uint8"))


def top_of(dtype: np.dtype) -> int:
    return int(np.iinfo(dtype).max)


def typed_stacks(batch: pa.RecordBatch, max_voxels: int = STACK_VOXELS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal shape and type as ``(row numbers, array (rows, z, y, x))``."""
    if batch.num_rows == 0:
        return
    data, starts = payload_view(batch.column("pixels"))
    names = batch.column("pixel_type").to_pylist()
    unknown = sorted({str(n) for n in names} - set(DTYPES))
    if unknown:
        raise ValueError(f"unknown pixel type {unknown[0]}")
    dims = ints(batch, DIMS)
    size = np.array([DTYPES[n].itemsize for n in names])
    wrong = np.flatnonzero((np.diff(starts) != dims.prod(axis=1) * size) | (dims <= 0).any(axis=1))
    if wrong.size:
        row = int(wrong[0])
        raise ValueError(f"payload of {int(starts[row + 1] - starts[row])} bytes does not fill box {dims[row].tolist()} of {names[row]}")
    groups: dict[tuple, list[int]] = {}
    for row, name in enumerate(names):
        groups.setdefault((name, *dims[row].tolist()), []).append(row)
    for (name, width, height, depth), rows in groups.items():
        step = max(1, max_voxels // (width * height * depth))
        for first in range(0, len(rows), step):
            part = np.array(rows[first : first + step])
            flat = np.concatenate([data[starts[r] : starts[r + 1]] for r in part]).view(DTYPES[name])
            yield part, flat.reshape(part.size, depth, height, width)


def map_typed(kernel: Callable[[np.ndarray], np.ndarray]):
    """A ``mapInArrow`` function that replaces payloads by ``kernel(stack)``, of the same shape and of any known type."""
    of = {dtype: name for name, dtype in DTYPES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks: list = [None] * batch.num_rows
            names: list = [None] * batch.num_rows
            for rows, stack in typed_stacks(batch):
                result = kernel(stack)
                if result.shape != stack.shape or result.dtype not in of:
                    raise ValueError(f"filter returned {result.dtype}{result.shape} for {stack.dtype}{stack.shape}")
                for at, row in enumerate(rows):
                    chunks[row] = np.ascontiguousarray(result[at]).reshape(-1).view(np.uint8)
                    names[row] = of[result.dtype]
            out = with_column(batch, "pixels", binary_column(chunks))
            yield with_column(out, "pixel_type", pa.array(names, pa.string()))

    return run


def _apply(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    tiles = as_typed(tiles)
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "pixel_type" else f for f in tiles.schema])
    return tiles.mapInArrow(map_typed(kernel), schema)


def _per_slice(stack: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Run a kernel over slices of an (n, z, y, x) stack, a bounded number of voxels at a time."""
    slices = stack.reshape(-1, *stack.shape[2:])
    step = max(1, STACK_VOXELS // (slices.shape[1] * slices.shape[2]))
    return np.concatenate([kernel(slices[at : at + step]) for at in range(0, len(slices), step)]).reshape(stack.shape)


def blur(stack: np.ndarray, sigmas: tuple[float, float, float]) -> np.ndarray:
    """Passes along x, y and z as in 8 bits: whole numbers are rounded half up after each pass, exactly; floats to single precision."""
    if stack.dtype == np.uint8:
        return gauss.blur(stack, sigmas)
    for axis, sigma in zip((gauss.X, gauss.Y, gauss.Z), sigmas, strict=True):
        weights = gauss.kernel_weights(sigma)
        if len(weights) > 1:
            stack = _blur_axis(stack, weights, axis)
    return stack


def _blur_axis(stack: np.ndarray, weights: list[int], axis: int) -> np.ndarray:
    radius, size = len(weights) - 1, stack.shape[axis]
    pad = [(0, 0)] * stack.ndim
    pad[axis] = (radius, radius)
    whole = stack.dtype.kind == "u"
    wide = np.pad(stack.astype(np.int64 if whole else np.float64), pad, mode="edge")

    def shifted(offset: int) -> np.ndarray:
        window = [slice(None)] * stack.ndim
        window[axis] = slice(radius + offset, radius + offset + size)
        return wide[tuple(window)]

    total = shifted(0) * weights[0]
    for offset, weight in enumerate(weights[1:], 1):
        total = total + (shifted(-offset) + shifted(offset)) * weight
    return ((total + gauss.ONE // 2) // gauss.ONE if whole else total / gauss.ONE).astype(stack.dtype)


def gauss3d_typed(tiles: DataFrame, sigma_x: float = 1.0, sigma_y: float = 1.0, sigma_z: float = 1.0) -> DataFrame:
    """Blur each tile in isolation, in its own type; a narrow step."""
    sigmas = (sigma_x, sigma_y, sigma_z)
    return _apply(tiles, lambda stack: blur(stack, sigmas))


def _ends(slices: np.ndarray, saturated: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each slice after leaving out ``saturated`` percent of the pixels, half at each end."""
    flat = np.sort(slices.reshape(len(slices), -1), axis=1)
    cut = min(int(flat.shape[1] * saturated / 200), (flat.shape[1] - 1) // 2)
    return flat[:, cut, None, None], flat[:, flat.shape[1] - 1 - cut, None, None]


def _stretched(slices: np.ndarray, saturated: float) -> np.ndarray:
    if slices.dtype == np.uint8:
        return stretch(slices, saturated)
    low, high = _ends(slices, saturated)
    if slices.dtype.kind == "f":
        span = np.where(high > low, high.astype(np.float64) - low, 1.0)
        return np.where(high > low, np.clip((slices.astype(np.float64) - low) / span, 0, 1), slices).astype(slices.dtype)
    top, low, high = top_of(slices.dtype), low.astype(np.int64), high.astype(np.int64)
    span = np.maximum(high - low, 1)
    grey = np.clip(slices.astype(np.int64) - low, 0, span)
    return np.where(high > low, (2 * top * grey + span) // (2 * span), slices).astype(slices.dtype)


def stretch_typed(tiles: DataFrame, saturated: float = 1.0) -> DataFrame:
    """Stretch every slice to the whole range of its type, rounding half up; floats to 0..1. A slice without a range is kept."""
    return _apply(tiles, lambda stack: _per_slice(stack, lambda part: _stretched(part, saturated)))


def _converted(slices: np.ndarray, to: np.dtype, scale: bool) -> np.ndarray:
    if slices.dtype == to:
        return slices
    if to.kind == "f":
        return slices.astype(to)
    top = top_of(to)
    if not scale:
        return np.clip(np.floor(slices.astype(np.float64) + 0.5), 0, top).astype(to)
    low, high = _ends(slices, 0.0)
    if slices.dtype.kind == "u":
        low, span = low.astype(np.int64), np.maximum(high.astype(np.int64) - low, 1)
        scaled = (2 * top * (slices.astype(np.int64) - low) + span) // (2 * span)
        return np.where(high > low, scaled, np.minimum(slices.astype(np.int64), top)).astype(to)
    low, high = low.astype(np.float64), high.astype(np.float64)
    span = np.where(high > low, high - low, 1.0)
    scaled = np.floor((slices - low) / span * top + 0.5)
    return np.clip(np.where(high > low, scaled, np.floor(slices + 0.5)), 0, top).astype(to)


def convert_type(tiles: DataFrame, to: str, scale: bool = True) -> DataFrame:
    """Payloads in another type. With ``scale`` the range of each slice becomes the whole range of a type of whole numbers, a slice
    of one value is clamped; without it values are rounded half up and clamped. Floats take values as they are."""
    if to not in DTYPES:
        raise ValueError(f"unknown pixel type {to}")
    return _apply(tiles, lambda stack: _per_slice(stack, lambda part: _converted(part, DTYPES[to], scale)))


def binned(slices: np.ndarray) -> np.ndarray:
    """Bins 0..255 of equal width over the range of each slice; 8-bit slices are their own bins."""
    if slices.dtype == np.uint8:
        return slices
    low, high = _ends(slices, 0.0)
    if slices.dtype.kind == "u":
        span = high.astype(np.int64) - low + 1
        # a range that has no more values than there are bins keeps them apart
        return ((slices.astype(np.int64) - low) * BINS // np.maximum(span, BINS)).astype(np.uint8)
    low, high = low.astype(np.float64), high.astype(np.float64)
    span = np.where(high > low, high - low, 1.0)
    return np.minimum((slices - low) / span * BINS, BINS - 1).astype(np.uint8)


def threshold_typed(tiles: DataFrame, method: str = "Default", dark: bool = True) -> DataFrame:
    """Automatic threshold per slice, over the slice's bins: 8-bit tiles of 0 and 255."""
    return _apply(tiles, lambda stack: _per_slice(stack, lambda part: binarise(binned(part), method, dark)))


def _filtered(slices: np.ndarray, band: Band) -> np.ndarray:
    found = filter_slices(slices, band)
    if slices.dtype.kind == "f":
        return found.astype(slices.dtype)
    return to_grey(found, band, top_of(slices.dtype)).astype(slices.dtype)


def bandpass_typed(tiles: DataFrame, band: Band = Band()) -> DataFrame:
    """Filter every slice and give the result back in the tile's type, over its whole range if the band asks for it; floats are kept."""
    return _apply(tiles, lambda stack: _per_slice(stack, lambda part: _filtered(part, band)))


def histogram_typed(tiles: DataFrame) -> DataFrame:
    """Count of each grey value that occurs in each slice, floats as they are; counted where the tile is, without a shuffle."""
    schema = "image_id int, zoom_out int, name string, z int, v double, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, names = ints(batch, [*VOLUME, "z"]), batch.column("name")
            for rows, stack in typed_stacks(batch):
                for at, row in enumerate(rows.tolist()):
                    for iz, plane in enumerate(stack[at]):
                        value, count = np.unique(plane, return_counts=True)
                        head = [np.full(len(value), x, np.int32) for x in (*heads[row, :2], heads[row, 2] + iz)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(head[0]), pa.array(head[1]), names.take(pa.array(np.full(len(value), row))), pa.array(head[2]),
                                pa.array(value.astype(np.float64)), pa.array(count.astype(np.int64)),
                            ],
                            names=["image_id", "zoom_out", "name", "z", "v", "n"],
                        )

    return as_typed(tiles).select(*TILE_META, "pixels", "pixel_type").mapInArrow(run, schema)


def voxels_typed(tiles: DataFrame) -> DataFrame:
    """One row per voxel in absolute coordinates, with its zoom and its value as a double."""
    schema = "image_id int, zoom_out int, x int, y int, z int, v double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = ints(batch, [*VOLUME, *ORIGIN])
            for rows, stack in typed_stacks(batch, STACK_VOXELS // 4):
                for at, row in enumerate(rows.tolist()):
                    depth, height, width = stack[at].shape
                    step = max(1, (STACK_VOXELS // 4) // (height * width))
                    for first in range(0, depth, step):
                        part = stack[at][first : first + step]
                        iz, iy, ix = np.unravel_index(np.arange(part.size), part.shape)
                        image, zoom, x, y, z = heads[row].tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[pa.array(np.full(part.size, value, np.int32)) for value in (image, zoom)],
                                *[pa.array((base + offset).astype(np.int32)) for base, offset in ((x, ix), (y, iy), (z + first, iz))],
                                pa.array(part.reshape(-1).astype(np.float64)),
                            ],
                            names=["image_id", "zoom_out", *AXES, "v"],
                        )

    return as_typed(tiles).select(*VOLUME, *BOX, "pixels", "pixel_type").mapInArrow(run, schema)
