"""FFT band-pass of every slice: mirror padding, frequency filter, crop and rescale."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.batches import ints, map_payloads, per_slices, stacks
from voxelloom.operators.layout import VOXEL_ROWS
from voxelloom.schema import TILE_META

STRIPES = ("none", "horizontal", "vertical")
# Canvas samples transformed at once; bounds the working memory of a task.
CANVAS_SAMPLES = 1 << 21
# Longest side of a slice that is filtered by matrix products instead of a transform.
MATRIX_SIZE = 256
# A filtered slice whose range is below this has no contrast to stretch.
FLAT = 1e-6


@dataclass(frozen=True)
class Band:
    """Structures larger than ``large`` and smaller than ``small`` pixels are suppressed."""

    large: float = 40.1
    small: float = 3.0
    stripes: str = "none"
    tolerance: float = 5.0
    scale: bool = True
    saturate: bool = True

    def __post_init__(self):
        object.__setattr__(self, "stripes", self.stripes.lower())
        if self.stripes not in STRIPES:
            raise ValueError(f"stripes must be one of {STRIPES}")


def pad_size(width: int, height: int) -> int:
    """Smallest power of two, from 2, that is at least 1.5 times the longer side."""
    return 1 << max(1, (-(-3 * max(width, height) // 2) - 1).bit_length())


def pad_size_column(width: Column, height: Column) -> Column:
    half = F.ceil(F.greatest(width, height).cast("long") * 3 / 2).cast("long")
    bits = F.when(half <= 1, F.lit(0)).otherwise(F.length(F.bin(half - 1)))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(1), bits))


def fft_pad_size(boxes: DataFrame, width: str, height: str) -> DataFrame:
    """Canvas edge for each row's slice."""
    return boxes.withColumn("pad_size", pad_size_column(F.col(width), F.col(height)))


def canvas_origin(canvas: int, size: int) -> int:
    """Where a centred slice starts on the canvas, half rounded up."""
    origin = (canvas - size + 1) // 2
    if not 0 <= origin < canvas:
        raise ValueError(f"a slice of {size} does not fit a canvas of {canvas}")
    return origin


def mirror_index(canvas: int, size: int) -> np.ndarray:
    """Source index for every canvas position; reflections repeat the edge pixel."""
    place = (np.arange(canvas) - canvas_origin(canvas, size)) % (2 * size)
    return np.where(place < size, place, 2 * size - 1 - place)


def filter_grid(canvas: int, band: Band) -> np.ndarray:
    """Factor for every (row, column) frequency; the mean grey value is left alone."""
    k = np.arange(canvas)
    square = np.minimum(k, canvas - k).astype(np.float64) ** 2
    radius = square[:, None] + square[None, :]
    large, small = 2 * band.large / canvas, 2 * band.small / canvas
    grid = (1 - np.exp(-radius * large**2)) * np.exp(-radius * small**2)
    sharp = ((100 - band.tolerance) / 100) ** 2
    if band.stripes == "horizontal":
        grid *= (1 - np.exp(-square * sharp))[None, :]
    elif band.stripes == "vertical":
        grid *= (1 - np.exp(-square * sharp))[:, None]
    grid[0, 0] = 1.0
    return grid


def _transform(slices: np.ndarray, band: Band) -> np.ndarray:
    """Pad, transform, multiply, transform back and crop."""
    _, height, width = slices.shape
    canvas = pad_size(width, height)
    rows, cols = mirror_index(canvas, height), mirror_index(canvas, width)
    grid = filter_grid(canvas, band)[:, : canvas // 2 + 1]
    top, left = canvas_origin(canvas, height), canvas_origin(canvas, width)
    out = np.empty(slices.shape)
    step = max(1, CANVAS_SAMPLES // (canvas * canvas))
    for i in range(0, len(slices), step):
        padded = slices[i : i + step][:, rows[:, None], cols[None, :]].astype(np.float64)
        filtered = np.fft.irfft2(np.fft.rfft2(padded) * grid, s=(canvas, canvas))
        out[i : i + step] = filtered[:, top : top + height, left : left + width]
    return out


@lru_cache(maxsize=64)
def _line_matrix(canvas: int, size: int, decay: float, sharp: float | None) -> np.ndarray:
    """What one axis of the whole chain does to a line of pixels: pad, filter by a Gaussian, crop."""
    k = np.arange(canvas)
    square = np.minimum(k, canvas - k).astype(np.float64) ** 2
    gain = np.exp(-square * decay)
    if sharp is not None:
        gain = gain * (1 - np.exp(-square * sharp))
    response = np.fft.ifft(gain).real
    place = canvas_origin(canvas, size) + np.arange(size)
    spread = response[(place[:, None] - k[None, :]) % canvas]
    matrix = np.zeros((size, size))
    np.add.at(matrix.T, mirror_index(canvas, size), spread.T)
    return matrix


def _multiply(slices: np.ndarray, band: Band) -> np.ndarray:
    """The same as :func:`_transform` by matrix products.

    Without the mean the filter is a difference of two Gaussians, each a product of a row and a column part;
    padding and cropping act on rows and columns separately as well. The mean of the canvas is added back.
    """
    _, height, width = slices.shape
    canvas = pad_size(width, height)
    large, small = (2 * band.large / canvas) ** 2, (2 * band.small / canvas) ** 2
    sharp = ((100 - band.tolerance) / 100) ** 2
    row_sharp = sharp if band.stripes == "vertical" else None
    col_sharp = sharp if band.stripes == "horizontal" else None
    grey = slices.astype(np.float64)
    decays = (small, small + large)
    rows = np.hstack([_line_matrix(canvas, height, d, row_sharp) * f for d, f in zip(decays, (1, -1))])
    cols = [_line_matrix(canvas, width, d, col_sharp) for d in decays]
    both = np.concatenate([grey @ c.T for c in cols], axis=1)
    row_share = np.bincount(mirror_index(canvas, height), minlength=height) / canvas
    col_share = np.bincount(mirror_index(canvas, width), minlength=width) / canvas
    return rows @ both + ((grey @ col_share) @ row_share)[:, None, None]


def filter_slices(slices: np.ndarray, band: Band) -> np.ndarray:
    """Filtered slices as floats, cropped to the original size."""
    return (_multiply if max(slices.shape[1:]) <= MATRIX_SIZE else _transform)(slices, band)


def to_grey(filtered: np.ndarray, band: Band, top: int = 255) -> np.ndarray:
    """Floats to 0..top: stretched to the slice's own range if asked for, else clamped."""
    if band.scale:
        flat = filtered.reshape(len(filtered), -1)
        size = flat.shape[1]
        clipped = int(size / 200.0) if band.saturate else 0
        order = np.sort(flat, axis=1)
        low, high = order[:, clipped, None, None], order[:, size - 1 - clipped, None, None]
        span = high - low
        usable = span > FLAT
        grey = filtered - np.where(usable, low, 0.0)
        grey /= np.where(usable, span, float(top))
        grey *= float(top)
    else:
        grey = filtered.copy()
    grey += 0.5
    np.clip(grey, 0, top, out=grey)
    return grey.astype(np.uint8 if top == 255 else np.uint16)


def bandpass_slices(slices: np.ndarray, band: Band) -> np.ndarray:
    return to_grey(filter_slices(slices, band), band)


def bandpass(tiles: DataFrame, band: Band = Band()) -> DataFrame:
    """Filter every slice of every tile; a narrow step."""
    return tiles.mapInArrow(map_payloads(lambda s: per_slices(s, lambda part: bandpass_slices(part, band))), tiles.schema)


def mirror_pad(tiles: DataFrame) -> DataFrame:
    """Every slice on its mirrored canvas, one row per canvas pixel."""
    schema = "image_id int, name string, z int, row int, col int, v int"

    def run(batches):
        for batch in batches:
            heads = ints(batch, ["image_id", "z"])
            names = batch.column("name")
            for rows, stack in stacks(batch, VOXEL_ROWS // 4):
                n, depth, height, width = stack.shape
                canvas = pad_size(width, height)
                source_row, source_col = mirror_index(canvas, height), mirror_index(canvas, width)
                slices = stack.reshape(n * depth, height, width)
                step = max(1, VOXEL_ROWS // (canvas * canvas))
                for i in range(0, len(slices), step):
                    padded = slices[i : i + step][:, source_row[:, None], source_col[None, :]]
                    which, row, col = np.unravel_index(np.arange(padded.size), padded.shape)
                    tile, iz = rows[(which + i) // depth], (which + i) % depth
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(heads[tile, 0].astype(np.int32)),
                            names.take(pa.array(tile)),
                            pa.array((heads[tile, 1] + iz).astype(np.int32)),
                            pa.array(row.astype(np.int32)),
                            pa.array(col.astype(np.int32)),
                            pa.array(padded.reshape(-1).astype(np.int32)),
                        ],
                        names=["image_id", "name", "z", "row", "col", "v"],
                    )

    return tiles.select(*TILE_META, "pixels").mapInArrow(run, schema)


def bandpass_filter_grid(tiles: DataFrame, band: Band = Band()) -> DataFrame:
    """The frequency factors of every canvas size that occurs among the tiles."""
    sizes = tiles.select(pad_size_column(F.col("x_dim"), F.col("y_dim")).alias("canvas")).distinct()
    index = F.sequence(F.lit(0).cast("long"), F.col("canvas") - 1)
    grid = sizes.withColumn("row", F.explode(index)).withColumn("col", F.explode(index))

    def square(k: str) -> Column:
        near = F.least(F.col(k), F.col("canvas") - F.col(k)).cast("double")
        return near * near

    radius = square("row") + square("col")
    large, small = F.lit(2 * band.large) / F.col("canvas"), F.lit(2 * band.small) / F.col("canvas")
    factor = (1 - F.exp(-radius * large * large)) * F.exp(-radius * small * small)
    sharp = ((100 - band.tolerance) / 100) ** 2
    if band.stripes != "none":
        factor = factor * (1 - F.exp(-square("col" if band.stripes == "horizontal" else "row") * sharp))
    factor = F.when((F.col("row") == 0) & (F.col("col") == 0), F.lit(1.0)).otherwise(factor)
    return grid.select("canvas", "row", "col", F.lit(band.stripes).alias("stripes"), factor.alias("factor"))
