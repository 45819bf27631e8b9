"""Translation between neighbouring tiles by phase correlation of their facing planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.batches import binary_column, ints, payload_view
from voxelloom.schema import AXES, BOX, VOLUME

_PAIR = [*VOLUME, "axis", "x", "y", "z", "width", "height"]
# Frequencies weaker than this carry no phase.
WEAK = 1e-6


def phase_shift(fixed: np.ndarray, moving: np.ndarray) -> tuple[int, int, float]:
    """Cyclic (row, column) shift that carries ``fixed`` onto ``moving``, and the height of its peak."""
    cross = np.conj(np.fft.fft2(fixed)) * np.fft.fft2(moving)
    strength = np.abs(cross)
    phase = np.where(strength > WEAK, cross / np.where(strength > WEAK, strength, 1.0), 0.0)
    surface = np.round(np.fft.ifft2(phase).real, 6)
    row, col = np.unravel_index(np.argmax(surface), surface.shape)
    peak = float(surface[row, col])
    height, width = surface.shape
    return int(row - height if row > height // 2 else row), int(col - width if col > width // 2 else col), peak


def _facing_planes(batches):
    """Two border planes per axis and tile, keyed by the origin of the lower tile of the pair."""
    names = [*_PAIR, "upper", "plane"]
    for batch in batches:
        data, starts = payload_view(batch.column("pixels"))
        volume, boxes = ints(batch, VOLUME), ints(batch, BOX)
        rows, planes = [], []
        for r in range(batch.num_rows):
            stack = data[starts[r] : starts[r + 1]].reshape(boxes[r, :2:-1])
            origin, dims = boxes[r, :3], boxes[r, 3:]
            for a, axis in enumerate(AXES):
                view = np.moveaxis(stack, 2 - a, 0)
                height, width = view.shape[1:]
                end = origin.copy()
                end[a] += dims[a]
                # a pair is known by the point where the upper tile starts
                for upper, corner, plane in ((False, end, view[-1]), (True, origin, view[0])):
                    rows.append((*volume[r].tolist(), axis, *corner.tolist(), width, height, upper))
                    planes.append(np.ascontiguousarray(plane).reshape(-1))
        if rows:
            types = [pa.int32()] * 2 + [pa.string()] + [pa.int32()] * 5 + [pa.bool_()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([*columns, binary_column(planes)], names=names)


def _correlate(batches):
    for batch in batches:
        size = ints(batch, ["height", "width"])
        a, a_starts = payload_view(batch.column("lower_plane"))
        b, b_starts = payload_view(batch.column("upper_plane"))
        found = [
            phase_shift(
                a[a_starts[r] : a_starts[r + 1]].reshape(size[r]).astype(np.float64),
                b[b_starts[r] : b_starts[r + 1]].reshape(size[r]).astype(np.float64),
            )
            for r in range(batch.num_rows)
        ]
        head = [batch.column(c) for c in _PAIR[:6]]
        row, col, peak = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*head, pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(peak, pa.float64())],
            names=[*_PAIR[:6], "shift_row", "shift_col", "peak"],
        )


def register_pairs(tiles: DataFrame) -> DataFrame:
    """One row per pair of tiles that share a whole face: the shift between the two facing planes.

    Only border planes are shuffled. A pair is named by its axis and the origin of its upper tile. Of
    several tiles with the same place the greatest plane, byte by byte, is used.
    """
    fields = "image_id int, zoom_out int, axis string, x int, y int, z int, width int, height int"
    planes = tiles.select(*VOLUME, *BOX, "pixels").mapInArrow(
        _facing_planes, fields + ", upper boolean, plane binary"
    )
    # map-side maxima keep copies of a tile out of the shuffle
    paired = planes.groupBy(*_PAIR).agg(
        F.max(F.when(~F.col("upper"), F.col("plane"))).alias("lower_plane"),
        F.max(F.when(F.col("upper"), F.col("plane"))).alias("upper_plane"),
    )
    both = paired.where(F.col("lower_plane").isNotNull() & F.col("upper_plane").isNotNull())
    schema = "image_id int, zoom_out int, axis string, x int, y int, z int, shift_row int, shift_col int, peak double"
    return both.mapInArrow(_correlate, schema)
