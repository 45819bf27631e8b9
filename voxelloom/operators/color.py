"""Filters on the brightness of colour tiles, with hue and saturation kept.

A colour tile has a second payload, ``color``: three bytes per voxel, blue, green, red, in the order of ``pixels``. Its brightness is
the greatest channel. Where a filter changes the brightness of a voxel from ``b`` to ``n``, every channel ``c`` becomes
``c * n / b``, rounded half up, which keeps hue and saturation; a black voxel has no hue and becomes grey. Everything is a
narrow step: colours travel beside the grey payload and are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.batches import binary_column, map_payloads, payload_view
from voxelloom.operators.filters import Filter, bound_filter

CHANNELS = ("blue", "green", "red")


def _replaced(column: str, kernel, *inputs: str):
    """A ``mapInArrow`` function that replaces ``column`` by ``kernel`` of the payloads of ``inputs``, row by row; a null input leaves the row as it is."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            sides = [batch.column(c) for c in inputs]
            given = np.logical_and.reduce([side.is_valid().to_numpy(zero_copy_only=False) for side in sides])
            views = [payload_view(side.fill_null(b"")) for side in sides]
            parts = []
            for r, known in enumerate(given.tolist()):
                own = [data[starts[r] : starts[r + 1]] for data, starts in views]
                parts.append(kernel(*own) if known else None)
            if all(part is not None for part in parts):
                made = binary_column(parts)
            else:
                old = batch.column(at).to_pylist()
                made = pa.array([old[r] if part is None else part.tobytes() for r, part in enumerate(parts)], pa.binary())
            yield pa.RecordBatch.from_arrays([made if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return run


def brightness(color: np.ndarray) -> np.ndarray:
    """The greatest channel of each voxel."""
    return color.reshape(-1, len(CHANNELS)).max(axis=1)


def rescaled(color: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The colours with this brightness."""
    channels = color.reshape(-1, len(CHANNELS)).astype(np.int32)
    if len(channels) != len(wanted):
        raise ValueError(f"{color.size} bytes of colour do not fit {wanted.size} voxels")
    own = channels.max(axis=1)[:, None]
    new = wanted.astype(np.int32)[:, None]
    scaled = (2 * channels * new + own) // np.maximum(2 * own, 1)
    return np.where(own > 0, scaled, new).astype(np.uint8).reshape(-1)


_TO_BRIGHTNESS = _replaced("pixels", brightness, "color")
_TO_COLOR = _replaced("color", rescaled, "color", "pixels")


def with_brightness(tiles: DataFrame) -> DataFrame:
    """``pixels`` replaced by the brightness of ``color``; tiles without colour keep theirs."""
    return tiles.mapInArrow(_TO_BRIGHTNESS, tiles.schema)


def write_back(tiles: DataFrame) -> DataFrame:
    """``color`` with the brightness that ``pixels`` holds; tiles without colour stay without."""
    return tiles.mapInArrow(_TO_COLOR, tiles.schema)


def filter_color(tiles: DataFrame, spec: str | Filter, params: Mapping[str, object] | None = None) -> DataFrame:
    """Run a filter over the brightness of every tile and write it back into the colours. Grey tiles, whose ``color`` is
    null, are filtered as they are. The three steps run in one Python worker."""
    filtered = map_payloads(bound_filter(spec, params))
    return tiles.mapInArrow(lambda batches: _TO_COLOR(filtered(_TO_BRIGHTNESS(batches))), tiles.schema)


def channel(tiles: DataFrame, name: str) -> DataFrame:
    """One channel as grey tiles; that of a grey tile is its ``pixels``."""
    at = CHANNELS.index(name)
    run = _replaced("pixels", lambda color: np.ascontiguousarray(color[at :: len(CHANNELS)]), "color")
    return tiles.mapInArrow(run, tiles.schema).drop("color")


def channels(tiles: DataFrame, of_tiles) -> DataFrame:
    """``of_tiles`` of each channel, with its name as ``channel``."""
    parts = [of_tiles(channel(tiles, name)).withColumn("channel", F.lit(name)) for name in CHANNELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
