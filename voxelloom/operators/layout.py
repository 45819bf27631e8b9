"""Views of a tile: extents, slices, voxel rows, strip coordinates, flips and listings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.batches import map_payloads, payload_view, stacks
from voxelloom.operators.blocks import Part, Row, fold_blocks
from voxelloom.schema import AXES, BOX, ORIGIN, TILE_META, VOXELS

# The text of every byte with a comma after it, and which of its characters are shown.
_DIGITS = np.array([list(b"%03d," % v) for v in range(256)], np.uint8)
_SHOWN = np.array([[v > 99, v > 9, True, True] for v in range(256)])
# Voxel rows per outgoing Arrow batch.
VOXEL_ROWS = 1 << 18


def tile_extents(tiles: DataFrame) -> DataFrame:
    """Exclusive ends of the box on each axis."""
    ends = [(F.col(a).cast("long") + F.col(f"{a}_dim")).alias(f"{a}_end") for a in AXES]
    return tiles.select("image_id", "name", *ORIGIN, *ends)


def tile_sizes(tiles: DataFrame) -> DataFrame:
    """Key and payload length of every tile."""
    return tiles.select("image_id", "name", F.octet_length("pixels").alias("n_bytes"))


def slice_bytes(index: Column) -> Column:
    """Payload of one z-slice (0-based) of the current tile."""
    size = F.col("x_dim") * F.col("y_dim")
    return F.substring(F.col("pixels"), index * size + 1, size)


def tile_slices(tiles: DataFrame) -> DataFrame:
    """One row per z-slice, ``z`` being the slice's absolute coordinate."""
    kept = [c for c in tiles.columns if c not in ("pixels", "z", "z_dim")]
    numbered = tiles.withColumn("_iz", F.explode(F.sequence(F.lit(0), F.col("z_dim") - 1)))
    return numbered.select(
        *kept, (F.col("z") + F.col("_iz")).alias("z"), slice_bytes(F.col("_iz")).alias("pixels")
    )


def last_slice(tiles: DataFrame) -> DataFrame:
    """Only the topmost slice of each tile."""
    kept = [c for c in tiles.columns if c not in ("pixels", "z", "z_dim")]
    top = F.col("z_dim") - 1
    return tiles.select(*kept, (F.col("z") + top).alias("z"), slice_bytes(top).alias("pixels"))


def _voxel_batches(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        head = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ["image_id", *ORIGIN]}
        for rows, stack in stacks(batch, VOXEL_ROWS):
            count, depth, height, width = stack.shape
            # a single large tile is cut along z, so that outgoing batches stay small
            step = max(1, VOXEL_ROWS // (count * height * width))
            for z0 in range(0, depth, step):
                part = stack[:, z0 : z0 + step]
                shape = part.shape
                local = {
                    "z": np.arange(z0, z0 + shape[1]).reshape(1, -1, 1, 1),
                    "y": np.arange(height).reshape(1, 1, -1, 1),
                    "x": np.arange(width).reshape(1, 1, 1, -1),
                }
                values = {
                    a: np.broadcast_to(head[a][rows].reshape(-1, 1, 1, 1) + local[a], shape) for a in AXES
                }
                values["image_id"] = np.broadcast_to(head["image_id"][rows].reshape(-1, 1, 1, 1), shape)
                values["v"] = part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[f].reshape(-1).astype(np.int32)) for f in fields], names=fields
                )


def voxel_explode(tiles: DataFrame) -> DataFrame:
    """One row per voxel in absolute coordinates; a narrow step without a shuffle."""
    fields = VOXELS.fieldNames()

    def run(batches):
        return _voxel_batches(batches, fields)

    return tiles.select("image_id", *BOX, "pixels").mapInArrow(run, VOXELS)


def tiles_from_voxels(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Inverse of :func:`voxel_explode` for a grid of ``dims`` = (x, y, z) sized tiles anchored at 0.

    Each group is one tile's box, so its size is bounded by ``dims``; voxels that are absent become 0 and
    of several values for one voxel the greatest is kept. Voxels are shuffled once, to their tile.
    """
    keys = ["image_id", *ORIGIN]
    placed = voxels
    for axis, dim in zip(AXES, dims):
        placed = placed.withColumn(f"_{axis}", F.pmod(F.col(axis), F.lit(dim))).withColumn(
            axis, F.col(axis) - F.col(f"_{axis}")
        )
    width, height, depth = dims
    offset = (F.col("_z") * height + F.col("_y")) * width + F.col("_x")

    def fold(key: tuple, parts: Iterator[Part]) -> Iterable[Row]:
        payload = np.zeros(width * height * depth, np.uint8)
        for part in parts:
            at, values = part.ints(["_at", "v"]).T
            np.maximum.at(payload, at, values.astype(np.uint8))
        yield key, payload

    schema = pa.schema([*[(c, pa.int32()) for c in keys], ("pixels", pa.binary())])
    return fold_blocks(placed.select(*keys, offset.alias("_at"), "v"), keys, schema, fold)


def strip_layout(tiles: DataFrame) -> DataFrame:
    """Voxels at their (row, col) place in the vertical strip of stacked slices."""
    schema = "image_id int, name string, row int, col int, v int"

    def run(batches):
        for batch in batches:
            names = batch.column("name")
            image = batch.column("image_id").to_numpy(zero_copy_only=False)
            for rows, stack in stacks(batch, VOXEL_ROWS):
                for first in range(rows.size):
                    strip = stack[first].reshape(-1, stack.shape[-1])
                    height, width = strip.shape
                    step = max(1, VOXEL_ROWS // width)
                    for top in range(0, height, step):
                        part = strip[top : top + step]
                        size = part.size
                        line, col = np.divmod(np.arange(size, dtype=np.int32), np.int32(width))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(size, image[rows[first]], np.int32)),
                                names.take(pa.array(np.full(size, rows[first]))),
                                pa.array(line + np.int32(top)),
                                pa.array(col),
                                pa.array(part.reshape(-1).astype(np.int32)),
                            ],
                            names=["image_id", "name", "row", "col", "v"],
                        )

    return tiles.select(*TILE_META, "pixels").mapInArrow(run, schema)


def pixels_csv(tiles: DataFrame) -> DataFrame:
    """Payload as comma separated unsigned numbers."""

    def run(batches):
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            for r in range(batch.num_rows):
                # every value as three characters and a comma; leading zeros are left out afterwards
                values = data[starts[r] : starts[r + 1]]
                text = _DIGITS[values][_SHOWN[values]].tobytes()[:-1].decode()
                head = [batch.column(c).slice(r, 1) for c in ("image_id", "name")]
                yield pa.RecordBatch.from_arrays([*head, pa.array([text])], names=["image_id", "name", "csv"])

    return tiles.select(*TILE_META, "pixels").mapInArrow(run, "image_id int, name string, csv string")


def flip(tiles: DataFrame, horizontal: bool = False, vertical: bool = False) -> DataFrame:
    """Mirror every slice left-right and/or top-bottom."""
    x_step = -1 if horizontal else 1
    y_step = -1 if vertical else 1
    kernel = map_payloads(lambda stack: stack[:, :, ::y_step, ::x_step])
    return tiles.mapInArrow(kernel, tiles.schema)
