"""Gaussian blur across tile borders by an exchange of border slabs.

Tiles send their voxels to every grid cell whose box, widened by the kernel radius, they touch. A cell
then holds all it needs to blur its own voxels. Missing voxels take no part: the result is divided by the sum
of the weights that were used. At the edge of an image the border voxel is repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from voxelloom.functions.batches import ints, payload_view
from voxelloom.operators.blocks import PIECE, Part, PieceBuffer, Row, cut, fold_blocks, paste
from voxelloom.operators.gauss import blur_axis, kernel_weights, weighted_sum
from voxelloom.schema import AXES, BOX, DIMS, TILE_META, VOLUME

# Image bounds that may be sent to every executor (one small row per image).
BROADCAST_IMAGES = 500_000
# Shares into which the rows of one image are dealt when bounds have to be shuffled.
IMAGE_SHARES = 64
# Smallest default cell edge; small tiles share a cell, so that slabs stay a small part of the data.
CELL_EDGE = 64
# Most voxels of a default cell.
CELL_VOXELS = 1 << 26

_BOUNDS = ["x_lo", "y_lo", "z_lo", "x_hi", "y_hi", "z_hi"]
_CELL = ["cx", "cy", "cz"]


def with_bounds(tiles: DataFrame) -> DataFrame:
    """Add the exclusive bounds of the whole image to each tile row."""
    lows = [F.min(a).alias(f"{a}_lo") for a in AXES]
    highs = [F.max(F.col(a) + F.col(f"{a}_dim")).alias(f"{a}_hi") for a in AXES]
    bounds = tiles.groupBy(*VOLUME).agg(*lows, *highs)
    if bounds.limit(BROADCAST_IMAGES + 1).count() <= BROADCAST_IMAGES:
        return tiles.join(F.broadcast(bounds), VOLUME)
    share = F.pmod(F.xxhash64(*BOX), F.lit(IMAGE_SHARES)).cast("int")
    shares = F.explode(F.sequence(F.lit(0), F.lit(IMAGE_SHARES - 1)))
    return tiles.withColumn("_s", share).join(bounds.withColumn("_s", shares), [*VOLUME, "_s"]).drop("_s")


def _cell_for(dims: list[int]) -> tuple[int, ...]:
    """Cell edges: whole tiles of at least ``CELL_EDGE``, the longest edges halved until a cell has ``CELL_VOXELS`` at most.

    Tiles of very different shapes do not add up to a huge cell so; those that are longer than a cell straddle several.
    """
    edges = [d * -(-CELL_EDGE // d) for d in dims]
    while math.prod(edges) > CELL_VOXELS:
        longest = edges.index(max(edges))
        edges[longest] = -(-edges[longest] // 2)
    return tuple(edges)


def masked_blur(values: np.ndarray, present: np.ndarray, sigmas: tuple, core: list[slice]) -> np.ndarray:
    """Blur along x, y, z, cropping each axis to the core once it is done."""
    for axis, sigma in zip((2, 1, 0), sigmas):
        weights = kernel_weights(sigma)
        if len(weights) > 1:
            if present.all():
                values = blur_axis(values, weights, axis)
            else:
                total = weighted_sum(values, weights, axis).astype(np.int64)
                used = weighted_sum(present, weights, axis).astype(np.int64)
                blurred = (total + used // 2) // np.maximum(used, 1)
                values = np.where(present, blurred, 0).astype(np.uint8)
        crop = [slice(None)] * 3
        crop[axis] = core[axis]
        values, present = values[tuple(crop)], present[tuple(crop)]
    return values


def gauss3d_seamless(
    tiles: DataFrame,
    sigma_x: float = 1.0,
    sigma_y: float = 1.0,
    sigma_z: float = 1.0,
    cell: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Blur the volume as if it were one piece and return it as the same tiles.

    Tiles with the same image, zoom and box are one tile of the volume; the greatest value wins where
    tiles overlap. One shuffle moves every tile plus its slabs; tiles that straddle cells need a second one
    to be put together again.
    """
    sigmas = (sigma_x, sigma_y, sigma_z)
    radius = np.array([len(kernel_weights(s)) - 1 for s in sigmas], np.int64)
    shape = tiles.agg(
        *[F.min(a).alias(f"{a}_lo") for a in AXES], *[F.max(c).alias(c) for c in DIMS]
    ).first()
    if shape["x_lo"] is None:
        return tiles.select(*TILE_META, "pixels")
    anchor = np.array([shape[f"{a}_lo"] for a in AXES], np.int64)
    if cell is None:
        cell = _cell_for([shape[d] for d in DIMS])
    edge = np.array(cell, np.int64)

    aligned = F.lit(True)
    for a, low, size in zip(AXES, anchor.tolist(), cell):
        within = F.pmod(F.col(a).cast("long") - low, F.lit(size)) + F.col(f"{a}_dim")
        aligned = aligned & (within <= size)
    whole_tiles = tiles.agg(F.bool_and(aligned).alias("a")).first()["a"]

    head = [*VOLUME, *_CELL]
    carried = [*_BOUNDS, *[f"t_{c}" for c in BOX], "name", *PIECE]
    arrow = pa.schema(
        [(c, pa.string() if c == "name" else pa.int32()) for c in [*head, *carried]] + [("pixels", pa.binary())]
    )

    def send(batches):
        buffer = PieceBuffer(arrow)
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            volume, boxes, bounds = ints(batch, VOLUME), ints(batch, BOX), ints(batch, _BOUNDS)
            names = batch.column("name").to_pylist()
            for r in range(batch.num_rows):
                low, high = boxes[r, :3], boxes[r, :3] + boxes[r, 3:]
                stack = data[starts[r] : starts[r + 1]].reshape(boxes[r, :2:-1])
                first = (low - radius - anchor) // edge
                last = (high - 1 + radius - anchor) // edge
                for c in product(*[range(f, e + 1) for f, e in zip(first.tolist(), last.tolist())]):
                    start = anchor + np.array(c) * edge
                    p_low = np.maximum(low, start - radius)
                    p_high = np.minimum(high, start + edge + radius)
                    identity = (
                        *volume[r].tolist(), *c, *bounds[r].tolist(), *boxes[r].tolist(), names[r],
                        *p_low.tolist(), *(p_high - p_low).tolist(),
                    )
                    yield from buffer.add(identity, cut(stack, low, p_low, p_high))
        yield from buffer.flush()

    def blur_cell(key: tuple, parts: Iterator[Part]) -> Iterable[Row]:
        start = anchor + np.array(key[2:]) * edge
        canvas = present = None
        core_tiles: dict[tuple, str] = {}
        for part in parts:
            if canvas is None:
                bounds = part.ints(_BOUNDS)[0]
                low = np.maximum(start - radius, bounds[:3])
                high = np.minimum(start + edge + radius, bounds[3:])
                canvas = np.zeros((high - low)[::-1], np.uint8)
                present = np.zeros(canvas.shape, np.uint8)
            boxes, names = part.ints([f"t_{c}" for c in BOX]), part.texts("name")
            for r, p_low, p_high, values in part.pieces():
                paste(canvas, low, p_low, p_high, values)
                cut(present, low, p_low, p_high)[...] = 1
                c_low, c_high = np.maximum(p_low, start), np.minimum(p_high, start + edge)
                if (c_low < c_high).all():
                    box = tuple(boxes[r].tolist())
                    core_tiles[box] = min(core_tiles.get(box, names[r]), names[r])
        if not core_tiles:
            return
        c_low, c_high = np.maximum(start, low), np.minimum(start + edge, high)
        core = [slice(int(a), int(b)) for a, b in zip((c_low - low)[::-1], (c_high - low)[::-1])]
        result = masked_blur(canvas, present, sigmas, core)
        for box, name in core_tiles.items():
            origin, dims = np.array(box[:3]), np.array(box[3:])
            p_low, p_high = np.maximum(origin, c_low), np.minimum(origin + dims, c_high)
            row = (*key[:2], *box, name, *p_low.tolist(), *(p_high - p_low).tolist())
            yield row, cut(result, c_low, p_low, p_high)

    blurred_schema = pa.schema(
        [(c, pa.string() if c == "name" else pa.int32()) for c in [*VOLUME, *BOX, "name", *PIECE]]
        + [("pixels", pa.binary())]
    )
    sent = with_bounds(tiles.select(*TILE_META, "pixels")).mapInArrow(send, from_arrow_schema(arrow))
    blurred = fold_blocks(sent, head, blurred_schema, blur_cell)
    if whole_tiles:
        return blurred.select(*TILE_META, "pixels")
    return join_pieces(blurred)


def join_pieces(pieces: DataFrame) -> DataFrame:
    """Put the pieces of each tile together again."""
    keys = [*VOLUME, *BOX]

    def fold(key: tuple, parts: Iterator[Part]) -> Iterable[Row]:
        box = np.array(key[2:])
        canvas = np.zeros(box[:2:-1], np.uint8)
        names: set[str] = set()
        for part in parts:
            names.add(min(part.texts("name")))
            for _, low, high, values in part.pieces():
                paste(canvas, box[:3], low, high, values)
        yield (*key, min(names)), canvas

    schema = pa.schema(
        [*[(c, pa.int32()) for c in keys], ("name", pa.string()), ("pixels", pa.binary())]
    )
    return fold_blocks(pieces, keys, schema, fold).select(*TILE_META, "pixels")
