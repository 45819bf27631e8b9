"""Gaussian blur across tile borders that moves the borders only.

Where the tiles of an image lie on a lattice, a voxel farther than the kernel's radius from the planes between tiles depends on
its own tile alone. Such interiors are blurred in place, in a narrow step. Along each plane, line and point where tiles meet
lies a region as thick as the kernel on both sides; only the voxels that these regions need are shuffled. The result is the
blurred volume as tiles of other boxes: the interior of each tile, and its borders. Images whose tiles overlap, repeat, leave the
lattice or are thinner than the kernel take the way of :func:`gauss3d_seamless`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from voxelloom.functions.batches import ints, payload_view
from voxelloom.functions.names import name_of_box
from voxelloom.operators.blocks import PIECE, Part, PieceBuffer, Row, cut, fold_blocks, paste
from voxelloom.operators.gauss import blur, kernel_weights
from voxelloom.operators.seamless import BROADCAST_IMAGES, IMAGE_SHARES, gauss3d_seamless, masked_blur
from voxelloom.schema import AXES, BOX, DIMS, TILE_META, VOLUME
from voxelloom.session import reliable_checkpoint

#: Bytes of border voxels that one task blurs, about.
TASK_BYTES = 64 << 20

_LATTICE = [f"{a}_{what}" for what in ("lo", "hi", "edge") for a in AXES]
_REGION = ["rx", "ry", "rz"]


def lattices(tiles: DataFrame, radius: tuple[int, int, int]) -> DataFrame:
    """Per image and zoom: bounds, edge lengths, the number of voxels, and whether its tiles lie on a lattice of edges wider than twice
    the radius. One pass over boxes; payloads are not read."""
    boxes = reliable_checkpoint(tiles.groupBy(*VOLUME, *BOX).agg(F.count(F.lit(1)).alias("_n")))
    voxels = F.lit(1).cast("decimal(38,0)")
    for d in DIMS:
        voxels = voxels * F.col(d)
    bounds = boxes.groupBy(*VOLUME).agg(
        *[F.min(a).alias(f"{a}_lo") for a in AXES],
        *[F.max(F.col(a) + F.col(f"{a}_dim")).alias(f"{a}_hi") for a in AXES],
        *[F.max(f"{a}_dim").alias(f"{a}_edge") for a in AXES],
        F.max("_n").alias("_copies"),
        F.sum(voxels).alias("voxels"),
    )
    fits = F.col("_copies") == 1
    for a, r in zip(AXES, radius, strict=True):
        place, edge, high = F.col(a), F.col(f"{a}_edge"), F.col(f"{a}_hi")
        on_lattice = F.pmod(place.cast("long") - F.col(f"{a}_lo"), edge) == 0
        whole = (F.col(f"{a}_dim") == edge) | (place + F.col(f"{a}_dim") == high)
        alone = high - F.col(f"{a}_lo") <= edge
        fits = fits & on_lattice & whole & (alone | (edge > 2 * r))
    if bounds.limit(BROADCAST_IMAGES + 1).count() <= BROADCAST_IMAGES:
        placed = boxes.join(F.broadcast(bounds), VOLUME)
    else:
        placed = _dealt(boxes, bounds)
    return placed.groupBy(*VOLUME, *_LATTICE, "voxels").agg(F.bool_and(fits).alias("regular"))


def _dealt(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Join with one row per image; the rows of a large image are dealt over several tasks."""
    share = F.pmod(F.xxhash64(*BOX), F.lit(IMAGE_SHARES)).cast("int")
    shares = F.explode(F.sequence(F.lit(0), F.lit(IMAGE_SHARES - 1)))
    return rows.withColumn("_s", share).join(images.withColumn("_s", shares), [*VOLUME, "_s"]).drop("_s")


def _segments(cell: int, cells: int) -> list[int]:
    """The segments of an axis that a cell has a part in: 2 k is the border before cell k, 2 k + 1 the inside of cell k."""
    return [2 * cell + 1, *([2 * cell] if cell else []), *([2 * cell + 2] if cell + 1 < cells else [])]


def _span(segment: int, low: int, high: int, edge: int, radius: int, cells: int) -> tuple[int, int]:
    """First and end voxel of a segment; empty where the end is not behind the first."""
    cell, inside = divmod(segment, 2)
    plane = low + cell * edge
    if inside:
        return plane + (radius if cell else 0), (plane + edge - radius if cell + 1 < cells else high)
    return plane - radius, min(plane + radius, high)


class _Lattice:
    """Segments of one image, from a row of ``_LATTICE``."""

    def __init__(self, row: np.ndarray, radius: np.ndarray):
        self.low, self.high, self.edge = row[:3], row[3:6], row[6:9]
        self.radius = radius
        self.cells = -(-(self.high - self.low) // self.edge)

    def cell(self, origin: np.ndarray) -> list[int]:
        return ((origin - self.low) // self.edge).tolist()

    def regions(self, cell: list[int]) -> Iterator[tuple[int, ...]]:
        return product(*[_segments(c, int(n)) for c, n in zip(cell, self.cells, strict=True)])

    def core(self, region: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        spans = [
            _span(s, *map(int, fixed))
            for s, *fixed in zip(region, self.low, self.high, self.edge, self.radius, self.cells, strict=True)
        ]
        low, high = np.array(spans).T
        return low, high

    def around(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(low - self.radius, self.low), np.minimum(high + self.radius, self.high)


def _is_inside(region: tuple[int, ...]) -> bool:
    return all(segment % 2 for segment in region)


def _schema(columns: list[str]) -> pa.Schema:
    return pa.schema([(c, pa.string() if c == "name" else pa.int32()) for c in columns] + [("pixels", pa.binary())])


_PARTS = _schema([*VOLUME, *PIECE])


def _insides(tiles: DataFrame, sigmas: tuple[float, float, float], radius: np.ndarray) -> DataFrame:
    """The part of each tile that its neighbours do not reach, blurred; a narrow step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = PieceBuffer(_PARTS)
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            volume, boxes, rows = ints(batch, VOLUME), ints(batch, BOX), ints(batch, _LATTICE)
            for r in range(batch.num_rows):
                lattice, origin = _Lattice(rows[r], radius), boxes[r, :3]
                low, high = lattice.core(tuple(2 * c + 1 for c in lattice.cell(origin)))
                if (low < high).all():
                    stack = data[starts[r] : starts[r + 1]].reshape(1, *boxes[r, :2:-1])
                    inside = cut(blur(stack, sigmas)[0], origin, low, high)
                    yield from buffer.add((*volume[r].tolist(), *low.tolist(), *(high - low).tolist()), inside)
        yield from buffer.flush()

    return tiles.mapInArrow(run, from_arrow_schema(_PARTS))


_SENT = _schema([*VOLUME, *_REGION, *_LATTICE, *[f"t_{c}" for c in BOX], *PIECE])


def border_voxels(tiles: DataFrame, radius: np.ndarray) -> DataFrame:
    """What each region along the borders needs of each tile: all that is shuffled."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = PieceBuffer(_SENT)
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            volume, boxes, rows = ints(batch, VOLUME), ints(batch, BOX), ints(batch, _LATTICE)
            for r in range(batch.num_rows):
                lattice, origin = _Lattice(rows[r], radius), boxes[r, :3]
                end = origin + boxes[r, 3:]
                stack = data[starts[r] : starts[r + 1]].reshape(boxes[r, :2:-1])
                for region in lattice.regions(lattice.cell(origin)):
                    low, high = lattice.core(region)
                    if _is_inside(region) or (low >= high).any():
                        continue
                    low, high = lattice.around(low, high)
                    low, high = np.maximum(low, origin), np.minimum(high, end)
                    identity = (*volume[r].tolist(), *region, *rows[r].tolist(), *boxes[r].tolist(), *low.tolist(), *(high - low).tolist())
                    yield from buffer.add(identity, cut(stack, origin, low, high))
        yield from buffer.flush()

    return tiles.mapInArrow(send, from_arrow_schema(_SENT))


def _borders(tiles: DataFrame, sigmas: tuple[float, float, float], radius: np.ndarray, tasks: int) -> DataFrame:
    """The regions along the borders, cut at the borders of the tiles."""

    def blur_region(key: tuple, parts: Iterator[Part]) -> Iterable[Row]:
        canvas = present = None
        owners: list[np.ndarray] = []
        for part in parts:
            if canvas is None:
                lattice = _Lattice(part.ints(_LATTICE)[0], radius)
                c_low, c_high = lattice.core(key[2:])
                low, high = lattice.around(c_low, c_high)
                canvas = np.zeros((high - low)[::-1], np.uint8)
                present = np.zeros(canvas.shape, np.uint8)
            boxes = part.ints([f"t_{c}" for c in BOX])
            for r, p_low, p_high, values in part.pieces():
                paste(canvas, low, p_low, p_high, values)
                cut(present, low, p_low, p_high)[...] = 1
                owners.append(boxes[r])
        core = [slice(int(a), int(b)) for a, b in zip((c_low - low)[::-1], (c_high - low)[::-1], strict=True)]
        result = masked_blur(canvas, present, sigmas, core)
        for box in owners:
            p_low, p_high = np.maximum(box[:3], c_low), np.minimum(box[:3] + box[3:], c_high)
            if (p_low < p_high).all():
                yield (*key[:2], *p_low.tolist(), *(p_high - p_low).tolist()), cut(result, c_low, p_low, p_high)

    return fold_blocks(border_voxels(tiles, radius), [*VOLUME, *_REGION], _PARTS, blur_region, tasks)


def gauss3d_borders(tiles: DataFrame, sigma_x: float = 1.0, sigma_y: float = 1.0, sigma_z: float = 1.0) -> DataFrame:
    """Blur the volume as if it were one piece and return it as tiles of other boxes, named by them.

    The voxels are those of :func:`gauss3d_seamless`; the parts of a tile do not overlap and fill its box. Payloads are read twice,
    once for insides and once for borders, and no payload is shuffled but what lies within twice the kernel's radius of a
    border between tiles.
    """
    sigmas = (sigma_x, sigma_y, sigma_z)
    radius = np.array([len(kernel_weights(s)) - 1 for s in sigmas], np.int64)
    tiles = tiles.select(*TILE_META, "pixels")
    images = reliable_checkpoint(lattices(tiles, tuple(radius.tolist())))
    shape = images.agg(F.count("*").alias("n"), F.bool_or(~F.col("regular")).alias("odd"), F.sum(F.when(F.col("regular"), F.col("voxels"))).alias("voxels")).first()
    if not shape["n"]:
        return tiles
    few = shape["n"] <= BROADCAST_IMAGES
    known = images.select(*VOLUME, *_LATTICE, "regular")
    placed = tiles.join(F.broadcast(known), VOLUME) if few else _dealt(tiles, known)
    regular = placed.where("regular")
    session_tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(session_tasks, -(-int(shape["voxels"] or 0) // (3 * TASK_BYTES)))
    parts = _insides(regular, sigmas, radius).unionByName(_borders(regular, sigmas, radius, tasks))
    parts = parts.withColumnsRenamed(dict(zip(PIECE, BOX, strict=True))).withColumn("name", name_of_box()).select(*TILE_META, "pixels")
    if shape["odd"]:
        parts = parts.unionByName(gauss3d_seamless(placed.where("not regular").select(*TILE_META, "pixels"), *sigmas))
    return parts
