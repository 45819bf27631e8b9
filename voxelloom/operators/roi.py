"""Region-of-interest queries over the tile table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from voxelloom.functions.batches import binary_column, ints, payload_view
from voxelloom.functions.names import name_of_box
from voxelloom.operators.blocks import BLOCK, PIECE, Part, PieceBuffer, Row, cut, fold_blocks, paste
from voxelloom.operators.gauss import gauss3d_tile, kernel_weights
from voxelloom.operators.boxjoin import BROADCAST_CELLS, HOT_ROWS, box_join, hot_limit, measure, split_hot
from voxelloom.schema import BOX, EXTENT, ORIGIN, ROI_LINE, TILE_KEY, TILE_META, VOLUME
from voxelloom.session import reliable_checkpoint

# Voxels of one assembled row; a larger request comes out as several rows that tile its box.
CHUNK_VOXELS = 1 << 26
# Bytes that one task may have to cut if all requests want the same tile; beyond it payloads are dealt out.
PAYLOAD_BYTES = 16 << 30
# Payload rows of one tile, or requests for it, that one task handles.
HOT_PAYLOADS = 1_000

CORE = ["ux", "uy", "uz", "uw", "uh", "ud"]
_CHUNK_KEY = ["req_id", *VOLUME, *BLOCK, *CORE]


def parse_requests(lines: DataFrame, line: str = "value", req_id: str | None = None) -> DataFrame:
    """Request lines of eight comma separated integers; ``valid`` is false for lines that do not parse.

    Without ``req_id`` the row's place identifies the request, so equal lines are requests of their own.
    """
    parts = F.split(F.col(line), ",")
    fields = [
        F.trim(F.try_element_at(parts, F.lit(i + 1))).try_cast("int").alias(f.name) for i, f in enumerate(ROI_LINE)
    ]
    key = F.col(req_id) if req_id else F.monotonically_increasing_id()
    parsed = lines.select(key.cast("long").alias("req_id"), *fields, (F.size(parts) == 8).alias("_eight"))
    valid = F.col("_eight")
    for f in ROI_LINE:
        valid = valid & F.col(f.name).isNotNull()
    return parsed.withColumn("valid", valid).drop("_eight")


def read_requests(spark: SparkSession, path: str, on_error: str = "skip") -> DataFrame:
    """Valid requests of text files, one per line; ``on_error='fail'`` refuses files with other lines.

    The requests are stored reliably, so that their ids stay the same wherever they are used.
    """
    parsed = reliable_checkpoint(parse_requests(spark.read.text(path)))
    if on_error not in ("skip", "fail"):
        raise ValueError("on_error is 'skip' or 'fail'")
    if on_error == "fail" and (wrong := parsed.where("not valid").count()):
        raise ValueError(f"{wrong} lines are no requests")
    return parsed.where("valid").drop("valid")


def roi_join(
    tiles: DataFrame,
    requests: DataFrame,
    touching: bool = False,
    strategy: str = "auto",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Metadata of every tile that overlaps each request; payloads stay out of the join."""
    return box_join(tiles.select(*TILE_META), requests, touching, strategy, hot_rows=hot_rows)


def first_tile(pairs: DataFrame) -> DataFrame:
    """The first tile of each request in z, y, x order; ties by extent, then name."""
    order = F.struct("z", "y", "x", "z_dim", "y_dim", "x_dim", "name", *VOLUME)
    best = pairs.groupBy("req_id").agg(F.min(order).alias("t"))
    return best.select("req_id", *[F.col(f"t.{c}").alias(c) for c in TILE_META])


def _chunks(requests: DataFrame, chunk_voxels: int, halo: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Cut request boxes into blocks of at most ``chunk_voxels``; most requests are one block.

    The block is in the core columns; the box columns hold it widened by ``halo`` within the request.
    """
    width, height, depth = (F.col(c).cast("long") for c in EXTENT)
    limit = F.lit(chunk_voxels).cast("long")
    kx = F.least(width, limit)
    ky = F.least(height, F.greatest(F.lit(1).cast("long"), F.floor(limit / kx)))
    kz = F.least(depth, F.greatest(F.lit(1).cast("long"), F.floor(limit / (kx * ky))))
    solid = requests.where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("depth") > 0))
    cut_up = solid.select(*requests.columns, kx.alias("_kx"), ky.alias("_ky"), kz.alias("_kz"))
    fields: list[Column] = []
    for axis, size, step, border, core, core_size in zip(ORIGIN, EXTENT, ["_kx", "_ky", "_kz"], halo, CORE[:3], CORE[3:]):
        count = F.ceil(F.col(size) / F.col(step))
        cut_up = cut_up.withColumn(f"_i{axis}", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
        start = F.col(f"_i{axis}") * F.col(step)
        end = F.least(start + F.col(step), F.col(size).cast("long"))
        low = F.greatest(start - border, F.lit(0).cast("long"))
        high = F.least(end + border, F.col(size).cast("long"))
        fields.append((F.col(axis) + low).cast("int").alias(axis))
        fields.append((high - low).cast("int").alias(size))
        fields.append((F.col(axis) + start).cast("int").alias(core))
        fields.append((end - start).cast("int").alias(core_size))
    return cut_up.select("req_id", *VOLUME, *fields)


def _cut_pairs(pairs: DataFrame) -> DataFrame:
    """From (block, tile with payload) rows to the shared piece of both."""
    schema = pa.schema(
        [("req_id", pa.int64()), *[(c, pa.int32()) for c in [*VOLUME, *BLOCK, *CORE, *PIECE]], ("pixels", pa.binary())]
    )

    def run(batches):
        buffer = PieceBuffer(schema)
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            heads = ints(batch, _CHUNK_KEY)
            boxes = ints(batch, BOX)
            for r in range(batch.num_rows):
                block, box = heads[r, 3:9], boxes[r]
                low = np.maximum(block[:3], box[:3])
                high = np.minimum(block[:3] + block[3:], box[:3] + box[3:])
                stack = data[starts[r] : starts[r + 1]].reshape(box[5], box[4], box[3])
                identity = (*heads[r].tolist(), *low.tolist(), *(high - low).tolist())
                yield from buffer.add(identity, cut(stack, box[:3], low, high))
        yield from buffer.flush()

    return pairs.mapInArrow(run, from_arrow_schema(schema))


def _cut_wanted(rows: DataFrame) -> DataFrame:
    """From tiles with payload and the list of blocks that want a part of each to the parts, all cut in one pass."""
    names = ["req_id", *BLOCK, *CORE]
    schema = pa.schema([("req_id", pa.int64()), *[(c, pa.int32()) for c in [*VOLUME, *BLOCK, *CORE, *PIECE]], ("pixels", pa.binary())])

    def run(batches):
        buffer = PieceBuffer(schema)
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            volumes, boxes = ints(batch, VOLUME), ints(batch, BOX)
            lists = batch.column("_wanted")
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            asked = lists.flatten()
            heads = np.stack([asked.field(asked.type.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
            for r in range(batch.num_rows):
                box = boxes[r]
                stack = data[starts[r] : starts[r + 1]].reshape(box[5], box[4], box[3])
                for head in heads[ends[r] : ends[r + 1]]:
                    low = np.maximum(head[1:4], box[:3])
                    high = np.minimum(head[1:4] + head[4:7], box[:3] + box[3:])
                    identity = (int(head[0]), *volumes[r].tolist(), *head[1:].tolist(), *low.tolist(), *(high - low).tolist())
                    yield from buffer.add(identity, cut(stack, box[:3], low, high))
        yield from buffer.flush()

    return rows.select(*TILE_KEY, "pixels", "_wanted").mapInArrow(run, from_arrow_schema(schema))


def roi_assemble(
    tiles: DataFrame,
    requests: DataFrame,
    strategy: str = "auto",
    chunk_voxels: int = CHUNK_VOXELS,
    hot_rows: int = HOT_PAYLOADS,
) -> DataFrame:
    """The request boxes cut out of all overlapping tiles, as tile rows with ``req_id``.

    Voxels no tile covers are 0. A request above ``chunk_voxels`` yields several rows that tile its box.
    Pairs are found on metadata; the payload scan reads only images and places between the least and the greatest
    that are needed. Few pairs are sent to where the tiles are read: each payload meets the list of its
    requests once, and only pieces move. Many pairs meet the payloads in a shuffle; tiles wanted by very
    many requests, or stored very often, are dealt out over several tasks.
    """
    return _assembled(tiles, _chunks(requests, chunk_voxels), strategy, hot_rows).select("req_id", *TILE_META, "pixels")


def roi_blur(
    tiles: DataFrame,
    requests: DataFrame,
    sigma_x: float = 1.0,
    sigma_y: float = 1.0,
    sigma_z: float = 1.0,
    strategy: str = "auto",
    chunk_voxels: int = CHUNK_VOXELS,
) -> DataFrame:
    """The request boxes, blurred as if each were one piece, as :func:`roi_assemble` returns them.

    A block of a larger request is assembled with a border as wide as the kernel, so its own voxels see all the
    voxels they would see in the whole box; the border is cut off after the blur.
    """
    sigmas = (sigma_x, sigma_y, sigma_z)
    halo = tuple(len(kernel_weights(s)) - 1 for s in sigmas)
    blurred = gauss3d_tile(_assembled(tiles, _chunks(requests, chunk_voxels, halo), strategy, HOT_PAYLOADS), *sigmas)

    def crop(batches):
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            boxes, cores = ints(batch, BOX), ints(batch, CORE)
            parts = []
            for r in range(batch.num_rows):
                stack = data[starts[r] : starts[r + 1]].reshape(boxes[r, :2:-1])
                low = cores[r, :3]
                parts.append(np.ascontiguousarray(cut(stack, boxes[r, :3], low, low + cores[r, 3:])).reshape(-1))
            columns = [batch.column(c) for c in ("req_id", *VOLUME, *CORE)]
            yield pa.RecordBatch.from_arrays([*columns, binary_column(parts)], names=["req_id", *VOLUME, *BOX, "pixels"])

    schema = pa.schema([("req_id", pa.int64()), *[(c, pa.int32()) for c in [*VOLUME, *BOX]], ("pixels", pa.binary())])
    whole = blurred.select("req_id", *VOLUME, *BOX, *CORE, "pixels").mapInArrow(crop, from_arrow_schema(schema))
    return whole.withColumn("name", name_of_box()).select("req_id", *TILE_META, "pixels")


def _assembled(tiles: DataFrame, chunks: DataFrame, strategy: str, hot_rows: int) -> DataFrame:
    """The blocks as tile rows with ``req_id`` and their core box."""
    grid = measure(tiles, chunks)
    if strategy == "auto":
        few = grid.request_cells * grid.tile_voxels <= PAYLOAD_BYTES
        strategy = grid.strategy() if few else "shuffle"
    block = {**{f"roi_{a}": b for a, b in zip(ORIGIN, BLOCK)}, **dict(zip(EXTENT, BLOCK[3:]))}
    payloads = tiles.select(*TILE_KEY, "pixels")

    how = "broadcast" if strategy == "broadcast" else "auto"
    found = reliable_checkpoint(box_join(tiles.select(*TILE_KEY).distinct(), chunks, strategy=how, grid=grid))
    ends = [f(c).alias(f"{n}_{c}") for c in [*VOLUME, *ORIGIN] for n, f in (("lo", F.min), ("hi", F.max))]
    spread = found.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    size = spread["n"]
    for c in [*VOLUME, *ORIGIN] if size else ():
        payloads = payloads.where(F.col(c).between(spread[f"lo_{c}"], spread[f"hi_{c}"]))
    if size <= BROADCAST_CELLS and strategy != "shuffle":
        asked = F.collect_list(F.struct("req_id", *BLOCK, *CORE)).alias("_all")
        parts = f"transform(sequence(0, (size(_all) - 1) div {hot_rows}), i -> slice(_all, i * {hot_rows} + 1, {hot_rows}))"
        wanted = found.withColumnsRenamed(block).groupBy(*TILE_KEY).agg(asked)
        wanted = wanted.select(*TILE_KEY, F.explode(F.expr(parts)).alias("_wanted"))
        pieces = _cut_wanted(payloads.join(F.broadcast(wanted), TILE_KEY))
    else:
        # equal copies differ only in where they are read; a repeated task reads them at the same place
        placed = payloads.withColumn("_part", F.spark_partition_id())
        limit = hot_limit(hot_rows, size, grid.tile_rows)
        left, right = split_hot(found, placed, TILE_KEY, limit, right_by=["_part"])
        pairs = left.join(right.hint("merge"), [*TILE_KEY, "_a", "_b"])
        pieces = _cut_pairs(pairs.withColumnsRenamed(block).select("req_id", *TILE_KEY, *BLOCK, *CORE, "pixels"))

    # every block announces itself once, so that a request without tiles still gets its zeros
    own = chunks.withColumnsRenamed(dict(zip([*ORIGIN, *EXTENT], BLOCK)))
    announced = own.select(
        *_CHUNK_KEY, *[F.lit(0).alias(c) for c in PIECE], F.lit(b"").alias("pixels")
    )

    def fold(key: tuple, parts: Iterator[Part]) -> Iterable[Row]:
        box = np.array(key[3:9])
        canvas = np.zeros(box[:2:-1], np.uint8)
        for part in parts:
            for _, low, high, values in part.pieces():
                paste(canvas, box[:3], low, high, values)
        yield key, canvas

    schema = pa.schema(
        [("req_id", pa.int64()), *[(c, pa.int32()) for c in [*VOLUME, *BOX, *CORE]], ("pixels", pa.binary())]
    )
    whole = fold_blocks(pieces.unionByName(announced), _CHUNK_KEY, schema, fold)
    return whole.withColumn("name", name_of_box()).select("req_id", *TILE_META, *CORE, "pixels")
