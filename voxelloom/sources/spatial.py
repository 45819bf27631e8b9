"""A tile table laid out by place, from which requests read only the folders they touch.

Tiles lie in folders by image, zoom and region, a cube of ``edge`` voxels that holds the tile's origin. Within a region they are
ordered along a Z-order curve, so that the row-group statistics of Parquet are narrow on all three axes, and a crowded region is cut
along the curve into several files by several tasks. ``_regions``, written last, holds the box that the tiles of each region fill
together; a table without it is incomplete and is refused. For a set of requests the boxes of the regions, not the tiles, are
joined with the requests, and the regions that are left become a filter on folders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.boxjoin import box_join
from voxelloom.schema import DIMS, ORIGIN, TILES, VOLUME
from voxelloom.session import reliable_checkpoint

#: Voxels along the edge of a region: 64 tiles of 128x128x128.
EDGE = 512
#: Regions that are named in a filter on folders; more are pruned by a join.
NAMED_REGIONS = 5_000
#: Regions, about 50 bytes each, that are sent to all executors.
SENT_REGIONS = 1_000_000
REGIONS = "_regions"
_REGION = [*VOLUME, "region"]
#: Bits of a coordinate on the curve, and what makes coordinates positive.
_BITS = 20
_BIAS = 1 << (_BITS - 1)
#: How far bits move, and which stay, when every bit gets two empty places beside it. Fixed values.
_SPREAD = (
    (32, 0x1F00000000FFFF),
    (16, 0x1F0000FF0000FF),
    (8, 0x100F00F00F00F00F),
    (4, 0x10C30C30C30C30C3),
    (2, 0x1249249249249249),
)


def region_of(edge: int) -> Column:
    """Name of the region of a box, from its origin: ``x_y_z`` in units of ``edge``."""
    return F.concat_ws("_", *[F.floor(F.col(a) / F.lit(edge)) for a in ORIGIN])


def curve_place(*axes: Column) -> Column:
    """Place of a point on the Z-order curve; coordinates beyond 20 bits share the ends of the curve."""
    spread = []
    for axis in axes:
        bits = F.least(F.greatest(axis.cast("long") + _BIAS, F.lit(0)), F.lit((1 << _BITS) - 1)).cast("long")
        for move, mask in _SPREAD:
            bits = bits.bitwiseOR(F.shiftleft(bits, move)).bitwiseAND(F.lit(mask).cast("long"))
        spread.append(bits)
    return reduce(Column.bitwiseOR, [F.shiftleft(bits, at) for at, bits in enumerate(spread)])


def write_spatial(tiles: DataFrame, path: str, edge: int = EDGE) -> None:
    """Write a new table; an existing one is refused. Payloads are shuffled once, by ranges along the curve.

    A tile without an image, zoom or box belongs to no place and stops the job.
    """
    whole = F.lit(True)
    for c in [*VOLUME, *ORIGIN, *DIMS]:
        whole = whole & F.col(c).isNotNull()
    image = F.when(whole, F.col("image_id")).otherwise(F.raise_error(F.lit("tile without an image, zoom or box")).cast("int"))
    placed = tiles.select(*TILES.fieldNames()).withColumn("image_id", image).withColumn("region", region_of(edge))
    placed = placed.withColumn("_at", curve_place(*[F.col(a) for a in ORIGIN]))
    order = [*_REGION, "_at", "name"]
    # the name, and a hash where even names repeat, let copies of one tile be cut apart
    laid = placed.repartitionByRange(*order, F.xxhash64(*DIMS, "pixels")).sortWithinPartitions(*order).drop("_at")
    laid.write.partitionBy(*_REGION).mode("errorifexists").parquet(path)
    spark = tiles.sparkSession
    ends = [F.min(F.col(a).cast("long")).alias(a) for a in ORIGIN]
    ends += [F.max(F.col(a).cast("long") + F.col(d)).alias(f"{a}_end") for a, d in zip(ORIGIN, DIMS)]
    boxes = _tiles(spark, path).groupBy(*_REGION).agg(F.count(F.lit(1)).alias("n"), *ends)
    boxes.write.mode("errorifexists").parquet(f"{path}/{REGIONS}")


def _tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*TILES.fields, T.StructField("region", T.StringType())])).parquet(path)


def regions(spark: SparkSession, path: str) -> DataFrame:
    """image_id, zoom_out, region, n (tiles) and the box that they fill: x, y, z and the exclusive ends."""
    ends = [T.StructField(c, T.LongType()) for c in ["n", *ORIGIN, *[f"{a}_end" for a in ORIGIN]]]
    fields = [TILES["image_id"], TILES["zoom_out"], T.StructField("region", T.StringType()), *ends]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/{REGIONS}")


def read_spatial(spark: SparkSession, path: str) -> DataFrame:
    """All tiles of a complete table."""
    regions(spark, path)  # raises where the table is incomplete
    return _tiles(spark, path).select(*TILES.fieldNames())


def touched_regions(spark: SparkSession, path: str, requests: DataFrame, touching: bool = False) -> DataFrame:
    """image_id, zoom_out and region of the regions some request needs; ``touching`` counts shared faces as well."""
    found = regions(spark, path)
    # a box longer than an integer is cut there: requests end at the same place
    dims = [F.least(F.col(f"{a}_end") - F.col(a), F.lit(2**31 - 1)).cast("int").alias(d) for a, d in zip(ORIGIN, DIMS)]
    boxes = found.select("image_id", F.col("region").alias("name"), "zoom_out", *[F.col(a).cast("int").alias(a) for a in ORIGIN], *dims)
    return box_join(boxes, requests, touching).select(*VOLUME, F.col("name").alias("region")).distinct()


def read_requested(spark: SparkSession, path: str, requests: DataFrame, touching: bool = False) -> DataFrame:
    """The tiles of all regions that some request needs, and so every tile that a request overlaps; folders of others are not read.

    The result is a tile table like any other: joins and assembly with the same requests give what they give on the whole table.
    Up to ``NAMED_REGIONS`` regions are named in the filter; more prune folders at run time through the broadcast side of a semi join
    or, where they are too many to broadcast, by a shuffle.
    """
    touched = reliable_checkpoint(touched_regions(spark, path, requests, touching))
    count, tiles = touched.count(), _tiles(spark, path)
    if count > NAMED_REGIONS:
        # the comparison, true of every name, marks this side as a filter on folders
        named = touched.where(F.col("region") > "")
        side = F.broadcast(named) if count <= SENT_REGIONS else named
        return tiles.join(side, _REGION, "left_semi").select(*TILES.fieldNames())
    by_volume: dict[tuple, list[str]] = {}
    for row in touched.collect():
        by_volume.setdefault((row["image_id"], row["zoom_out"]), []).append(row["region"])
    wanted = F.lit(False)
    for (image, zoom), names in sorted(by_volume.items()):
        wanted = wanted | ((F.col("image_id") == image) & (F.col("zoom_out") == zoom) & F.col("region").isin(sorted(names)))
    return tiles.where(wanted).select(*TILES.fieldNames())
