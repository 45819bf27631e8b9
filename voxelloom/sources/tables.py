"""The tile table and the image table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions.names import base_name
from voxelloom.schema import IMAGES, TILE_KEY, TILE_META, TILES, VOLUME
from voxelloom.sources import spatial
from voxelloom.sources.pixlog import PixLog

_COLUMNS = TILES.fieldNames()


def as_pix(tiles: DataFrame, image_id: int | None = None, zoom_out: int | None = 1) -> DataFrame:
    """The ten stored columns; the zoom is 1 for original images and ``None`` keeps the row's own."""
    out = tiles.withColumn("name", base_name(F.col("name")))
    if image_id is not None:
        out = out.withColumn("image_id", F.lit(image_id))
    if zoom_out is not None:
        out = out.withColumn("zoom_out", F.lit(zoom_out))
    return out.select(*_COLUMNS)


def read_pix(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of a table written by :func:`append_pix` or kept as a :class:`PixLog`; filters on image and zoom prune whole folders."""
    log = PixLog(spark, path)
    if log.exists():
        return log.read()
    return spark.read.schema(TILES).parquet(path).select(*_COLUMNS)


def read_for(spark: SparkSession, path: str, requests: DataFrame, touching: bool = False) -> DataFrame:
    """The tiles that some request overlaps, and others; of a table laid out by place only the regions that are needed."""
    if _has_files(spark, f"{path}/{spatial.REGIONS}"):
        return spatial.read_requested(spark, path, requests, touching)
    return read_pix(spark, path)


def append_pix(tiles: DataFrame, path: str) -> None:
    """Append without looking for duplicates."""
    if PixLog(tiles.sparkSession, path).exists():
        raise ValueError(f"{path} is a log of batches; append to it by PixLog")
    tiles.select(*_COLUMNS).write.partitionBy(*VOLUME).mode("append").parquet(path)


def append_pix_once(tiles: DataFrame, path: str) -> None:
    """Append only the tiles whose box is not stored yet for their image and zoom, one row per box.

    A job that is run again after a failure therefore adds nothing twice. Payloads are shuffled, and the boxes of the
    whole table are read; a :class:`PixLog` needs neither.
    """
    spark = tiles.sparkSession
    pixels = F.min(F.struct("name", "pixels")).alias("t")
    fresh = tiles.groupBy(*TILE_KEY).agg(pixels).select(*TILE_KEY, "t.name", "t.pixels").select(*_COLUMNS)
    if _has_files(spark, path):
        known = read_pix(spark, path).select(*TILE_KEY).distinct()
        fresh = fresh.join(known, TILE_KEY, "left_anti")
    append_pix(fresh, path)


def replace_volumes(tiles: DataFrame, path: str) -> None:
    """Replace the stored tiles of every (image, zoom) that occurs in ``tiles``; others are kept."""
    writer = tiles.select(*_COLUMNS).write.partitionBy(*VOLUME).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _has_files(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def union_pix(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union of the metadata of two tile sets."""
    return old.select(*TILE_META).unionByName(new.select(*TILE_META))


def register_image(spark: SparkSession, path: str, image_id: int, name: str) -> None:
    """Add one row to the image table."""
    spark.createDataFrame([(image_id, name)], IMAGES).write.mode("append").parquet(path)


def images_of(tiles: DataFrame) -> DataFrame:
    """One image row per image among the tiles."""
    found = tiles.select("image_id").distinct()
    return found.select(F.col("image_id").alias("id"), F.concat(F.lit("image-"), F.col("image_id")).alias("name"))


def read_pix_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "pix",
    partitions: int = 64,
    bounds: tuple[int, int] = (0, 1 << 20),
    **options,
) -> DataFrame:
    """One bulk scan of a database table, split on ``x`` into parallel range reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", "x").option("numPartitions", partitions)
    reader = reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).options(**options)
    return reader.load().select(*[F.col(c).cast(TILES[c].dataType).alias(c) for c in _COLUMNS])


def append_pix_jdbc(tiles: DataFrame, url: str, table: str = "pix", connections: int = 16, **options) -> None:
    """Append rows through at most ``connections`` parallel connections."""
    writer = tiles.select(*_COLUMNS).write.format("jdbc").option("url", url).option("dbtable", table)
    writer.option("numPartitions", connections).options(**options).mode("append").save()
