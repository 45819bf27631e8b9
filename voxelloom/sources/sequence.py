"""Hadoop sequence files with a text key and a byte payload."""

from __future__ import annotations

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions.names import parse_names
from voxelloom.schema import TILE_META
from voxelloom.sources.images import usable
from voxelloom.sources.seqfile import BYTES, FORMAT, TEXT, located, registered


def read_sequence(spark: SparkSession, path: str, compressed: bool = False) -> DataFrame:
    """``path`` (the stored key) and ``content`` of every record.

    Compressed files, which the data source refuses, are read by Hadoop's reader with ``compressed``; their records pass
    through an RDD.
    """
    if compressed:
        records = spark.sparkContext.sequenceFile(path, TEXT, BYTES)
        return spark.createDataFrame(records.mapValues(bytes), "path string, content binary")
    return registered(spark).read.format(FORMAT).load(path)


def decode_records(records: DataFrame, image_id: int = -1) -> DataFrame:
    """Tiles of :func:`read_sequence` rows, with ``problem``: NULL for a good tile, else ``name`` or ``shape``."""
    named = parse_names(records)
    volume = F.col("x_dim").cast("long") * F.col("y_dim") * F.col("z_dim")
    problem = F.when(~F.col("valid"), F.lit("name")).when(F.octet_length("content") != volume, F.lit("shape"))
    return named.select(
        F.lit(image_id).alias("image_id"),
        "name",
        F.lit(1).alias("zoom_out"),
        *TILE_META[3:],
        F.when(problem.isNull(), F.col("content")).alias("pixels"),
        problem.alias("problem"),
        "path",
    )


def read_tiles(spark: SparkSession, path: str, image_id: int = -1, on_error: str = "skip") -> DataFrame:
    """Raw-pixel records as tiles; a key that is no tile name or a wrong length skips the record or stops the job."""
    return usable(decode_records(read_sequence(spark, path), image_id), on_error)


def write_sequence(records: DataFrame, path: str, key: str = "name", value: str = "pixels") -> None:
    """Write key and payload of every row; an existing target is refused."""
    system, place = located(path)
    if system.get_file_info(place).type != FileType.NotFound:
        raise FileExistsError(f"{path} already exists")
    registered(records.sparkSession)
    records.select(F.col(key).cast("string"), F.col(value)).write.format(FORMAT).mode("append").save(path)
