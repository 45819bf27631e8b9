"""The batch jobs: scan, filter, store.

Jobs over image or sequence files return how many of them were read and kept, and how many dropped by problem; with
``quarantine`` they also list the dropped ones in a table, see :class:`voxelloom.sources.losses.Watched`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.operators.color import filter_color
from voxelloom.operators.counting import keyed_count
from voxelloom.operators.filters import apply_filter
from voxelloom.operators.roi import read_requests, roi_blur, roi_join
from voxelloom.schema import TILE_META
from voxelloom.sources import images, sequence, tables
from voxelloom.sources.losses import Watched


def balanced(tiles: DataFrame, partitions: int | None) -> DataFrame:
    """Spread tiles over more tasks before costly work, if asked to; the only shuffle of a filter job."""
    return tiles.repartition(partitions) if partitions else tiles


def filter_to_pix(
    spark: SparkSession,
    source: str | list[str],
    target: str,
    filter_name: str,
    params: Mapping[str, object] | None = None,
    image_id: int = -1,
    image_name: str | None = None,
    images_target: str | None = None,
    partitions: int | None = None,
    once: bool = False,
    on_error: str = "skip",
    color: str = "reject",
    quarantine: str | None = None,
) -> dict[str, int]:
    """Filter a folder of image tiles into the tile table and, if named, register the image."""
    watched = Watched(images.decode_tiles(images.read_images(spark, source), image_id, color))
    tiles = balanced(watched.tiles(on_error), partitions)
    result = tables.as_pix(apply_filter(tiles, filter_name, params), image_id)
    (tables.append_pix_once if once else tables.append_pix)(result, target)
    if image_name is not None and images_target is not None:
        tables.register_image(spark, images_target, image_id, image_name)
    return watched.report(quarantine)


def filter_to_sequence(
    spark: SparkSession,
    source: str | list[str],
    target: str,
    filter_name: str,
    params: Mapping[str, object] | None = None,
    encoded: bool = True,
    partitions: int | None = None,
    on_error: str = "skip",
    color: str = "reject",
    quarantine: str | None = None,
) -> dict[str, int]:
    """Filter a folder of image tiles into sequence files of encoded images or of raw pixels; encoded images that are read with
    ``color='keep'`` stay in colour."""
    watched = Watched(images.decode_tiles(images.read_images(spark, source), -1, color))
    tiles = balanced(watched.tiles(on_error), partitions)
    result = (filter_color if color == "keep" else apply_filter)(tiles, filter_name, params)
    if encoded:
        sequence.write_sequence(images.encode_tiles(result), target, value="content")
    else:
        sequence.write_sequence(result, target)
    return watched.report(quarantine)


def filter_color_images(
    spark: SparkSession,
    source: str | list[str],
    folder: str,
    filter_name: str,
    params: Mapping[str, object] | None = None,
    partitions: int | None = None,
    on_error: str = "skip",
) -> None:
    """Filter the brightness of image tiles and write them, in their colours, as PNG files; grey ones stay grey."""
    tiles = balanced(images.read_tiles(spark, source, -1, on_error, "keep"), partitions)
    images.export_tiles(filter_color(tiles, filter_name, params), folder)


def filter_listed(
    spark: SparkSession,
    path_list: str,
    target: str,
    filter_name: str,
    params: Mapping[str, object] | None = None,
    folder: str | None = None,
    sink: str = "pix",
    **options,
) -> dict[str, int]:
    """Read the images that a path list names, and only these, filter them, and store them in ``sink``: ``pix`` or ``sequence``.

    With ``folder`` the list may hold the ends of paths below it. ``options`` are those of the job for a whole folder.
    """
    job = {"pix": filter_to_pix, "sequence": filter_to_sequence}[sink]
    return job(spark, images.listed_paths(spark, path_list, folder), target, filter_name, params, **options)


def filter_sequence(
    spark: SparkSession,
    source: str,
    target: str,
    filter_name: str,
    params: Mapping[str, object] | None = None,
    ordered: bool = True,
    on_error: str = "skip",
    quarantine: str | None = None,
) -> dict[str, int]:
    """Filter raw-pixel sequence files into new ones; ``ordered`` sorts the records by name, before the costly filter."""
    decoded = sequence.decode_records(sequence.read_sequence(spark, source))
    if ordered:
        decoded = decoded.repartitionByRange("name").sortWithinPartitions("name")
    watched = Watched(decoded)
    sequence.write_sequence(apply_filter(watched.tiles(on_error), filter_name, params), target)
    return watched.report(quarantine)


def images_to_sequence(
    spark: SparkSession,
    path_list: str,
    folder: str,
    target: str,
    on_error: str = "skip",
    color: str = "reject",
    quarantine: str | None = None,
) -> dict[str, int]:
    """Decode the listed images below a folder, and only these, into raw-pixel sequence files."""
    listed = images.listed_paths(spark, path_list, folder)
    watched = Watched(images.decode_tiles(images.read_images(spark, listed), -1, color))
    sequence.write_sequence(watched.tiles(on_error).select("name", "pixels"), target)
    return watched.report(quarantine)


def filter_requests(
    spark: SparkSession,
    requests: str,
    pix: str,
    target: str,
    sigmas: tuple[float, float, float] = (1.0, 1.0, 1.0),
    image_id: int | None = None,
    name: str | None = None,
    on_error: str = "skip",
) -> None:
    """Cut every requested box out of the tile table, blur it as one piece and append it to ``target``.

    Boxes keep the image they come from and the name of their place unless others are given.
    """
    asked = read_requests(spark, requests, on_error)
    result = roi_blur(tables.read_for(spark, pix, asked), asked, *sigmas).select(*TILE_META, "pixels")
    if image_id is not None:
        result = result.withColumn("image_id", F.lit(image_id))
    if name is not None:
        result = result.withColumn("name", F.lit(name))
    tables.append_pix(result, target)


def match_requests(spark: SparkSession, requests: str, pix: str) -> tuple[DataFrame, DataFrame]:
    """Tiles that overlap or touch each request, and the number of requests served per image."""
    asked = read_requests(spark, requests)
    return roi_join(tables.read_for(spark, pix, asked, touching=True), asked, touching=True), keyed_count(asked, "image_id")


def export_sequence(spark: SparkSession, source: str, folder: str, encoded: bool, ending: str = "png") -> None:
    """Write the records of sequence files as image files: encoded bytes as they are, raw pixels encoded."""
    if encoded:
        records = sequence.read_sequence(spark, source).withColumnRenamed("path", "name")
        images.export_files(records, folder, ending)
    else:
        images.export_tiles(sequence.read_tiles(spark, source), folder, ending)
