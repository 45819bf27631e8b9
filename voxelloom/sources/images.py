"""Image files as tiles, and tiles as image files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions.batches import binary_column, ints, payload_view
from voxelloom.functions.names import base_name, parse_names
from voxelloom.schema import TILE_META

IMAGE_GLOB = "*.jpg"
# Listed paths that one reader gets; longer lists are read by several.
LISTED_PATHS = 10_000
IMAGE_ROWS = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def read_files(spark: SparkSession, path: str | list[str], glob: str = IMAGE_GLOB) -> DataFrame:
    """Whole files as ``path, modificationTime, length, content``; small files share a task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def _listed(spark: SparkSession, list_path: str) -> DataFrame:
    lines = spark.read.text(list_path).select(F.trim("value").alias("_line"))
    return lines.where(F.col("_line") != "").distinct()


def in_path_list(files: DataFrame, list_path: str, path: str = "path") -> DataFrame:
    """The rows whose file a text file names, one path per line; see :func:`matching_paths`."""
    return matching_paths(files, _listed(files.sparkSession, list_path), path, "_line")


def matching_paths(files: DataFrame, lines: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """The rows whose path a line names.

    A line is a full path, with or without its scheme, or the last folders and the name of one; only whole
    components match.
    """
    wanted = lines.select(F.col(line).alias("_line")).distinct().withColumn("_file", F.element_at(F.split("_line", "/"), -1))
    place = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    found = files.withColumn("_file", F.element_at(F.split(path, "/"), -1)).withColumn("_place", place)
    listed = wanted["_line"]
    relative = ~listed.startswith("/") & (found["_place"].endswith(F.concat(F.lit("/"), listed)) | (found["_place"] == listed))
    same = (found["_file"] == wanted["_file"]) & ((found[path] == listed) | (found["_place"] == listed) | relative)
    return found.join(wanted, same, "left_semi").drop("_file", "_place")


def listed_paths(spark: SparkSession, list_path: str, folder: str | None = None, glob: str = "*") -> list[str]:
    """The listed paths; with ``folder`` the files below it that the list names. They go through the driver, their content does not."""
    if folder is None:
        return [row["_line"] for row in _listed(spark, list_path).collect()]
    found = in_path_list(read_files(spark, folder, glob).select("path"), list_path)
    return [row["path"] for row in found.collect()]


def _in_groups(paths: list[str], read: Callable[[list[str]], DataFrame]) -> DataFrame:
    if not paths:
        raise ValueError("no file is listed")
    parts = [read(paths[at : at + LISTED_PATHS]) for at in range(0, len(paths), LISTED_PATHS)]
    return reduce(DataFrame.unionByName, parts)


def read_path_list(spark: SparkSession, list_path: str) -> DataFrame:
    """Exactly the listed files, without scanning their folders; a missing file is an error."""
    return _in_groups(listed_paths(spark, list_path), lambda paths: read_files(spark, paths, "*"))


def brightness(weights: tuple[float, float, float] | None = None):
    """Function of (data, nChannels) giving grey bytes: the greatest channel, or a red-green-blue weighted sum.

    Images that could not be decoded have no channels and give NULL.
    """

    @F.pandas_udf("binary")
    def convert(payloads: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for payload, count in zip(payloads, channels):
            if payload is None or count is None or count < 1:
                out.append(None)
                continue
            values = np.frombuffer(payload, np.uint8).reshape(-1, int(count))
            if count == 1:
                grey = values[:, 0]
            elif weights is None:
                grey = values[:, :3].max(axis=1)
            else:
                # payloads hold blue, green, red
                grey = np.floor(values[:, 2::-1] @ np.array(weights) + 0.5).clip(0, 255).astype(np.uint8)
            out.append(grey.tobytes())
        return pd.Series(out)

    return convert


def three_channels():
    """Function of (data, nChannels) giving the first three of three or more bytes per voxel; NULL where there are fewer."""

    @F.pandas_udf("binary")
    def convert(payloads: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for payload, count in zip(payloads, channels):
            known = payload is not None and count is not None and count >= 3
            out.append(np.frombuffer(payload, np.uint8).reshape(-1, int(count))[:, :3].tobytes() if known else None)
        return pd.Series(out)

    return convert


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decoded images; an undecodable file is a row without channels."""
    read = lambda paths: spark.read.format("image").option("dropInvalid", "false").load(paths)
    return read(path) if isinstance(path, str) else _in_groups(path, read)


def decode_tiles(decoded: DataFrame, image_id: int = -1, color: str = "reject") -> DataFrame:
    """Tiles of :func:`read_images` rows, with ``problem``: NULL for a good tile, else why it cannot be used.

    ``color`` says what happens to colour images: ``reject`` flags them, ``brightness`` converts them, ``keep`` converts
    them and has their blue, green and red bytes as a further column ``color``, null for grey images.
    """
    if color not in ("reject", "brightness", "keep"):
        raise ValueError("color is 'reject', 'brightness' or 'keep'")
    named = parse_names(decoded.select("image.*").withColumnRenamed("origin", "path"))
    grey = F.col("nChannels") == 1
    pixels = F.when(grey, F.col("data"))
    if color != "reject":
        pixels = pixels.when(F.col("nChannels") > 1, brightness()("data", "nChannels"))
    strip = (F.col("width") == F.col("x_dim")) & (
        F.col("height").cast("long") == F.col("y_dim").cast("long") * F.col("z_dim")
    )
    problem = (
        F.when(~F.col("valid"), F.lit("name"))
        .when(F.col("nChannels") < 1, F.lit("decode"))
        .when(~grey & F.lit(color == "reject"), F.lit("color"))
        .when(~strip, F.lit("shape"))
    )
    return named.select(
        F.lit(image_id).alias("image_id"),
        "name",
        F.lit(1).alias("zoom_out"),
        *TILE_META[3:],
        F.when(problem.isNull(), pixels).alias("pixels"),
        problem.alias("problem"),
        "path",
        *([F.when(problem.isNull() & ~grey, three_channels()("data", "nChannels")).alias("color")] if color == "keep" else []),
    )


def read_tiles(
    spark: SparkSession, path: str | list[str], image_id: int = -1, on_error: str = "skip", color: str = "reject"
) -> DataFrame:
    """Usable tiles of an image folder or of listed files; ``on_error='fail'`` stops at the first unusable file."""
    return usable(decode_tiles(read_images(spark, path), image_id, color), on_error)


def usable(decoded: DataFrame, on_error: str = "skip") -> DataFrame:
    """The tiles without a ``problem``; ``on_error='fail'`` stops at the first one that has one."""
    if on_error == "skip":
        decoded = decoded.where(F.col("problem").isNull())
    elif on_error == "fail":
        message = F.concat(F.lit("unusable image ("), F.col("problem"), F.lit("): "), F.col("path"))
        decoded = decoded.withColumn(
            "pixels", F.when(F.col("problem").isNull(), F.col("pixels")).otherwise(F.raise_error(message).cast("binary"))
        )
    else:
        raise ValueError("on_error is 'skip' or 'fail'")
    return decoded.select(*TILE_META, "pixels", *[c for c in decoded.columns if c == "color"])


def ingest(
    spark: SparkSession, path: str | list[str], target: str, image_id: int = -1, on_error: str = "skip", color: str = "reject"
) -> None:
    """Decode a folder of images into a tile table; an existing target is refused."""
    read_tiles(spark, path, image_id, on_error, color).write.mode("errorifexists").parquet(target)


def _png(header: bytes, rows: np.ndarray) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    body = zlib.compress(rows.tobytes(), 6)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def encode_png(strip: np.ndarray) -> bytes:
    """A grey (rows, cols) image as lossless PNG."""
    height, width = strip.shape
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = strip
    return _png(struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0), rows)


def encode_color_png(strip: np.ndarray) -> bytes:
    """A (rows, cols, 3) image of blue, green and red as lossless PNG."""
    height, width, _ = strip.shape
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = strip[:, :, ::-1].reshape(height, -1)
    return _png(struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0), rows)


def encode_pgm(strip: np.ndarray) -> bytes:
    """A grey (rows, cols) image as binary PGM."""
    return b"P5\n%d %d\n255\n" % strip.shape[::-1] + strip.tobytes()


ENCODERS = {"png": encode_png, "pgm": encode_pgm}


def encode_tiles(tiles: DataFrame, kind: str = "png") -> DataFrame:
    """``name`` and the encoded slice strip of every tile, with its image and zoom; as PNG in colour where a tile has ``color``."""
    encode = ENCODERS[kind]
    colored = kind == "png" and "color" in tiles.columns

    def run(batches):
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            widths = ints(batch, ["x_dim"])[:, 0]
            colors = batch.column("color") if colored else None
            files = []
            for r in range(batch.num_rows):
                if colors is not None and colors[r].is_valid:
                    file = encode_color_png(np.frombuffer(colors[r].as_buffer(), np.uint8).reshape(-1, widths[r], 3))
                else:
                    file = encode(data[starts[r] : starts[r + 1]].reshape(-1, widths[r]))
                files.append(np.frombuffer(file, np.uint8))
            head = [batch.column(c) for c in ("image_id", "zoom_out", "name")]
            yield pa.RecordBatch.from_arrays([*head, binary_column(files)], names=["image_id", "zoom_out", "name", "content"])

    schema = "image_id int, zoom_out int, name string, content binary"
    return tiles.select("image_id", "zoom_out", "name", "x_dim", "pixels", *(["color"] if colored else [])).mapInArrow(run, schema)


def export_files(encoded: DataFrame, folder: str, ending: str, by_image: bool = False) -> None:
    """Write ``content`` to ``folder/name.ending``, one file per row; two rows for one file are refused before any is written.

    ``by_image`` puts the files of each image and zoom into a folder of their own, ``image-<id>/zoom-<zoom>``.
    The folder is any location all executors can reach: a mounted path or a URI that pyarrow can open.
    A file appears under its name only when it is complete, so a repeated task does no harm.
    """

    def write(rows) -> None:
        target, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        made = set()
        for row in rows:
            place = f"{root}/{row['place']}" if row["place"] else root
            if place not in made:
                target.create_dir(place, recursive=True)
                made.add(place)
            final = f"{place}/{row['name']}.{ending}"
            partial = f"{place}/_{uuid.uuid4().hex}"
            with target.open_output_stream(partial) as out:
                out.write(bytes(row["content"]))
            target.move(partial, final)

    if "place" not in encoded.columns:
        encoded = _placed(encoded, by_image)
    encoded.select("place", "name", "content").foreachPartition(write)


def _placed(rows: DataFrame, by_image: bool) -> DataFrame:
    """``place`` and base ``name`` of every row's file; refused if two rows share one."""
    image = F.concat(F.lit("image-"), "image_id", F.lit("/zoom-"), "zoom_out") if by_image else F.lit("")
    placed = rows.withColumn("place", image).withColumn("name", base_name(F.col("name")))
    twice = placed.groupBy("place", "name").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['count']} rows would be written to {twice['place']}/{twice['name']}")
    return placed


def export_tiles(tiles: DataFrame, folder: str, kind: str = "png", by_image: bool = False) -> None:
    """Write every tile as a lossless image of its slice strip; see :func:`export_files`."""
    placed = _placed(tiles, by_image)
    encoded = encode_tiles(placed.withColumn("name", F.concat_ws("|", "place", "name")), kind)
    parts = F.split("name", r"\|")
    export_files(encoded.select(parts[0].alias("place"), parts[1].alias("name"), "content"), folder, kind)
