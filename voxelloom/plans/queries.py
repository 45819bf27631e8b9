"""The queries by name; each takes a session and a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.functions.names import name_of_box, parse_names
from voxelloom.operators import bandpass as bp
from voxelloom.operators import borders, color, counting, gauss, histogram, layout, ordering, registration, roi, seamless, stacks, threshold, typed
from voxelloom.operators.filters import apply_filter
from voxelloom.plans.fixtures import SIDE, color_tiles, deep_tiles, large_tiles, loose_tiles, paths, request_lines, requests, table, tiles
from voxelloom.schema import TILE_META
from voxelloom.session import shared_folder
from voxelloom.sources import spatial, tables
from voxelloom.sources.pixlog import PixLog

Query = Callable[[SparkSession, str], DataFrame]

SIGMAS = (1.0, 0.9, 1.0)
SATURATED = 25.0
SLICE = ("image_id", "zoom_out", "name", "z")
STRIPED = [bp.Band(stripes=s) for s in bp.STRIPES]
# Cell edge for the border exchange; the tiles here are far smaller than real ones.
CELL = (4 * SIDE,) * 3

THRESHOLDS = {
    "default": "Default",
    "huang": "Huang",
    "otsu": "Otsu",
    "mean": "Mean",
    "percentile": "Percentile",
    "max_entropy": "MaxEntropy",
    "yen": "Yen",
    "triangle": "Triangle",
    "li": "Li",
    "min_error": "MinError",
    "intermodes": "Intermodes",
    "minimum": "Minimum",
    "moments": "Moments",
    "renyi_entropy": "RenyiEntropy",
    "shanbhag": "Shanbhag",
}


def _hex(df: DataFrame) -> DataFrame:
    """Payloads as text, so that results compare the same everywhere."""
    return df.withColumn("pixels", F.hex("pixels"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("req_id", "image_id", "name", "x", "y", "z")


def _over_tiles(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(tiles(spark, sf))


def _to_voxels(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: layout.voxel_explode(operator(tiles(spark, sf)))


def _deep(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: typed.voxels_typed(operator(deep_tiles(spark, sf)))


def _requested(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(tiles(spark, sf), requests(spark, sf))


def _name_format(spark: SparkSession, sf: str) -> DataFrame:
    boxes = requests(spark, sf).withColumnsRenamed({"width": "x_dim", "height": "y_dim", "depth": "z_dim"})
    return boxes.select("req_id", name_of_box().alias("name"))


def _retile(df: DataFrame) -> DataFrame:
    return _hex(layout.tiles_from_voxels(layout.voxel_explode(df), (2 * SIDE,) * 3))


def _append(df: DataFrame) -> DataFrame:
    filtered = df.withColumn("image_id", F.col("image_id") + 1000)
    return tables.union_pix(tables.as_pix(df), tables.as_pix(filtered))


def _logged(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of a log: odd images, one of them repeated and doubled, then all, and what the log holds in the end."""
    volume = tiles(spark, sf)
    log = PixLog(spark, shared_folder(spark, "pix"))
    odd = volume.where("image_id % 2 = 1 and x < 16")
    log.append("odd", odd.unionByName(odd.where("y < 8")))
    log.append("odd", volume)
    log.append("all", volume.withColumn("name", F.concat("name", F.lit("!"))))
    return log.read().select(*TILE_META)


def _laid_out(spark: SparkSession, sf: str) -> str:
    """All tiles as a table by place, with regions of 2x2x2 tiles."""
    path = shared_folder(spark, "spatial")
    spatial.write_spatial(tiles(spark, sf), path, edge=2 * SIDE)
    return path


def _read_by_place(spark: SparkSession, sf: str) -> DataFrame:
    asked = requests(spark, sf)
    return _pairs(roi.roi_join(spatial.read_requested(spark, _laid_out(spark, sf), asked), asked))


def _assembled(volume: DataFrame, asked: DataFrame) -> DataFrame:
    return _hex(roi.roi_assemble(volume, asked)).select("req_id", *TILE_META, "pixels")


def _assembled_blur(volume: DataFrame, asked: DataFrame) -> DataFrame:
    return _hex(roi.roi_blur(volume, asked, *SIGMAS)).select("req_id", "image_id", "name", "pixels")


def _blur_in_blocks(volume: DataFrame, asked: DataFrame) -> DataFrame:
    """The same voxels, each request cut into blocks of a few voxels."""
    small = roi.roi_blur(volume, asked, *SIGMAS, chunk_voxels=12)
    return layout.voxel_explode(small.withColumn("image_id", F.col("req_id").cast("int"))).withColumnRenamed("image_id", "req_id")


def _filter_grid(df: DataFrame) -> DataFrame:
    grids = [bp.bandpass_filter_grid(df, band) for band in STRIPED]
    return reduce(DataFrame.unionByName, grids).withColumn("factor", F.round("factor", 6))


def _levels(df: DataFrame) -> DataFrame:
    return threshold.threshold_levels(histogram.slice_histogram(df), *SLICE)


def _levels_of_copies(df: DataFrame) -> DataFrame:
    """Tiles of even images stored twice, and all tiles on a second zoom as well."""
    copies = df.unionByName(df.where("image_id % 2 = 0 or x % 8 = 0")).unionByName(df.withColumn("zoom_out", F.lit(2)))
    return _levels(copies)


def _range(df: DataFrame) -> DataFrame:
    counts = histogram.slice_histogram(df)
    return histogram.contrast_range(counts, *SLICE, saturated=SATURATED)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "tile_name_parse": lambda spark, sf: parse_names(paths(spark, sf)),
        "tile_name_format": _name_format,
        "tile_slices": _over_tiles(lambda df: _hex(layout.tile_slices(df)).select("image_id", "name", "z", "pixels")),
        "tile_flatten": _over_tiles(_retile),
        "voxel_explode": _over_tiles(layout.voxel_explode),
        "strip_layout": _over_tiles(layout.strip_layout),
        "last_slice": _over_tiles(lambda df: _hex(layout.last_slice(df)).select("image_id", "name", "z", "pixels")),
        "tile_extents": _over_tiles(layout.tile_extents),
        "pixels_csv": _over_tiles(layout.pixels_csv),
        "tile_sizes": _over_tiles(layout.tile_sizes),
        "slice_flip": _to_voxels(lambda df: layout.flip(df, horizontal=True, vertical=True)),
        "roi_requests": lambda spark, sf: roi.parse_requests(request_lines(spark, sf), req_id="req_id"),
        "roi_join": _requested(lambda t, r: _pairs(roi.roi_join(t, r))),
        "roi_join_touching": _requested(lambda t, r: _pairs(roi.roi_join(t, r, touching=True))),
        "roi_join_grid": _requested(lambda t, r: _pairs(roi.roi_join(t, r, strategy="shuffle"))),
        "roi_first_tile": _requested(lambda t, r: _pairs(roi.first_tile(roi.roi_join(t, r)))),
        "roi_assemble": _requested(_assembled),
        "roi_gauss": _requested(_assembled_blur),
        "roi_gauss_blocks": _requested(_blur_in_blocks),
        "request_count": lambda spark, sf: counting.keyed_count(requests(spark, sf), "image_id"),
        "word_count": lambda spark, sf: counting.word_count(table(spark, sf, "documents")),
        "word_count_ci": lambda spark, sf: counting.word_count(table(spark, sf, "documents"), case_sensitive=False),
        "tiles_zyx_rank": _over_tiles(lambda df: ordering.zyx_rank(df).select("image_id", "name", "rank")),
        "tiles_name_rank": _over_tiles(ordering.name_rank),
        "pix_append": _over_tiles(_append),
        "pix_log": _logged,
        "pix_regions": lambda spark, sf: spatial.regions(spark, _laid_out(spark, sf)),
        "pix_by_place": _read_by_place,
        "image_register": _over_tiles(tables.images_of),
        "slice_histogram": _over_tiles(histogram.slice_histogram),
        "contrast_range": _over_tiles(_range),
        "contrast_stretch": _to_voxels(histogram.contrast_stretch),
        "gauss3d_tile": _to_voxels(lambda df: gauss.gauss3d_tile(df, *SIGMAS)),
        "gauss3d_seamless": _to_voxels(lambda df: seamless.gauss3d_seamless(df, *SIGMAS, cell=CELL)),
        "gauss3d_borders": lambda spark, sf: layout.voxel_explode(borders.gauss3d_borders(large_tiles(spark, sf), *SIGMAS)),
        "gauss_strip2d": _to_voxels(lambda df: gauss.gauss_strip2d(df, *SIGMAS[:2])),
        "gauss3d_iso": _to_voxels(lambda df: gauss.gauss3d_iso(df, 1.0)),
        "fft_pad_size": lambda spark, sf: bp.fft_pad_size(
            requests(spark, sf).select("req_id", "width", "height"), "width", "height"
        ),
        "mirror_pad": _over_tiles(bp.mirror_pad),
        "bandpass_filter_grid": _over_tiles(_filter_grid),
        "threshold_levels": _over_tiles(_levels),
        "levels_of_copies": _over_tiles(_levels_of_copies),
        "plugin_filter": _to_voxels(lambda df: apply_filter(df, "invert")),
        "color_invert": lambda spark, sf: color.channels(color.filter_color(color_tiles(spark, sf), "invert"), layout.voxel_explode),
        "register_stacks": lambda spark, sf: stacks.solve_offsets(stacks.register_stacks(loose_tiles(spark, sf))).drop("root"),
        "register_pairs": _over_tiles(registration.register_pairs),
    }
    found |= {
        "gauss3d_16bit": _deep(lambda df: typed.gauss3d_typed(df, *SIGMAS)),
        "contrast_stretch_16bit": _deep(lambda df: typed.stretch_typed(df, SATURATED)),
        "convert_16_to_8bit": _deep(lambda df: typed.convert_type(df, "uint8")),
        "threshold_16bit": _deep(lambda df: typed.threshold_typed(df, "Otsu")),
        "bandpass_16bit": _deep(lambda df: typed.bandpass_typed(df, bp.Band())),
        "histogram_16bit": lambda spark, sf: typed.histogram_typed(deep_tiles(spark, sf)),
    }
    for band in STRIPED:
        suffix = "" if band.stripes == "none" else f"_{band.stripes}"
        found[f"bandpass{suffix}"] = _to_voxels(lambda df, b=band: bp.bandpass(df, b))
    for key, method in THRESHOLDS.items():
        found[f"threshold_{key}"] = _to_voxels(lambda df, m=method: threshold.auto_threshold(df, m))
    return found
