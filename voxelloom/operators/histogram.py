"""Grey histograms per slice, percentile range and contrast stretch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.batches import STACK_VOXELS, ints, map_payloads, per_slices, stacks
from voxelloom.schema import TILE_META

LEVELS = 256


def histograms(slices: np.ndarray) -> np.ndarray:
    """Dense counts (slices, 256) of uint8 slices (slices, ...)."""
    flat = slices.reshape(len(slices), -1)
    counts = np.empty((len(flat), LEVELS), np.int64)
    step = max(1, STACK_VOXELS // flat.shape[1])
    for i in range(0, len(flat), step):
        part = flat[i : i + step]
        index = part + np.arange(0, len(part) * LEVELS, LEVELS, dtype=np.int32)[:, None]
        counts[i : i + step] = np.bincount(index.ravel(), minlength=len(part) * LEVELS).reshape(-1, LEVELS)
    return counts


def apply_levels(slices: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Replace every grey value by its entry in the slice's own 256-entry table."""
    count = slices.shape[0]
    return table[np.arange(count)[:, None], slices.reshape(count, -1)].reshape(slices.shape)


def slice_histogram(tiles: DataFrame) -> DataFrame:
    """Count of each grey value that occurs in each slice; counted where the tile is, without a shuffle.

    Copies of a tile give rows of their own; :func:`merged` adds them up.
    """

    def run(batches):
        for batch in batches:
            heads = ints(batch, ["image_id", "zoom_out", "z"])
            names = batch.column("name")
            for rows, stack in stacks(batch):
                n, depth = stack.shape[:2]
                counts = histograms(stack.reshape(n * depth, -1))
                which, value = np.nonzero(counts)
                tile, iz = rows[which // depth], which % depth
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(heads[tile, 0].astype(np.int32)),
                        pa.array(heads[tile, 1].astype(np.int32)),
                        names.take(pa.array(tile)),
                        pa.array((heads[tile, 2] + iz).astype(np.int32)),
                        pa.array(value.astype(np.int32)),
                        pa.array(counts[which, value]),
                    ],
                    names=["image_id", "zoom_out", "name", "z", "v", "n"],
                )

    schema = "image_id int, zoom_out int, name string, z int, v int, n long"
    return tiles.select(*TILE_META, "pixels").mapInArrow(run, schema)


def merged(histogram: DataFrame, *keys: str) -> DataFrame:
    """One row per key and grey value, dealt out by the keys alone, as the windows over a slice need them."""
    return histogram.select(*keys, "v", "n").repartition(*keys).groupBy(*keys, "v").agg(F.sum("n").alias("n"))


def histogram_from_voxels(voxels: DataFrame, *keys: str) -> DataFrame:
    """The same counts from voxel rows; partial counts are taken before the shuffle."""
    return voxels.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def _cut_count(total, saturated: float):
    """Pixels that may be clipped at each end of the range."""
    return total * saturated / 200.0


def contrast_range(histogram: DataFrame, *keys: str, saturated: float = 1.0) -> DataFrame:
    """Grey range per slice after clipping ``saturated`` percent of the pixels, half at each end.

    Rows with equal keys and grey value are added up.
    """
    window = Window.partitionBy(*keys)
    up = window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    down = window.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    limit = F.floor(_cut_count(F.sum("n").over(window), saturated))
    ranked = merged(histogram, *keys).select(
        *keys, "v", F.sum("n").over(up).alias("_below"), F.sum("n").over(down).alias("_above"), limit.alias("_limit")
    )
    return ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("_below") > F.col("_limit"), F.col("v"))).alias("lo"),
        F.max(F.when(F.col("_above") > F.col("_limit"), F.col("v"))).alias("hi"),
    )


def range_of(counts: np.ndarray, saturated: float) -> tuple[np.ndarray, np.ndarray]:
    limit = np.floor(_cut_count(counts.sum(axis=1), saturated))[:, None]
    low = np.argmax(np.cumsum(counts, axis=1) > limit, axis=1)
    high = LEVELS - 1 - np.argmax(np.cumsum(counts[:, ::-1], axis=1) > limit, axis=1)
    return low, high


def stretch(slices: np.ndarray, saturated: float = 1.0) -> np.ndarray:
    """Map the range of every slice to 0..255, rounding half up; a slice without a range is kept."""
    low, high = range_of(histograms(slices), saturated)
    span = np.maximum(high - low, 1)[:, None]
    grey = np.clip(np.arange(LEVELS)[None, :] - low[:, None], 0, span)
    table = (2 * 255 * grey + span) // (2 * span)
    table = np.where((high > low)[:, None], table, np.arange(LEVELS)[None, :])
    return apply_levels(slices, table.astype(np.uint8))


def contrast_stretch(tiles: DataFrame, saturate: bool = True) -> DataFrame:
    """Stretch every slice, clipping one percent of its pixels or none."""
    saturated = 1.0 if saturate else 0.0
    return tiles.mapInArrow(map_payloads(lambda s: per_slices(s, lambda part: stretch(part, saturated))), tiles.schema)
