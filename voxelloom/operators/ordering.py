"""Global order of tiles made visible as a rank, computed without a single-task sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.operators.copies import collapse_copies
from voxelloom.schema import TILE_META
from voxelloom.session import reliable_checkpoint


def _rows_before(batches):
    """Running count of the rows that precede each row inside its sorted partition."""
    seen = 0
    for batch in batches:
        copies = batch.column("_copies").to_numpy()
        ends = seen + np.cumsum(copies)
        seen = int(ends[-1]) if ends.size else seen
        yield batch.append_column("_row", pa.array(ends - copies, pa.int64()))


def ordered_rank(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """Number the rows 1..n in the order of ``order``; the other columns break ties.

    Equal rows are counted first, then the distinct rows are range-partitioned and sorted. Only the size of
    each partition is combined globally, so the table of offsets has one row per partition. The sorted rows
    are checkpointed because offsets and rows must see the same range bounds.
    """
    columns = df.columns
    keys = [*order, *[c for c in columns if c not in order], "_portion"]
    placed = (
        collapse_copies(df)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
    )
    numbered = T.StructType([*placed.schema.fields, T.StructField("_row", T.LongType())])
    placed = reliable_checkpoint(placed.mapInArrow(_rows_before, numbered))
    sizes = placed.groupBy("_part").agg(F.sum("_copies").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    # one row per shuffle partition, so always small enough to send everywhere
    joined = placed.join(F.broadcast(offsets), "_part")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return joined.withColumn("_copy", copy).select(
        *columns, (F.col("_before") + F.col("_row") + F.col("_copy")).alias(rank)
    )


def zyx_rank(tiles: DataFrame) -> DataFrame:
    """Tiles ranked by z, then y, then x."""
    return ordered_rank(tiles.select(*TILE_META), ["z", "y", "x"])


def name_rank(tiles: DataFrame) -> DataFrame:
    """Tiles ranked by name, compared byte by byte."""
    return ordered_rank(tiles.select("image_id", "name"), ["name"])
