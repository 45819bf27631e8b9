"""Tile names: ``x0-x1_y0-y1_z0-z1`` with exclusive ends; coordinates may be negative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.schema import AXES, BOX

_RANGE = r"(-?\d+)-(-?\d+)"
NAME_PATTERN = f"^{_RANGE}_{_RANGE}_{_RANGE}$"


def base_name(path: Column) -> Column:
    """Last path component without its ``.jpg`` ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jpg$", "")


def box_of_name(name: Column) -> Column:
    """The six box fields as a struct; NULL for a name that is malformed, empty or out of range."""
    bounds = [F.regexp_extract(name, NAME_PATTERN, i + 1).try_cast("int") for i in range(6)]
    starts, ends = bounds[0::2], bounds[1::2]
    dims = [(e.cast("long") - s).try_cast("int") for s, e in zip(starts, ends)]
    valid = F.lit(True)
    for dim in dims:
        valid = valid & (dim > 0)
    fields = [c.alias(n) for c, n in zip(starts + dims, BOX)]
    return F.when(valid, F.struct(*fields))


def name_of_box(prefix: str = "") -> Column:
    """Inverse of :func:`box_of_name`, from columns named like the box fields."""
    parts = []
    for axis in AXES:
        start = F.col(prefix + axis).cast("long")
        parts.append(F.concat_ws("-", start, start + F.col(prefix + axis + "_dim")))
    return F.concat_ws("_", *parts)


def parse_names(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``name``, the six box columns and ``valid``; rows with a bad name are kept and flagged."""
    named = df.withColumn("name", base_name(F.col(path)))
    boxed = named.withColumn("_box", box_of_name(F.col("name")))
    return boxed.select(
        *[F.col(c) for c in named.columns],
        *[F.col(f"_box.{c}").alias(c) for c in BOX],
        F.col("_box").isNotNull().alias("valid"),
    )
