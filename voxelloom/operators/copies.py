"""Collapse equal rows before a shuffle and restore them afterwards.

A table without a key may hold the same row very often. Counting the copies map-side keeps them out of the
shuffle; cutting large counts into portions keeps any one row from standing for too many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PORTION = 10_000


def collapse_copies(df: DataFrame, portion: int = PORTION) -> DataFrame:
    """Distinct rows with ``_portion`` and ``_copies`` (at most ``portion``); the copies add up to the row count."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    last = F.expr(f"(_n - 1) div {portion}")
    split = counted.withColumn("_portion", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    left = F.col("_n") - F.col("_portion") * portion
    return split.withColumn("_copies", F.least(left, F.lit(portion).cast("long"))).drop("_n")


def restore_copies(df: DataFrame) -> DataFrame:
    """Undo :func:`collapse_copies`."""
    repeated = df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return repeated.drop("_copy", "_copies", "_portion")
