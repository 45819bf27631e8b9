"""What a job reads, keeps and drops, counted while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voxelloom.sources.images import usable

PROBLEMS = ("name", "decode", "color", "shape")


class Watched:
    """Decoded tiles with a ``problem`` column, counted in the pass that the job makes anyway.

    Build the job on :meth:`tiles`, run it, then ask for the :meth:`report`. Nothing that samples its input, such as a range
    partitioning, may stand between the two, or rows would be counted twice.
    """

    def __init__(self, decoded: DataFrame) -> None:
        self.decoded, self._watch = decoded, Observation()
        counts = [F.count_if(F.col("problem") == kind).alias(kind) for kind in PROBLEMS]
        self._observed = decoded.observe(self._watch, F.count(F.lit(1)).alias("read"), F.count_if(F.col("problem").isNull()).alias("kept"), *counts)

    def tiles(self, on_error: str = "skip") -> DataFrame:
        return usable(self._observed, on_error)

    def report(self, quarantine: str | None = None) -> dict[str, int]:
        """Rows read and kept, and dropped by problem, of the action that was run.

        With ``quarantine`` path and problem of the dropped rows are appended to a table there, its folders named after
        the problems; for that the input is read again, but only where something was dropped.
        """
        found = {"read": 0, "kept": 0, **dict.fromkeys(PROBLEMS, 0)} | self._watch.get
        if quarantine is not None and found["read"] > found["kept"]:
            dropped = self.decoded.where(F.col("problem").isNotNull()).select("path", "problem")
            dropped.write.partitionBy("problem").mode("append").parquet(quarantine)
        return found
