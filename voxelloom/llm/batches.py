"""Append-only Parquet logs whose batches are committed once, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class BatchLog:
    """Tables in a shared folder, one part of each per batch.

    A batch counts once its name is in ``commits``, a file that is created last. What a broken-off batch left behind is
    overwritten by the next one. One writer at a time; readers may read meanwhile.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the committed batches, oldest first."""
        if not self._files().exists(self._path("commits")):
            return []
        found = [x.getPath().getName() for x in self._files().listStatus(self._path("commits"))]
        return [x.split("-", 1)[1] for x in sorted(found)]

    def read(self, table: str, shape: T.StructType) -> DataFrame:
        """The rows of all committed batches."""
        steps = [f"{self.folder}/{table}/{step:08d}" for step, _ in enumerate(self.batches())]
        if not steps:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*steps)

    def write(self, step: int, table: str, rows: DataFrame) -> DataFrame:
        """Write a table's part of a batch that is not committed yet, and read it back."""
        where = f"{self.folder}/{table}/{step:08d}"
        rows.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(rows.schema).parquet(where)

    def commit(self, step: int, name: str) -> None:
        self._files().create(self._path("commits", f"{step:08d}-{name}"), False).close()
