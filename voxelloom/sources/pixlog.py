"""A tile table whose batches are committed once, by name.

Every batch lies in a folder of its own, and counts from the moment on that a file with its name stands in ``_commits``; that file
is created last. A job that broke off leaves a folder that nobody reads and that the next batch writes over, and a batch that is
appended again under its name changes nothing. Within a batch, tiles whose box is stored already are left out, and of
several tiles with one box one stays. Both are found out by boxes: payloads stay where they are, except those of
boxes that the batch itself has more than once.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.schema import TILE_KEY, TILES, VOLUME
from voxelloom.session import reliable_checkpoint

COMMITS = "_commits"
#: Boxes, of eight integers each, that are sent to all executors.
FEW_BOXES = 1_000_000
#: Images and zooms that are named in a filter on folders.
NAMED_VOLUMES = 1000


class PixLog:
    """One writer at a time; of two that race for a batch one fails. Readers may read meanwhile."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._at(COMMITS).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._files().exists(self._at(COMMITS))

    def committed(self) -> dict[str, int]:
        """The step of each committed batch by its name, oldest first."""
        if not self.exists():
            return {}
        names = sorted(status.getPath().getName() for status in self._files().listStatus(self._at(COMMITS)))
        return {unquote(name.split("-", 1)[1]): int(name.split("-", 1)[0]) for name in names}

    def _folder(self, step: int) -> str:
        return f"{self.path}/batch={step:08d}"

    def read(self) -> DataFrame:
        """The tiles of all committed batches; filters on image and zoom prune whole folders."""
        steps = self.committed().values()
        if not steps:
            return self.spark.createDataFrame([], TILES)
        reader = self.spark.read.schema(T.StructType([*TILES.fields, T.StructField("batch", T.IntegerType())])).option("basePath", self.path)
        return reader.parquet(*map(self._folder, steps)).select(*TILES.fieldNames())

    def stored_boxes(self, boxes: DataFrame) -> DataFrame:
        """The stored boxes of the images and zooms that occur among ``boxes``; the folders of others are not read."""
        stored = self.read().select(*TILE_KEY)
        volumes = boxes.select(*VOLUME).distinct().limit(NAMED_VOLUMES + 1).collect()
        if len(volumes) > NAMED_VOLUMES:
            return stored
        for column in VOLUME:
            stored = stored.where(F.col(column).isin(sorted({v[column] for v in volumes} - {None})))
        return stored

    def unseen(self, tiles: DataFrame) -> DataFrame:
        """The tiles whose box is not stored yet for their image and zoom, one per box: the least by name and payload.

        A tile without an image, zoom or box is never taken for another one.
        """
        tiles = tiles.select(*TILES.fieldNames())
        boxes = reliable_checkpoint(tiles.groupBy(*TILE_KEY).agg(F.count(F.lit(1)).alias("_n")))
        stored = self.stored_boxes(boxes)
        known = boxes.join(stored.distinct(), TILE_KEY, "left_semi").withColumn("_keep", F.lit(False))
        whole = F.lit(True)
        for c in TILE_KEY:
            whole = whole & F.col(c).isNotNull()
        repeated = boxes.where((F.col("_n") > 1) & whole).join(stored, TILE_KEY, "left_anti").withColumn("_keep", F.lit(True))
        special = reliable_checkpoint(known.unionByName(repeated).drop("_n"))
        many = special.groupBy("_keep").count().collect()  # two rows at most
        counts = {row["_keep"]: row["count"] for row in many}
        if not counts:
            return tiles
        send = F.broadcast if sum(counts.values()) <= FEW_BOXES else lambda df: df
        fresh = tiles.join(send(special.drop("_keep")), TILE_KEY, "left_anti")
        if counts.get(True):
            doubled = tiles.join(send(special.where("_keep").drop("_keep")), TILE_KEY, "left_semi")
            one = doubled.groupBy(*TILE_KEY).agg(F.min(F.struct("name", "pixels")).alias("t"))
            fresh = fresh.unionByName(one.select(*TILE_KEY, "t.name", "t.pixels"))
        return fresh.select(*TILES.fieldNames())

    def append(self, name: str, tiles: DataFrame, apply: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Add a batch, and say whether it was new. ``apply`` is a filter for what is added; it must keep boxes."""
        done = self.committed()
        if name in done:
            return False
        step = max(done.values(), default=-1) + 1
        fresh = self.unseen(tiles)
        rows = apply(fresh) if apply else fresh
        rows.select(*TILES.fieldNames()).write.partitionBy(*VOLUME).mode("overwrite").parquet(self._folder(step))
        self._files().create(self._at(COMMITS, f"{step:08d}-{quote(name, safe='')}"), False).close()
        return True
