"""The log of tile batches: once per name, broken-off batches, doubled and known boxes, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import cut_volume, frame, tile
from voxelloom.schema import TILES
from voxelloom.sources import pixlog, tables
from voxelloom.sources.pixlog import PixLog


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def volume(spark):
    stack = np.random.default_rng(2).integers(0, 256, (8, 8, 8), dtype=np.uint8)
    return frame(spark, cut_volume(stack, (4, 4, 4)) + cut_volume(stack, (4, 4, 4), image_id=2, zoom_out=3))


def test_batches_count_once(spark, tmp_path, volume):
    log = PixLog(spark, str(tmp_path / "pix"))
    assert not log.exists() and log.read().count() == 0
    assert log.append("a/b #1", volume.where("x = 0"))
    assert not log.append("a/b #1", volume)
    assert rows_of(log.read()) == rows_of(volume.where("x = 0"))
    assert log.append("rest", volume) and log.append("none", volume.limit(0)) and log.append("again", volume)
    assert rows_of(log.read()) == rows_of(volume) == rows_of(tables.read_pix(spark, log.path))
    assert list(log.committed()) == ["a/b #1", "rest", "none", "again"]
    with pytest.raises(ValueError):
        tables.append_pix(volume, log.path)


def test_a_batch_that_broke_off_adds_nothing_twice(spark, tmp_path, volume):
    log = PixLog(spark, str(tmp_path / "pix"))
    log.append("one", volume.where("y = 0"))

    def fail(fresh):
        broken = F.when((F.col("image_id") == 2) & (F.col("z") == 4), F.raise_error(F.lit("lost"))).otherwise(F.col("name"))
        return fresh.withColumn("name", broken.cast("string"))

    with pytest.raises(Exception, match="lost"):
        log.append("two", volume, fail)
    # all data written, the commit lost
    volume.write.partitionBy("image_id", "zoom_out").mode("overwrite").parquet(log._folder(1))
    assert rows_of(log.read()) == rows_of(volume.where("y = 0"))
    log.append("two", volume)
    assert rows_of(log.read()) == rows_of(volume)


@pytest.mark.parametrize("few", [pixlog.FEW_BOXES, 0])
def test_doubled_and_known_boxes(spark, tmp_path, volume, monkeypatch, few):
    monkeypatch.setattr(pixlog, "FEW_BOXES", few)
    log = PixLog(spark, str(tmp_path / "pix"))
    other = volume.withColumn("pixels", F.unhex(F.lit("00" * 64)))
    log.append("one", volume.where("z = 0").unionByName(volume.where("z = 0")).unionByName(other.where("z = 0 and x = 0")))
    stored = rows_of(log.read())
    assert len(stored) == volume.where("z = 0").count()
    for row in stored:
        assert row[-1] == (bytes(64) if row[3] == 0 else row[-1])
    log.append("two", other)
    assert log.read().count() == volume.count() and set(stored) < set(rows_of(log.read()))
    unplaced = spark.createDataFrame([(1, "n", None, 0, 0, 0, 1, 1, 1, bytearray(b"a"))] * 2, TILES)
    log.append("unplaced", unplaced)
    assert log.read().where("zoom_out is null").count() == 2


def test_payloads_are_not_shuffled(spark, tmp_path, volume):
    log = PixLog(spark, str(tmp_path / "pix"))
    log.append("one", volume.where("x = 0"))
    source = str(tmp_path / "source")
    volume.write.parquet(source)
    fresh = log.unseen(spark.read.parquet(source))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert fresh.count() == volume.where("x <> 0").count()


def test_only_folders_of_the_batch_are_read(spark, tmp_path, volume):
    log = PixLog(spark, str(tmp_path / "pix"))
    log.append("one", volume)
    two = frame(spark, [tile(np.zeros((4, 4, 4)), (100, 0, 0), image_id=2, zoom_out=3)])
    plan = log.stored_boxes(two)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "image_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert log.stored_boxes(two).select("image_id").distinct().collect() == [(2,)]
    log.append("two", two)
    assert log.read().count() == volume.count() + 1
