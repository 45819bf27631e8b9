import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import cut_volume, frame, stack_of, tile
from voxelloom.operators.roi import roi_assemble, roi_join
from voxelloom.schema import ROI, TILES
from voxelloom.sources import spatial

RNG = np.random.default_rng(8)


@pytest.fixture(scope="module")
def volume():
    return RNG.integers(0, 256, (16, 32, 32), dtype=np.uint8)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, volume):
    """128 tiles of 4x4x8 in 16 regions of each of two images, one of them twice."""
    path = str(tmp_path_factory.mktemp("spatial") / "pix")
    rows = cut_volume(volume, (4, 4, 8), (-8, 0, 0), image_id=1) + cut_volume(volume, (4, 4, 8), image_id=2)
    spatial.write_spatial(frame(spark, [*rows, rows[0]]), path, edge=8)
    return path


def asked(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], ROI)


def scanned(df):
    """Rows that the scans of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        elif name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_all_tiles_come_back(spark, stored):
    whole = spatial.read_spatial(spark, stored)
    assert whole.schema.names == TILES.names and whole.count() == 2 * 128 + 1
    assert spatial.regions(spark, stored).agg(F.sum("n")).first()[0] == 2 * 128 + 1
    box = spatial.regions(spark, stored).where("image_id = 1 and region = '-1_0_0'").first()
    assert [box[c] for c in ("n", "x", "y", "z", "x_end", "y_end", "z_end")] == [5, -8, 0, 0, 0, 8, 8]


@pytest.mark.parametrize("named", [spatial.NAMED_REGIONS, 0])
def test_two_requests_far_apart_read_only_their_regions(spark, stored, volume, monkeypatch, named):
    monkeypatch.setattr(spatial, "NAMED_REGIONS", named)
    corners = asked(spark, (1, 1, -8, 0, 0, 3, 3, 3), (1, 1, 22, 30, 14, 2, 2, 2))
    found = spatial.read_requested(spark, stored, corners)
    # four tiles of one region and a copy, four of the other; between the two requests lies the whole image
    assert scanned(found) == 5 + 4
    cut = {r["req_id"]: stack_of(r) for r in roi_assemble(found, corners).collect()}
    assert (cut[0] == volume[:3, :3, :3]).all() and (cut[1] == volume[14:, 30:, 30:]).all()


@pytest.mark.parametrize("named", [spatial.NAMED_REGIONS, 1])
@pytest.mark.parametrize("touching", [False, True])
def test_requests_find_what_they_find_in_the_whole_table(spark, stored, monkeypatch, named, touching):
    monkeypatch.setattr(spatial, "NAMED_REGIONS", named)
    boxes = RNG.integers(-12, 34, (40, 3)), RNG.integers(0, 9, (40, 3))
    requests = asked(spark, *[(1 + i % 3, 1, *map(int, low), *map(int, size)) for i, (low, size) in enumerate(zip(*boxes))])
    pairs = lambda tiles: sorted(map(tuple, roi_join(tiles, requests, touching).collect()))
    assert pairs(spatial.read_requested(spark, stored, requests, touching)) == pairs(spatial.read_spatial(spark, stored)) != []


def test_tiles_that_reach_out_of_their_region_are_found(spark, tmp_path):
    path = str(tmp_path / "pix")
    spatial.write_spatial(frame(spark, [tile(np.full((2, 2, 40), 7), (1, 1, 1)), tile(np.ones((1, 1, 1)), (99, 0, 0))]), path, edge=8)
    far = asked(spark, (1, 1, 39, 1, 1, 5, 2, 2))
    assert [r["x_dim"] for r in spatial.read_requested(spark, path, far).collect()] == [40]
    assert spatial.read_requested(spark, path, asked(spark, (1, 1, 60, 1, 1, 5, 2, 2))).count() == 0
    assert spatial.read_requested(spark, path, asked(spark, (1, 2, 1, 1, 1, 5, 2, 2))).count() == 0


def test_a_crowded_region_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "pix")
    same = frame(spark, [tile(np.full((4, 4, 4), i % 200), name="copy") for i in range(4000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spatial.write_spatial(same, path, edge=64)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spatial.read_spatial(spark, path).select(F.input_file_name()).distinct().count() > 1
    assert spatial.read_spatial(spark, path).count() == 4000


def test_the_curve_interleaves_bits(spark):
    points = RNG.integers(-600_000, 600_000, (50, 3)).tolist()
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, x int, y int, z int")
    got = {r["i"]: r["at"] for r in rows.select("i", spatial.curve_place(F.col("x"), F.col("y"), F.col("z")).alias("at")).collect()}
    for i, point in enumerate(points):
        placed = [min(max(p + (1 << 19), 0), (1 << 20) - 1) for p in point]
        assert got[i] == sum(((p >> bit) & 1) << (3 * bit + axis) for axis, p in enumerate(placed) for bit in range(20))


def test_incomplete_existing_empty_and_odd(spark, stored, tmp_path):
    with pytest.raises(Exception, match="already exists"):
        spatial.write_spatial(frame(spark, []), stored)
    broken = frame(spark, [(1, "n", None, 0, 0, 0, 1, 1, 1, bytearray(1))])
    with pytest.raises(Exception, match="without an image, zoom or box"):
        spatial.write_spatial(broken, str(tmp_path / "broken"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spatial.read_spatial(spark, str(tmp_path / "broken"))
    spatial.write_spatial(frame(spark, []), str(tmp_path / "none"))
    assert spatial.read_spatial(spark, str(tmp_path / "none")).count() == 0
    assert spatial.read_requested(spark, str(tmp_path / "none"), asked(spark, (1, 1, 0, 0, 0, 5, 5, 5))).count() == 0
    assert spatial.read_requested(spark, stored, asked(spark)).count() == 0
