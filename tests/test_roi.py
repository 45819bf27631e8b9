import random

import numpy as np
import pytest

from helpers import cut_volume, frame, slow_blur, stack_of, tile, voxels_of
from voxelloom.operators import boxjoin, seamless
from voxelloom.operators.copies import collapse_copies, restore_copies
from voxelloom.operators.roi import first_tile, parse_requests, read_requests, roi_assemble, roi_blur, roi_join
from voxelloom.schema import ROI

RNG = np.random.default_rng(11)


def requests(spark, boxes, image_id=1):
    return spark.createDataFrame([(i, image_id, 1, *b) for i, b in enumerate(boxes)], ROI)


def slow_pairs(tiles, boxes, touching):
    out = []
    for i, (x, y, z, w, h, d) in enumerate(boxes):
        for t in tiles:
            low, dims = t[3:6], t[6:9]
            if touching:
                hit = all(a >= s - n and a <= s + e for a, n, s, e in zip(low, dims, (x, y, z), (w, h, d)))
            else:
                hit = all(a > s - n and a < s + e for a, n, s, e in zip(low, dims, (x, y, z), (w, h, d)))
            if hit:
                out.append((i, t[1]))
    return sorted(out)


def mixed_tiles(seed, count=60):
    """Irregular, overlapping tiles of very different sizes."""
    pick = random.Random(seed)
    rows = []
    for i in range(count):
        w, h, d = (pick.choice([1, 2, 4, 5, 40]) for _ in range(3))
        origin = tuple(pick.randint(-50, 50) for _ in range(3))
        rows.append(tile(np.zeros((d, h, w)), origin, name=f"t{i}"))
    return rows


def mixed_boxes(seed, count=80):
    pick = random.Random(seed)
    boxes = [tuple(pick.randint(-60, 60) for _ in range(3)) + tuple(pick.choice([0, 1, 3, 30, 900]) for _ in range(3)) for _ in range(count)]
    return boxes + [(-(2**31), -(2**31), -(2**31), 2**31 - 1, 2**31 - 1, 2**31 - 1), (5, 5, 5, 0, 0, 0), (0, 0, 0, -3, 4, 4)]


@pytest.mark.parametrize("touching", [False, True])
@pytest.mark.parametrize("strategy,hot", [("auto", 50_000), ("broadcast", 50_000), ("shuffle", 50_000), ("shuffle", 3)])
def test_join_equals_brute_force(spark, monkeypatch, touching, strategy, hot):
    monkeypatch.setattr(boxjoin, "HOT_KEYS", 1 << 40)
    monkeypatch.setattr(boxjoin, "BROADCAST_CELLS", 1 << 40)
    rows, boxes = mixed_tiles(1), mixed_boxes(2)
    got = roi_join(frame(spark, rows), requests(spark, boxes), touching, strategy, hot_rows=hot)
    assert sorted((r["req_id"], r["name"]) for r in got.collect()) == slow_pairs(rows, boxes, touching)


@pytest.mark.parametrize("hot", [2, 50_000])
def test_join_keeps_every_copy_of_a_hot_tile_and_request(spark, monkeypatch, hot):
    monkeypatch.setattr(boxjoin, "HOT_KEYS", 1 << 40)
    rows = cut_volume(np.zeros((4, 8, 8)), (4, 4, 4)) + [tile(np.zeros((4, 4, 4)))] * 30
    boxes = [(0, 0, 0, 2, 2, 2)] * 40 + [(3, 3, 3, 4, 4, 4)]
    got = roi_join(frame(spark, rows), requests(spark, boxes), strategy="shuffle", hot_rows=hot)
    assert sorted((r["req_id"], r["name"]) for r in got.collect()) == slow_pairs(rows, boxes, False)


def test_join_separates_images_and_zooms(spark):
    rows = [tile(np.zeros((2, 2, 2)), image_id=i, zoom_out=z, name=f"{i}/{z}") for i in (1, 2) for z in (1, 2)]
    got = roi_join(frame(spark, rows), requests(spark, [(0, 0, 0, 9, 9, 9)], image_id=2)).collect()
    assert [r["name"] for r in got] == ["2/1"]


def test_touching_is_not_overlapping(spark):
    rows, boxes = [tile(np.zeros((4, 4, 4)))], [(4, 0, 0, 2, 2, 2), (4, 4, 4, 1, 1, 1), (5, 0, 0, 1, 1, 1), (-2, 0, 0, 2, 2, 2)]
    df, asked = frame(spark, rows), requests(spark, boxes)
    assert roi_join(df, asked).count() == 0
    assert sorted(r["req_id"] for r in roi_join(df, asked, touching=True).collect()) == [0, 1, 3]


def test_only_few_request_cells_are_broadcast(spark, monkeypatch):
    df, asked = frame(spark, [tile(np.zeros((2, 2, 2)))]), requests(spark, [(0, 0, 0, 2, 2, 2)] * 3)
    monkeypatch.setattr(boxjoin, "BROADCAST_CELLS", 3)
    with pytest.raises(ValueError, match="too many to broadcast"):
        roi_join(df, asked, strategy="broadcast")
    assert roi_join(df, asked).count() == 3
    assert roi_assemble(df, asked).count() == 3


def test_plan_has_no_pairwise_join_and_broadcast_keeps_tiles_in_place(spark, monkeypatch):
    monkeypatch.setattr(boxjoin, "BROADCAST_CELLS", 1 << 40)
    df, asked = frame(spark, mixed_tiles(3)), requests(spark, mixed_boxes(4))
    for strategy in ("broadcast", "shuffle"):
        plan = roi_join(df, asked, strategy=strategy)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        if strategy == "broadcast":
            assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("operator", [roi_join, roi_assemble, roi_blur])
def test_rows_spread_over_cells_are_never_sent_out_whole(spark, operator):
    df, asked = frame(spark, cut_volume(np.zeros((4, 4, 4)), (2, 2, 2))), requests(spark, [(1, 1, 1, 2, 2, 2)] * 5)
    got = operator(df, asked, strategy="shuffle")
    assert got.count() == (40 if operator is roi_join else 5)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_first_tile_takes_z_then_y_then_x(spark):
    rows = cut_volume(np.zeros((4, 4, 4)), (2, 2, 2))
    pairs = roi_join(frame(spark, rows), requests(spark, [(1, 1, 1, 2, 2, 2), (2, 0, 2, 2, 4, 2)]))
    got = {r["req_id"]: (r["x"], r["y"], r["z"]) for r in first_tile(pairs).collect()}
    assert got == {0: (0, 0, 0), 1: (2, 0, 2)}


@pytest.mark.parametrize("strategy,hot", [("broadcast", 1000), ("shuffle", 1000), ("shuffle", 1)])
@pytest.mark.parametrize("chunk", [1 << 26, 40, 3])
def test_assembly_equals_brute_force(spark, monkeypatch, strategy, hot, chunk):
    monkeypatch.setattr(boxjoin, "HOT_KEYS", 1 << 40)
    volume = RNG.integers(1, 256, (7, 8, 9), dtype=np.uint8)
    rows = cut_volume(volume, (4, 4, 4), origin=(-4, 0, 2))[:-2]
    # a second tile over the first, and plain copies
    rows += [tile(RNG.integers(0, 256, (3, 3, 3)), (-3, 1, 3))] + rows[:2]
    boxes = [(-4, 0, 2, 9, 8, 7), (-6, -1, 0, 5, 4, 6), (0, 0, 0, 1, 1, 1), (90, 90, 90, 2, 3, 2), (-2, 2, 3, 4, 4, 4)]
    df = frame(spark, rows)
    known = {k[1:]: v for k, v in voxels_of(df.collect()).items()}
    got: dict[int, dict] = {}
    for row in roi_assemble(df, requests(spark, boxes), strategy, chunk, hot).collect():
        assert row["x_dim"] * row["y_dim"] * row["z_dim"] <= chunk
        part = got.setdefault(row["req_id"], {})
        for (iz, iy, ix), v in np.ndenumerate(stack_of(row)):
            key = (row["x"] + ix, row["y"] + iy, row["z"] + iz)
            assert key not in part
            part[key] = int(v)
    for i, (x, y, z, w, h, d) in enumerate(boxes):
        places = [(a, b, c) for a in range(x, x + w) for b in range(y, y + h) for c in range(z, z + d)]
        assert got[i] == {p: known.get(p, 0) for p in places}


def test_request_lines(spark):
    lines = ["1,1,640,384,-64,256,256,128", " 2,1, -5,0,0,1,1,1", "1,1,2", "a,1,1,1,1,1,1,1", "1,1,1,1,1,1,1,99999999999", ""]
    got = parse_requests(spark.createDataFrame([(v,) for v in lines], "value string")).collect()
    assert [r["valid"] for r in got] == [True, True, False, False, False, False]
    assert (got[0]["z"], got[0]["depth"], got[1]["x"]) == (-64, 128, -5)


def test_copies_round_trip(spark):
    rows = [(i % 3, "a") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, s string")
    counted = collapse_copies(df, portion=7)
    assert max(r["_copies"] for r in counted.collect()) <= 7
    assert sorted(map(tuple, restore_copies(counted).collect())) == sorted(rows)


def test_bounds_reach_every_tile_with_and_without_broadcast(spark, monkeypatch):
    rows = cut_volume(np.zeros((4, 6, 8)), (4, 3, 2), origin=(-3, 5, 0))
    first = sorted(map(tuple, seamless.with_bounds(frame(spark, rows).drop("pixels")).collect()))
    monkeypatch.setattr(seamless, "BROADCAST_IMAGES", 0)
    again = seamless.with_bounds(frame(spark, rows).drop("pixels"))
    assert sorted(map(tuple, again.select(*seamless.with_bounds(frame(spark, rows).drop("pixels")).columns).collect())) == first
    assert {(r["x_lo"], r["y_hi"]) for r in again.collect()} == {(-3, 11)}


@pytest.mark.parametrize("chunk", [1 << 26, 64, 7])
def test_blur_of_a_box_does_not_depend_on_its_blocks(spark, chunk):
    volume = RNG.integers(0, 256, (9, 10, 11), dtype=np.uint8)
    boxes = [(0, 0, 0, 11, 10, 9), (2, 1, 3, 7, 7, 5), (-2, 4, 0, 6, 3, 9)]
    sigmas = (1.0, 0.9, 1.3)
    got = {}
    for row in roi_blur(frame(spark, cut_volume(volume, (4, 4, 4))), requests(spark, boxes), *sigmas, chunk_voxels=chunk).collect():
        assert row["x_dim"] * row["y_dim"] * row["z_dim"] <= chunk
        for (iz, iy, ix), v in np.ndenumerate(stack_of(row)):
            key = (row["req_id"], row["x"] + ix, row["y"] + iy, row["z"] + iz)
            assert key not in got
            got[key] = int(v)
    want = {}
    for i, (x, y, z, w, h, d) in enumerate(boxes):
        inside = lambda a, b, c: 0 <= a < 11 and 0 <= b < 10 and 0 <= c < 9
        box = {(a, b, c): int(volume[c, b, a]) if inside(a, b, c) else 0 for a in range(x, x + w) for b in range(y, y + h) for c in range(z, z + d)}
        want |= {(i, *place): v for place, v in slow_blur(box, sigmas).items()}
    assert got == want


def test_equal_lines_are_requests_of_their_own(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("1,1,0,0,0,2,2,2\nno request\n1,1,0,0,0,2,2,2\n")
    asked = read_requests(spark, str(tmp_path / "lines.txt"))
    df = frame(spark, cut_volume(np.ones((4, 4, 4)), (4, 4, 4)))
    assert roi_assemble(df, asked).count() == first_tile(roi_join(df, asked)).count() == 2
    with pytest.raises(ValueError, match="1 lines"):
        read_requests(spark, str(tmp_path / "lines.txt"), on_error="fail")


def test_default_cell_is_bounded_for_tiles_of_any_shape(spark):
    assert seamless._cell_for([4, 4, 4]) == (64, 64, 64) and seamless._cell_for([128, 128, 64]) == (128, 128, 64)
    assert np.prod(seamless._cell_for([2000, 2000, 2000])) <= seamless.CELL_VOXELS


def test_payloads_of_few_requests_are_read_in_place_and_pruned(spark, tmp_path):
    from voxelloom.sources import tables

    volume = RNG.integers(0, 256, (8, 8, 8), dtype=np.uint8)
    for image in (1, 2, 3):
        tables.append_pix(tables.as_pix(frame(spark, cut_volume(volume, (4, 4, 4))), image), str(tmp_path / "pix"))
    out = roi_assemble(tables.read_pix(spark, str(tmp_path / "pix")), requests(spark, [(5, 5, 5, 2, 2, 2)], image_id=2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "pixels" in line]
    assert scans and all("image_id" in line.split("PartitionFilters")[1] and "GreaterThanOrEqual(x,4)" in line for line in scans)
    before_python = plan[plan.index("_cut_wanted" if "_cut_wanted" in plan else "MapInArrow") :]
    assert "Generate explode(sequence" not in before_python.split("FileScan")[0]
    assert (stack_of(out.first()) == volume[5:7, 5:7, 5:7]).all()


def test_many_small_pieces_are_held_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from voxelloom.operators.blocks import PieceBuffer

    names = ["req_id", *[f"c{n}" for n in range(20)]]
    schema = pa.schema([*[(c, pa.int64()) for c in names], ("pixels", pa.binary())])
    first = PieceBuffer(schema)  # loads what Arrow loads once
    assert not list(first.add((0, *range(20)), np.zeros((2, 3, 4), np.uint8)))
    assert [batch.to_pylist()[0]["pixels"] for batch in first.flush()] == [bytes(24)]
    buffer, held, out = PieceBuffer(schema, held_bytes=8 << 20), 0, []
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        for n in range(40_000):
            # the second copy of a piece merges with the first while that is held
            for value in (n % 250, 1 + n % 250):
                for batch in buffer.add((n, *range(300, 320)), np.full((2, 3, 4), value, np.uint8)):
                    out += zip(batch.column("req_id").to_pylist(), batch.column("pixels").to_pylist())
            held = max(held, len(buffer.pieces))
            if n == 7_000:
                most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert most <= 8 << 20 and held <= 8 << 10
    for batch in buffer.flush():
        out += zip(batch.column("req_id").to_pylist(), batch.column("pixels").to_pylist())
    assert {n for n, _ in out} == set(range(40_000))
    assert all(max(v for k, v in out if k == n) == bytes([1 + n % 250] * 24) for n in (0, 9_999, 39_999))
