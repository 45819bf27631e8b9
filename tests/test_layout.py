import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import cut_volume, frame, stack_of, tile, voxels_of
from voxelloom.functions.names import box_of_name, name_of_box, parse_names
from voxelloom.operators import counting, layout, ordering
from voxelloom.operators.filters import Filter, apply_filter, register_filter
from voxelloom.operators.registration import phase_shift, register_pairs
from voxelloom.plans import queries as catalogue

RNG = np.random.default_rng(1)


@pytest.mark.parametrize(
    "name,box",
    [
        ("256-384_896-1024_0-64", (256, 896, 0, 128, 128, 64)),
        ("-128-0_2176-2304_-64--32", (-128, 2176, -64, 128, 128, 32)),
        ("0-1_0-1_0-0", None),
        ("5-4_0-1_0-1", None),
        ("0-1_0-1", None),
        ("a0-1_0-1_0-1", None),
        ("0-1_0-1_0-1_", None),
        ("0-99999999999_0-1_0-1", None),
        ("-2147483648-2147483647_0-1_0-1", None),
        ("", None),
    ],
)
def test_names(spark, name, box):
    got = spark.createDataFrame([(name,)], "n string").select(box_of_name(F.col("n")).alias("b")).first()["b"]
    assert (tuple(got) if got else None) == box


def test_paths(spark):
    rows = [("hdfs://a/b-1/0-4_0-4_0-2.jpg",), ("0-4_0-4_0-2",), ("/x/photo.jpg",), ("/x/0-4_0-4_0-2xjpg",)]
    got = parse_names(spark.createDataFrame(rows, "path string")).collect()
    assert [r["name"] for r in got] == ["0-4_0-4_0-2", "0-4_0-4_0-2", "photo", "0-4_0-4_0-2xjpg"]
    assert [r["valid"] for r in got] == [True, True, False, False]


def test_name_round_trip(spark):
    boxes = [(-5, 0, 7, 3, 1, 9), (2147483000, 0, 0, 600, 1, 1)]
    df = spark.createDataFrame(boxes, "x int, y int, z int, x_dim int, y_dim int, z_dim int")
    back = df.select(box_of_name(name_of_box()).alias("b")).collect()
    assert [tuple(r["b"]) for r in back] == boxes


def test_slices_last_slice_and_sizes(spark):
    stack = RNG.integers(0, 256, (3, 2, 4), dtype=np.uint8)
    df = frame(spark, [tile(stack, (0, 0, -7))])
    got = {r["z"]: bytes(r["pixels"]) for r in layout.tile_slices(df).collect()}
    assert got == {z - 7: stack[z].tobytes() for z in range(3)}
    top = layout.last_slice(df).first()
    assert (top["z"], bytes(top["pixels"])) == (-5, stack[2].tobytes())
    assert layout.tile_sizes(df).first()["n_bytes"] == 24


def test_explode_and_flatten_are_inverse(spark):
    volume = RNG.integers(0, 256, (6, 4, 8), dtype=np.uint8)
    df = frame(spark, cut_volume(volume, (4, 2, 3), origin=(-8, 0, 3)))
    voxels = layout.voxel_explode(df)
    assert {(r.image_id, r.x, r.y, r.z): r.v for r in voxels.collect()} == voxels_of(df.collect())
    back = layout.tiles_from_voxels(voxels.unionByName(voxels), (4, 2, 3)).collect()
    assert {(r["x"], r["y"], r["z"]): bytes(r["pixels"]) for r in back} == {
        (r["x"], r["y"], r["z"]): bytes(r["pixels"]) for r in df.collect()
    }


def test_a_large_tile_is_exploded_in_bounded_batches(spark, monkeypatch):
    stack = RNG.integers(0, 256, (9, 40, 50), dtype=np.uint8)
    sizes = [b.num_rows for b in layout._voxel_batches([_arrow(tile(stack))], ["image_id", "x", "y", "z", "v"])]
    assert sum(sizes) == stack.size
    monkeypatch.setattr(layout, "VOXEL_ROWS", 4000)
    sizes = [b.num_rows for b in layout._voxel_batches([_arrow(tile(stack))], ["image_id", "x", "y", "z", "v"])]
    assert sum(sizes) == stack.size and max(sizes) <= 4000


def _arrow(row):
    import pyarrow as pa

    from voxelloom.schema import TILES

    types = [pa.string() if f.name == "name" else pa.binary() if f.name == "pixels" else pa.int32() for f in TILES]
    return pa.RecordBatch.from_arrays(
        [pa.array([bytes(v) if isinstance(v, bytearray) else v], t) for v, t in zip(row, types)], names=TILES.fieldNames()
    )


def test_strip_csv_and_flip(spark):
    stack = np.array([[[1, 2], [3, 200]], [[5, 6], [7, 255]]])
    df = frame(spark, [tile(stack, (10, 20, 30))])
    strip = {(r["row"], r["col"]): r["v"] for r in layout.strip_layout(df).collect()}
    assert strip == {(i, j): int(v) for (i, j), v in np.ndenumerate(stack.reshape(4, 2))}
    assert layout.pixels_csv(df).first()["csv"] == "1,2,3,200,5,6,7,255"
    for h, v in ((True, False), (False, True), (True, True)):
        expect = stack[:, :: -1 if v else 1, :: -1 if h else 1]
        assert (stack_of(layout.flip(df, h, v).first()) == expect).all()


def test_tiles_of_many_shapes_share_a_batch(spark):
    rows = [tile(RNG.integers(0, 256, (1 + i % 3, 2, 1 + i % 4)), (10 * i, 0, 0)) for i in range(40)]
    df = frame(spark, rows).coalesce(1)
    out = {r["name"]: stack_of(r) for r in apply_filter(df, "invert").collect()}
    for row in df.collect():
        assert (out[row["name"]] == 255 - stack_of(row)).all()


MAP_ONLY = [n for n in catalogue.queries() if n.startswith(("threshold_", "bandpass", "gauss"))]
MAP_ONLY = [n for n in MAP_ONLY if n not in ("threshold_levels", "gauss3d_seamless", "bandpass_filter_grid")]


@pytest.mark.parametrize("name", [*MAP_ONLY, "voxel_explode", "tile_slices", "slice_flip", "contrast_stretch", "plugin_filter"])
def test_tile_local_work_has_no_shuffle(spark, small, name):
    plan = catalogue.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_metadata_queries_do_not_read_payloads(spark, small):
    for name in ("tile_extents", "roi_join", "pix_append"):
        plan = catalogue.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "embedding:" not in plan


def test_rank_counts_copies_and_orders_by_z_y_x(spark):
    rows = cut_volume(np.zeros((4, 4, 4)), (2, 2, 2), origin=(-2, 0, 0)) + [tile(np.zeros((2, 2, 2)), (-2, 0, 0))] * 7
    got = ordering.zyx_rank(frame(spark, rows)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    order = [(r["z"], r["y"], r["x"]) for r in got]
    assert order == sorted(order)


def test_names_are_ranked_bytewise(spark):
    names = ["10-12", "2-4", "-4-0", "é", "Z", "a", "2-4"]
    rows = [tile(np.zeros((1, 1, 1)), name=n) for n in names]
    got = ordering.name_rank(frame(spark, rows)).orderBy("rank").collect()
    assert [r["name"] for r in got] == sorted(names, key=lambda n: n.encode())


def test_word_count(spark, tmp_path):
    text = "abacus vmware linux ledare led abacus Linux Linux"
    df = spark.createDataFrame([(text,), ("  led\t\n",), ("",), (None,)], "text string")
    plain = {r["word"]: r["n"] for r in counting.word_count(df).collect()}
    assert plain == collections.Counter(text.split() + ["led"])
    folded = {r["word"]: r["n"] for r in counting.word_count(df, case_sensitive=False).collect()}
    assert folded["linux"] == 3 and "Linux" not in folded
    (tmp_path / "in.txt").write_text(text + "\n\nled led")
    counting.word_count_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"))
    lines = spark.read.option("sep", "\t").csv(str(tmp_path / "out")).collect()
    assert {r[0]: int(r[1]) for r in lines} == collections.Counter(text.split() + ["led", "led"])


def test_filters_by_name_have_typed_parameters(spark):
    df = frame(spark, [tile(np.arange(8).reshape(2, 2, 2))])
    register_filter("add", lambda s, by, twice: s + np.uint8(by * (2 if twice else 1)), {"by": "int", "twice": "boolean"}, {"twice": False}, "slice")
    assert stack_of(apply_filter(df, "add", {"by": "3", "twice": "TRUE"}).first()).min() == 6
    assert stack_of(apply_filter(df, "add", {"by": 3}).first()).min() == 3
    for wrong in ({}, {"by": "x"}, {"by": "1", "twice": "maybe"}, {"by": "1", "other": "1"}):
        with pytest.raises(ValueError):
            apply_filter(df, "add", wrong)
    with pytest.raises(ValueError, match="no filter"):
        apply_filter(df, "missing")
    with pytest.raises(Exception, match="filter returned"):
        apply_filter(df, Filter("bad", lambda s: s.astype(float))).collect()


def test_slice_filters_see_single_slices(spark):
    df = frame(spark, [tile(RNG.integers(0, 256, (3, 4, 5)))])
    flip = Filter("reverse", lambda s: s[:, ::-1], granularity="slice")
    assert (stack_of(apply_filter(df, flip).first()) == stack_of(df.first())[:, ::-1]).all()


def test_registration_finds_a_known_shift(spark):
    plane = RNG.integers(0, 256, (16, 12), dtype=np.uint8)
    moved = np.roll(plane, (3, -2), (0, 1))
    assert phase_shift(plane.astype(float), moved.astype(float))[:2] == (3, -2)
    lower, upper = np.zeros((2, 16, 12), np.uint8), np.zeros((2, 16, 12), np.uint8)
    lower[1], upper[0] = plane, moved
    rows = [tile(lower, (0, 0, 0)), tile(upper, (0, 0, 2)), tile(lower, (50, 0, 0))] * 3
    found = register_pairs(frame(spark, rows)).collect()
    assert [(r["axis"], r["z"], r["shift_row"], r["shift_col"]) for r in found] == [("z", 2, 3, -2)]
