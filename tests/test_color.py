import colorsys

import numpy as np
import pytest

from helpers import cut_volume
from voxelloom.operators import color
from voxelloom.plans import jobs
from voxelloom.schema import TILE_META, TILES
from voxelloom.sources import images, sequence

RNG = np.random.default_rng(31)


def plain(channels, wanted):
    """Hue and saturation of a (blue, green, red) voxel with another brightness, in floating point."""
    blue, green, red = (c / 255 for c in channels)
    hue, saturation, _ = colorsys.rgb_to_hsv(red, green, blue)
    red, green, blue = colorsys.hsv_to_rgb(hue, saturation, wanted / 255)
    return [255 * c for c in (blue, green, red)]


@pytest.fixture
def colors():
    """(z, y, x, channel) of 2x2x2 tiles."""
    made = RNG.integers(0, 256, (4, 4, 4, 3), dtype=np.uint8)
    made[0, 0, 0], made[0, 0, 1], made[0, 0, 2] = (0, 0, 0), (255, 255, 255), (9, 0, 0)
    return made


def tiles_of(spark, colors):
    """Tiles whose grey payload is not their brightness, and one without colour."""
    cut = [cut_volume(colors[..., c], (2, 2, 2)) for c in range(3)]
    payloads = [np.stack([np.frombuffer(bytes(x[-1]), np.uint8) for x in same], axis=-1) for same in zip(*cut)]
    rows = [(*row[:-1], bytearray(8), bytearray(p.tobytes())) for row, p in zip(cut[0], payloads)]
    rows.append((1, "grey", 1, 90, 0, 0, 2, 2, 2, bytearray(range(8)), None))
    schema = TILES.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", color binary"
    return spark.createDataFrame(rows, schema).repartition(3)


def test_hue_and_saturation_stay(spark, colors):
    tiles = tiles_of(spark, colors)
    for name in ("invert", "gaussian"):
        bright = {r["x"] + 4 * r["y"] + 16 * r["z"]: bytes(r["color"] or b"") for r in tiles.collect()}
        for row in color.filter_color(tiles, name).collect():
            if row["color"] is None:
                assert row["name"] == "grey" and (name != "invert" or bytes(row["pixels"]) == bytes(range(255, 247, -1)))
                continue
            old = np.frombuffer(bright[row["x"] + 4 * row["y"] + 16 * row["z"]], np.uint8).reshape(-1, 3)
            for before, wanted, after in zip(old.tolist(), bytes(row["pixels"]), np.frombuffer(bytes(row["color"]), np.uint8).reshape(-1, 3).tolist()):
                assert max(after) == wanted
                want = plain(before, wanted) if max(before) else [wanted] * 3
                assert all(abs(a - b) <= 0.5 + 1e-6 for a, b in zip(after, want))
                if name == "invert":
                    assert wanted == 255 - max(before)


def test_the_same_brightness_changes_nothing(spark, colors):
    tiles = tiles_of(spark, colors)
    back = color.write_back(color.with_brightness(tiles))
    own = lambda df: sorted((r["x"], r["y"], r["z"], r["color"]) for r in df.collect())
    assert own(back) == own(tiles)


def test_no_shuffle_and_no_empty_trouble(spark, colors):
    tiles = tiles_of(spark, colors)
    plan = color.filter_color(tiles.coalesce(1), "invert")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # that of the test's own repartition
    assert color.filter_color(tiles.limit(0), "invert").count() == 0
    assert color.channel(tiles, "red").columns == [*TILE_META, "pixels"]
    wrong = tiles.where("color is not null").selectExpr(*TILES.fieldNames(), "substr(color, 1, 3) as color")
    with pytest.raises(Exception, match="do not fit"):
        color.write_back(wrong).collect()


def test_a_filter_over_colours_needs_one_worker(spark, colors):
    plan = color.filter_color(tiles_of(spark, colors), "gaussian")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_colour_images_through_files(spark, tmp_path, colors):
    """PNG in colour, PNG in grey, filtered twice by the inverse; hue may round, the brightness comes back."""
    source, once, twice = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    source.mkdir()
    (source / "0-4_0-4_0-4.jpg").write_bytes(images.encode_color_png(colors.reshape(16, 4, 3)))
    (source / "8-12_0-4_0-1.jpg").write_bytes(images.encode_png(colors[0, :, :, 0]))
    (source / "8-12_0-4_5-6.jpg").write_bytes(b"broken")
    kept = {r["name"]: r for r in images.read_tiles(spark, str(source), color="keep").collect()}
    assert bytes(kept["0-4_0-4_0-4"]["color"]) == colors.tobytes() and bytes(kept["0-4_0-4_0-4"]["pixels"]) == colors.max(axis=3).tobytes()
    assert kept["8-12_0-4_0-1"]["color"] is None
    for start, end in ((source, once), (once, twice)):
        jobs.filter_color_images(spark, str(start), str(end), "invert")
        for file in end.iterdir():
            file.rename(file.with_suffix(".jpg"))
    again = {r["name"]: r for r in images.read_tiles(spark, str(twice), color="keep").collect()}
    assert set(again) == set(kept) and all(again[n]["pixels"] == kept[n]["pixels"] for n in kept)
    assert again["8-12_0-4_0-1"]["color"] is None
    found = jobs.filter_to_sequence(spark, str(source), str(tmp_path / "seq"), "invert", color="keep")
    assert (found["read"], found["kept"], found["decode"]) == (3, 2, 1)
    stored = {r["path"]: bytes(r["content"]) for r in sequence.read_sequence(spark, str(tmp_path / "seq")).collect()}
    assert stored == {f.stem: f.read_bytes() for f in once.iterdir()}
