import os

import numpy as np
import pytest

from helpers import cut_volume, frame, stack_of, tile
from voxelloom.operators.gauss import gauss3d_tile
from voxelloom.plans import jobs
from voxelloom.schema import TILES
from voxelloom.sources import images, sequence, tables
from voxelloom.streaming.arrivals import arriving_tiles, filter_arrivals

RNG = np.random.default_rng(2)


@pytest.fixture
def volume():
    return RNG.integers(0, 256, (6, 8, 8), dtype=np.uint8)


@pytest.fixture
def folder(tmp_path, volume):
    """Eight tiles as lossless grey images under tile names, and three files that cannot be used."""
    source = tmp_path / "images"
    source.mkdir()
    for row in cut_volume(volume, (4, 4, 3)):
        strip = np.frombuffer(bytes(row[-1]), np.uint8).reshape(-1, row[6])
        (source / f"{row[1]}.jpg").write_bytes(images.encode_png(strip))
    (source / "0-4_0-4_90-93.jpg").write_bytes(b"not an image")
    (source / "holiday.jpg").write_bytes(images.encode_png(np.zeros((4, 4), np.uint8)))
    (source / "0-4_0-4_80-83.jpg").write_bytes(images.encode_png(np.zeros((5, 4), np.uint8)))
    return source


def content(rows):
    return {(r["x"], r["y"], r["z"]): bytes(r["pixels"]) for r in rows}


def expected(volume):
    return {t[3:6]: bytes(t[-1]) for t in cut_volume(volume, (4, 4, 3))}


def jpeg(spark, path, array, kind=10):
    """Write an image through the JVM's own encoder; kind 10 is grey, 5 is blue-green-red."""
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(array.shape[1], array.shape[0], kind)
    for (r, c), v in np.ndenumerate(array):
        if kind == 10:
            picture.getRaster().setSample(int(c), int(r), 0, int(v))
        else:
            picture.setRGB(int(c), int(r), int(v))
    jvm.javax.imageio.ImageIO.write(picture, "png" if kind == 5 else "jpg", jvm.java.io.File(str(path)))


def test_decode_and_flag_bad_files(spark, folder, volume):
    good = images.read_tiles(spark, str(folder), image_id=7)
    assert good.schema.names == TILES.names
    assert content(good.collect()) == expected(volume)
    problems = {r["name"]: r["problem"] for r in images.decode_tiles(images.read_images(spark, str(folder))).where("problem is not null").collect()}
    assert problems == {"0-4_0-4_90-93": "decode", "holiday": "name", "0-4_0-4_80-83": "shape"}
    with pytest.raises(Exception, match="unusable image"):
        images.read_tiles(spark, str(folder), on_error="fail").collect()


def test_a_real_jpeg_and_a_colour_image(spark, tmp_path):
    grey = tmp_path / "g"
    grey.mkdir()
    jpeg(spark, grey / "0-16_0-16_0-2.jpg", np.full((32, 16), 100))
    row = images.read_tiles(spark, str(grey), on_error="fail").first()
    assert (stack_of(row) == 100).all()
    jpeg(spark, grey / "0-2_0-1_0-1.jpg", np.array([[0xFF0A05, 0x0102C8]]), kind=5)
    assert images.read_tiles(spark, str(grey)).count() == 1
    bright = images.read_tiles(spark, str(grey), color="brightness").where("x_dim = 2").first()
    assert bytes(bright["pixels"]) == bytes([255, 200])
    raw = spark.read.format("image").load(str(grey)).where("image.width = 2").select("image.*")
    weighted = raw.select(images.brightness((0.299, 0.587, 0.114))("data", "nChannels").alias("g")).first()["g"]
    assert list(weighted) == [round(0.299 * 255 + 0.587 * 10 + 0.114 * 5), round(0.299 * 1 + 0.587 * 2 + 0.114 * 200)]


def test_files_and_path_lists(spark, folder, tmp_path):
    assert images.read_files(spark, str(folder)).count() == 11
    wanted = ["0-4_0-4_0-3.jpg", f"{folder}/4-8_0-4_0-3.jpg", "missing.jpg", ""]
    (tmp_path / "list.txt").write_text("\n".join(wanted))
    got = images.in_path_list(images.read_files(spark, str(folder)), str(tmp_path / "list.txt")).collect()
    assert sorted(os.path.basename(r["path"]) for r in got) == ["0-4_0-4_0-3.jpg", "4-8_0-4_0-3.jpg"]
    (tmp_path / "short.txt").write_text(f"{folder}/4-8_0-4_0-3.jpg\n")
    assert images.read_path_list(spark, str(tmp_path / "short.txt")).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        images.read_path_list(spark, str(tmp_path / "list.txt"))
    jobs.images_to_sequence(spark, str(tmp_path / "list.txt"), str(folder), str(tmp_path / "seq"))
    assert sorted(r["name"] for r in sequence.read_tiles(spark, str(tmp_path / "seq")).collect()) == ["0-4_0-4_0-3", "4-8_0-4_0-3"]


def test_ingest_refuses_an_existing_target(spark, folder, tmp_path, volume):
    target = str(tmp_path / "tiles")
    images.ingest(spark, str(folder), target)
    assert content(spark.read.parquet(target).collect()) == expected(volume)
    with pytest.raises(Exception, match="already exists"):
        images.ingest(spark, str(folder), target)


@pytest.mark.parametrize("kind", ["png", "pgm"])
def test_export_is_lossless(spark, tmp_path, volume, kind):
    out = tmp_path / "out"
    df = frame(spark, cut_volume(volume, (4, 4, 3)))
    images.export_tiles(df, str(out), kind)
    images.export_tiles(df, f"file://{out}", kind)
    assert len(list(out.iterdir())) == 8
    if kind == "png":
        for file in out.iterdir():
            file.rename(file.with_suffix(".jpg"))
        assert content(images.read_tiles(spark, str(out)).collect()) == expected(volume)
    else:
        data = (out / "0-4_0-4_0-3.pgm").read_bytes()
        assert data.startswith(b"P5\n4 12\n255\n") and data.endswith(expected(volume)[0, 0, 0])


def test_sequence_files_round_trip(spark, tmp_path, volume):
    path = str(tmp_path / "seq")
    df = frame(spark, cut_volume(volume, (4, 4, 3)))
    sequence.write_sequence(df, path)
    assert content(sequence.read_tiles(spark, path).collect()) == expected(volume)
    with pytest.raises(Exception, match="already exists"):
        sequence.write_sequence(df, path)


def test_pix_appends_prunes_and_replaces(spark, tmp_path, volume):
    path = str(tmp_path / "pix")
    df = frame(spark, cut_volume(volume, (4, 4, 3)))
    for image in (1, 2):
        tables.append_pix(tables.as_pix(df, image), path)
    tables.append_pix(tables.as_pix(df, 1), path)
    pix = tables.read_pix(spark, path)
    assert pix.count() == 24 and pix.where("image_id = 2").count() == 8
    plan = pix.where("image_id = 2 and zoom_out = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(image_id" in plan
    tables.replace_volumes(tables.as_pix(df.limit(3), 1), path)
    assert {r["image_id"]: r["count"] for r in tables.read_pix(spark, path).groupBy("image_id").count().collect()} == {1: 3, 2: 8}


def test_append_once_can_be_repeated(spark, tmp_path, volume):
    path = str(tmp_path / "pix")
    df = tables.as_pix(frame(spark, cut_volume(volume, (4, 4, 3))), 1)
    for _ in range(2):
        tables.append_pix_once(df.unionByName(df), path)
    assert content(tables.read_pix(spark, path).collect()) == expected(volume)
    assert tables.read_pix(spark, path).count() == 8


def test_filter_job_into_the_tile_table(spark, folder, tmp_path, volume):
    pix, registry = str(tmp_path / "pix"), str(tmp_path / "registry")
    jobs.filter_to_pix(
        spark, str(folder), pix, "gaussian", {"sigma_x": "1.0", "sigma_y": "0.9", "sigma_z": "1.0"},
        image_id=5, image_name="cortex", images_target=registry, partitions=3,
    )
    direct = gauss3d_tile(frame(spark, cut_volume(volume, (4, 4, 3))), 1.0, 0.9, 1.0).collect()
    stored = tables.read_pix(spark, pix).collect()
    assert content(stored) == content(direct)
    assert {(r["image_id"], r["zoom_out"]) for r in stored} == {(5, 1)}
    assert [tuple(r) for r in spark.read.parquet(registry).collect()] == [(5, "cortex")]


@pytest.mark.parametrize("encoded", [True, False])
def test_filter_job_into_sequence_files_and_export(spark, folder, tmp_path, volume, encoded):
    target, out = str(tmp_path / "seq"), tmp_path / "out"
    jobs.filter_to_sequence(spark, str(folder), target, "invert", encoded=encoded)
    jobs.export_sequence(spark, target, str(out), encoded)
    for file in out.iterdir():
        file.rename(file.with_suffix(".jpg"))
    assert content(images.read_tiles(spark, str(out)).collect()) == expected(255 - volume)


def test_filter_sequence_job(spark, tmp_path, volume):
    sequence.write_sequence(frame(spark, cut_volume(volume, (4, 4, 3))), str(tmp_path / "a"))
    jobs.filter_sequence(spark, str(tmp_path / "a"), str(tmp_path / "b"), "threshold", {"method": "Otsu"})
    got = sequence.read_tiles(spark, str(tmp_path / "b")).collect()
    assert len(got) == 8 and {v for r in got for v in bytes(r["pixels"])} <= {0, 255}


def test_request_jobs(spark, tmp_path, volume):
    pix, out, lines = str(tmp_path / "pix"), str(tmp_path / "out"), tmp_path / "requests.txt"
    tables.append_pix(frame(spark, cut_volume(volume, (4, 4, 3))), pix)
    lines.write_text("1,1,2,2,1,5,5,4\n1,1,0,0,0,8,8,6\nbroken\n")
    jobs.filter_requests(spark, str(lines), pix, out, sigmas=(0.0, 0.0, 0.0))
    got = {(r["x"], r["x_dim"]): stack_of(r) for r in tables.read_pix(spark, out).collect()}
    assert (got[2, 5] == volume[1:5, 2:7, 2:7]).all() and (got[0, 8] == volume).all()
    pairs, counts = jobs.match_requests(spark, str(lines), pix)
    assert pairs.count() == 16 and [tuple(r) for r in counts.collect()] == [(1, 2)]


def test_arriving_files_are_filtered_once(spark, tmp_path, folder, volume):
    source, pix, state = tmp_path / "in", str(tmp_path / "pix"), str(tmp_path / "state")
    source.mkdir()
    files = sorted(folder.iterdir())
    for part in (files[:5], files[3:]):
        for file in part:
            (source / file.name).write_bytes(file.read_bytes())
        arriving = arriving_tiles(spark, str(source), image_id=3, files_per_trigger=2)
        filter_arrivals(arriving, pix, state, "invert").awaitTermination(120)
    stored = tables.read_pix(spark, pix).collect()
    assert content(stored) == expected(255 - volume)
    assert len(stored) == 8 and {r["image_id"] for r in stored} == {3}


def test_single_slice_and_single_voxel_tiles(spark, tmp_path):
    rows = [tile(np.full((1, 1, 1), 9)), tile(np.arange(12).reshape(1, 3, 4), (5, 5, 5))]
    sequence.write_sequence(frame(spark, rows), str(tmp_path / "s"))
    assert sequence.read_tiles(spark, str(tmp_path / "s")).count() == 2


def test_path_lines_match_whole_components(spark, tmp_path):
    files = spark.createDataFrame([(f"file:/v/{p}/1-5_0-4_0-1.jpg",) for p in ("b", "bb", "a/b", "c")], "path string")
    pick = lambda *lines: sorted(r["path"] for r in images.matching_paths(files, spark.createDataFrame([(x,) for x in lines], "line string")).collect())
    name = "1-5_0-4_0-1.jpg"
    assert pick(f"b/{name}") == [f"file:/v/a/b/{name}", f"file:/v/b/{name}"]
    assert pick(f"/v/b/{name}", f"file:/v/c/{name}", f"/b/{name}") == [f"file:/v/b/{name}", f"file:/v/c/{name}"]
    assert pick("5_0-4_0-1.jpg") == []


@pytest.mark.parametrize("sink", ["pix", "sequence"])
def test_listed_images_are_filtered_and_no_others_are_read(spark, folder, tmp_path, volume, sink):
    (tmp_path / "list.txt").write_text("0-4_0-4_0-3.jpg\n4-8_0-4_0-3.jpg\n")
    target = str(tmp_path / "out")
    more = {"encoded": False} if sink == "sequence" else {}
    # the folder holds broken files: reading one would stop the job
    jobs.filter_listed(spark, str(tmp_path / "list.txt"), target, "invert", folder=str(folder), sink=sink, on_error="fail", **more)
    stored = tables.read_pix(spark, target) if sink == "pix" else sequence.read_tiles(spark, target)
    want = {k: v for k, v in expected(255 - volume).items() if k in ((0, 0, 0), (4, 0, 0))}
    assert content(stored.collect()) == want
    with pytest.raises(Exception, match="unusable image"):
        jobs.filter_to_pix(spark, str(folder), str(tmp_path / "x"), "invert", on_error="fail")


def test_long_path_lists_are_read_in_groups(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "LISTED_PATHS", 3)
    (tmp_path / "list.txt").write_text("\n".join(str(f) for f in sorted(folder.iterdir())))
    assert images.read_path_list(spark, str(tmp_path / "list.txt")).count() == 11


def test_colour_mode_skips_a_corrupt_image(spark, folder):
    problems = images.decode_tiles(images.read_images(spark, str(folder)), color="brightness").where("problem is not null")
    assert {r["problem"] for r in problems.collect()} == {"decode", "name", "shape"}


def test_export_refuses_to_overwrite_and_parts_images(spark, tmp_path, volume):
    rows = [tile(volume[:3], image_id=i, zoom_out=z) for i in (1, 2) for z in (1, 2)]
    df = frame(spark, rows)
    with pytest.raises(ValueError, match="4 rows"):
        images.export_tiles(df, str(tmp_path / "flat"))
    images.export_tiles(df, str(tmp_path / "parted"), by_image=True)
    assert len(list((tmp_path / "parted").glob("image-*/zoom-*/0-8_0-8_0-3.png"))) == 4


def test_bad_sequence_records_are_named(spark, tmp_path):
    rows = spark.createDataFrame([("0-1_0-1_0-2", b"ab"), ("0-1_0-1_0-3", b"ab"), ("x", b"")], "name string, pixels binary")
    sequence.write_sequence(rows, str(tmp_path / "s"))
    found = sequence.decode_records(sequence.read_sequence(spark, str(tmp_path / "s"))).collect()
    assert {r["name"]: r["problem"] for r in found} == {"0-1_0-1_0-2": None, "0-1_0-1_0-3": "shape", "x": "name"}
    assert sequence.read_tiles(spark, str(tmp_path / "s")).count() == 1
    with pytest.raises(Exception, match="unusable"):
        sequence.read_tiles(spark, str(tmp_path / "s"), on_error="fail").collect()


def test_request_job_keeps_identity(spark, tmp_path, volume):
    pix, out, lines = str(tmp_path / "pix"), str(tmp_path / "out"), tmp_path / "requests.txt"
    tables.append_pix(frame(spark, cut_volume(volume, (4, 4, 3))), pix)
    lines.write_text("1,1,2,2,1,5,5,4\n")
    jobs.filter_requests(spark, str(lines), pix, out)
    jobs.filter_requests(spark, str(lines), pix, out, image_id=9, name="cut")
    assert {(r["image_id"], r["name"]) for r in tables.read_pix(spark, out).collect()} == {(1, "2-7_2-7_1-5"), (9, "cut")}
