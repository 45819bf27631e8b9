"""Every job says what it read, kept and dropped."""

import numpy as np
import pytest

from helpers import cut_volume
from voxelloom.plans import jobs
from voxelloom.sources import images, sequence, tables
from voxelloom.sources.losses import PROBLEMS


@pytest.fixture
def folder(tmp_path):
    """Eight good tiles, two broken files, one without a tile name and one of a wrong shape."""
    source = tmp_path / "images"
    source.mkdir()
    for row in cut_volume(np.arange(384, dtype=np.int64).astype(np.uint8).reshape(6, 8, 8), (4, 4, 3)):
        (source / f"{row[1]}.jpg").write_bytes(images.encode_png(np.frombuffer(bytes(row[-1]), np.uint8).reshape(-1, row[6])))
    for z in (90, 91):
        (source / f"0-4_0-4_{z}-93.jpg").write_bytes(b"not an image")
    (source / "holiday.jpg").write_bytes(images.encode_png(np.zeros((4, 4), np.uint8)))
    (source / "0-4_0-4_80-83.jpg").write_bytes(images.encode_png(np.zeros((5, 4), np.uint8)))
    return source


LOSSES = {"read": 12, "kept": 8, "name": 1, "decode": 2, "color": 0, "shape": 1}


def quarantined(spark, path):
    return {(r["path"].rsplit("/", 1)[-1], r["problem"]) for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("options", [{}, {"partitions": 3}, {"once": True}])
def test_totals_add_up(spark, folder, tmp_path, options):
    pix, bad = str(tmp_path / "pix"), str(tmp_path / "bad")
    found = jobs.filter_to_pix(spark, str(folder), pix, "invert", quarantine=bad, **options)
    assert found == LOSSES
    assert found["read"] == found["kept"] + sum(found[p] for p in PROBLEMS)
    assert tables.read_pix(spark, pix).count() == found["kept"]
    names = {("0-4_0-4_90-93.jpg", "decode"), ("0-4_0-4_91-93.jpg", "decode"), ("holiday.jpg", "name"), ("0-4_0-4_80-83.jpg", "shape")}
    assert quarantined(spark, bad) == names


@pytest.mark.parametrize("encoded", [True, False])
def test_sequence_jobs_count_too(spark, folder, tmp_path, encoded):
    assert jobs.filter_to_sequence(spark, str(folder), str(tmp_path / "seq"), "invert", encoded=encoded) == LOSSES


def test_listed_jobs_count_what_is_listed(spark, folder, tmp_path):
    listing = tmp_path / "list.txt"
    listing.write_text("holiday.jpg\n0-4_0-4_0-3.jpg\n4-8_0-4_0-3.jpg\n0-4_0-4_90-93.jpg\n")
    want = {"read": 4, "kept": 2, "name": 1, "decode": 1, "color": 0, "shape": 0}
    assert jobs.images_to_sequence(spark, str(listing), str(folder), str(tmp_path / "seq"), quarantine=str(tmp_path / "bad")) == want
    assert len(quarantined(spark, str(tmp_path / "bad"))) == 2
    assert jobs.filter_listed(spark, str(listing), str(tmp_path / "pix"), "invert", folder=str(folder)) == want


@pytest.mark.parametrize("ordered", [True, False])
def test_ordered_records_are_counted_once(spark, tmp_path, ordered):
    rows = [(f"{i}-{i + 1}_0-1_0-2", b"ab") for i in range(300)] + [("0-1_0-1_0-3", b"ab"), ("x", b""), ("y", b"")]
    sequence.write_sequence(spark.createDataFrame(rows, "name string, pixels binary").repartition(5), str(tmp_path / "a"))
    found = jobs.filter_sequence(spark, str(tmp_path / "a"), str(tmp_path / "b"), "invert", ordered=ordered, quarantine=str(tmp_path / "bad"))
    assert found == {"read": 303, "kept": 300, "name": 2, "decode": 0, "color": 0, "shape": 1}
    assert quarantined(spark, str(tmp_path / "bad")) == {("0-1_0-1_0-3", "shape"), ("x", "name"), ("y", "name")}


def test_nothing_dropped_leaves_no_quarantine(spark, folder, tmp_path):
    (tmp_path / "one.txt").write_text("0-4_0-4_0-3.jpg\n")
    bad = tmp_path / "bad"
    found = jobs.filter_listed(spark, str(tmp_path / "one.txt"), str(tmp_path / "pix"), "invert", folder=str(folder), quarantine=str(bad))
    assert found == {"read": 1, "kept": 1, **dict.fromkeys(PROBLEMS, 0)} and not bad.exists()
    with pytest.raises(Exception, match="unusable image"):
        jobs.filter_to_pix(spark, str(folder), str(tmp_path / "x"), "invert", on_error="fail")
