import numpy as np
import pytest

from helpers import cut_volume, frame, stack_of
from voxelloom.operators.gauss import gauss3d_tile
from voxelloom.sources import spatial, tables
from voxelloom.sources.pixlog import PixLog
from voxelloom.streaming.arrivals import answer_arrivals

VOLUME = np.random.default_rng(3).integers(0, 256, (8, 8, 8), dtype=np.uint8)


@pytest.mark.parametrize("by_place", [False, True])
def test_files_between_triggers_are_answered_once(spark, tmp_path, by_place):
    source, pix, out, state = tmp_path / "in", str(tmp_path / "pix"), str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    tiles = frame(spark, cut_volume(VOLUME, (4, 4, 4)))
    if by_place:
        spatial.write_spatial(tiles, pix, edge=4)
    else:
        tables.append_pix(tiles, pix)
    batches = [["1,1,1,1,1,3,4,5", "no request", "1,1,0,0,0,8,8,8"], ["1,1,1,1,1,3,4,5", "1,1,6,6,6,4,4,4", "7,1,0,0,0,2,2,2"], []]
    for number, lines in enumerate(batches):
        (source / f"{number}.txt").write_text("\n".join(lines))
        answer_arrivals(spark, str(source), pix, out, state, files_per_trigger=1).awaitTermination(120)
        answer_arrivals(spark, str(source), pix, out, state, files_per_trigger=1).awaitTermination(120)
    stored = tables.read_pix(spark, out).collect()
    got = {(r["image_id"], r["x"], r["x_dim"]): stack_of(r) for r in stored}
    padded = np.pad(VOLUME, ((0, 2),) * 3)
    assert len(stored) == len(got) == 4
    assert (got[1, 1, 3] == VOLUME[1:6, 1:5, 1:4]).all() and (got[1, 0, 8] == VOLUME).all()
    assert (got[1, 6, 4] == padded[6:, 6:, 6:]).all() and not got[7, 0, 2].any()


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    source, pix, out = tmp_path / "in", str(tmp_path / "pix"), str(tmp_path / "out")
    source.mkdir()
    tables.append_pix(frame(spark, cut_volume(VOLUME, (4, 4, 4))), pix)
    (source / "a.txt").write_text("1,1,0,0,0,8,8,8\n")
    answer_arrivals(spark, str(source), pix, out, str(tmp_path / "s1"), sigmas=(1.0, 0.9, 1.0)).awaitTermination(120)
    whole = gauss3d_tile(frame(spark, cut_volume(VOLUME, (8, 8, 8))), 1.0, 0.9, 1.0).first()
    assert (stack_of(tables.read_pix(spark, out).first()) == stack_of(whole)).all()
    # another stream over the same files: its batches have names of their own, the boxes are known
    answer_arrivals(spark, str(source), pix, out, str(tmp_path / "s2"), sigmas=(1.0, 0.9, 1.0)).awaitTermination(120)
    assert tables.read_pix(spark, out).count() == 1 and len(PixLog(spark, out).committed()) == 2
