"""Blur across borders by border voxels only: results, plans and shuffled bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import as_voxels, cut_volume, frame, slow_blur, tile, voxels_of
from voxelloom.operators import borders
from voxelloom.operators.seamless import gauss3d_seamless

SIGMAS = (0.9, 0.5, 0.3)


def volume(seed, shape):
    return np.random.default_rng(seed).integers(0, 256, shape, dtype=np.uint8)


def blurred(df):
    rows = df.collect()
    assert len({(r["image_id"], r["zoom_out"], r["x"], r["y"], r["z"]) for r in rows}) == len(rows)
    for r in rows:
        assert r["name"] == f"{r['x']}-{r['x'] + r['x_dim']}_{r['y']}-{r['y'] + r['y_dim']}_{r['z']}-{r['z'] + r['z_dim']}"
    return voxels_of(rows), sum(len(r["pixels"]) for r in rows)


@pytest.mark.parametrize(("shape", "dims"), [((9, 16, 21), (7, 8, 3)), ((4, 5, 6), (6, 5, 4)), ((9, 9, 15), (7, 5, 9)), ((12, 10, 8), (8, 5, 4))])
def test_equals_plain_blur(spark, shape, dims):
    stack = volume(sum(shape), shape)
    got, voxels = blurred(borders.gauss3d_borders(frame(spark, cut_volume(stack, dims, (-5, 7, 0))), *SIGMAS))
    want = slow_blur(as_voxels(stack), SIGMAS)
    assert got == {(1, x - 5, y + 7, z): v for (x, y, z), v in want.items()}
    assert voxels == stack.size


def test_missing_tiles_and_irregular_images(spark):
    """Image 1 lacks tiles, 2 has overlapping and 3 repeated tiles, 4 leaves the lattice, 5 is thinner than the kernel; zoom 2 of image 1."""
    rows = [t for at, t in enumerate(cut_volume(volume(1, (12, 16, 16)), (8, 8, 6))) if at not in (2, 5)]
    rows += cut_volume(volume(2, (8, 8, 8)), (8, 8, 4), image_id=2) + [tile(volume(3, (4, 4, 4)), (2, 2, 2), image_id=2)]
    rows += cut_volume(volume(4, (8, 8, 8)), (8, 8, 4), image_id=3) * 2
    rows += [tile(volume(5, (8, 8, 8)), (0, 0, 0), image_id=4), tile(volume(6, (8, 8, 8)), (9, 0, 0), image_id=4)]
    rows += cut_volume(volume(7, (4, 4, 8)), (2, 4, 4), image_id=5)
    rows += cut_volume(volume(8, (8, 8, 16)), (8, 8, 8), zoom_out=2)
    df = frame(spark, rows)
    for zoom in (1, 2):
        got, _ = blurred(borders.gauss3d_borders(df, *SIGMAS).where(f"zoom_out = {zoom}"))
        assert got == voxels_of(gauss3d_seamless(df.where(f"zoom_out = {zoom}"), *SIGMAS).collect())


def test_odd_input(spark):
    assert borders.gauss3d_borders(frame(spark, []), *SIGMAS).count() == 0
    one = volume(9, (1, 1, 1))
    assert blurred(borders.gauss3d_borders(frame(spark, [tile(one)]), *SIGMAS))[0] == {(1, 0, 0, 0): int(one[0, 0, 0])}
    wide = frame(spark, cut_volume(volume(10, (4, 4, 4)), (2, 2, 2)))
    assert blurred(borders.gauss3d_borders(wide, 0, 0, 0))[0] == voxels_of(wide.collect())


def test_many_images_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(borders, "BROADCAST_IMAGES", 0)
    stack = volume(11, (8, 8, 8))
    got, _ = blurred(borders.gauss3d_borders(frame(spark, cut_volume(stack, (8, 8, 4))), 0.5, 0.5, 0.5))
    assert got == {(1, *p): v for p, v in slow_blur(as_voxels(stack), (0.5, 0.5, 0.5)).items()}


def test_only_border_voxels_are_shuffled(spark):
    df = frame(spark, cut_volume(volume(12, (256, 256, 256)), (128, 128, 128)))
    plan = borders.gauss3d_borders(df, 1.0, 1.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "rx" in exchanges[0]  # the insides meet no exchange at all
    radius = np.array([3, 3, 3])
    known = borders.lattices(df, (3, 3, 3)).drop("voxels", "regular")
    sent = borders.border_voxels(df.join(F.broadcast(known), ["image_id", "zoom_out"]), radius)
    assert 0 < sent.agg(F.sum(F.length("pixels"))).first()[0] < 256**3 / 3
