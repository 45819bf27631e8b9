import numpy as np
import pytest

from helpers import as_voxels, cut_volume, frame, slow_blur, stack_of, tile, voxels_of
from voxelloom.operators import gauss
from voxelloom.operators.gauss import blur, gauss3d_tile, gauss_strip2d, kernel_weights
from voxelloom.operators.seamless import gauss3d_seamless

RNG = np.random.default_rng(7)


def test_kernel_sums_to_one_and_matches_known_weights():
    assert kernel_weights(1.0) == [26152, 15862, 3539, 291]
    for sigma in (0.0, 0.3, 0.9, 2.5, 7.0):
        side = kernel_weights(sigma)
        assert side[0] + 2 * sum(side[1:]) == 65536
    with pytest.raises(ValueError):
        kernel_weights(-1)


@pytest.mark.parametrize("shape", [(1, 1, 1), (1, 5, 7), (4, 4, 4), (3, 9, 2)])
@pytest.mark.parametrize("sigmas", [(1.0, 0.9, 1.0), (0.0, 2.0, 0.5)])
def test_tile_blur_equals_brute_force(spark, shape, sigmas):
    stack = RNG.integers(0, 256, shape, dtype=np.uint8)
    got = stack_of(gauss3d_tile(frame(spark, [tile(stack, (-3, 2, 0))]), *sigmas).first())
    assert as_voxels(got) == slow_blur(as_voxels(stack), sigmas)


def test_constant_tile_is_a_fixed_point(spark):
    stack = np.full((3, 4, 5), 137, np.uint8)
    for df in (gauss3d_tile, gauss_strip2d, gauss3d_seamless):
        assert (stack_of(df(frame(spark, [tile(stack)])).first()) == 137).all()


def test_single_bright_voxel_spreads_symmetrically():
    stack = np.zeros((1, 9, 9, 9), np.uint8)
    stack[0, 4, 4, 4] = 255
    out = blur(stack, (1.0, 1.0, 1.0))[0]
    assert (out == out[::-1]).all() and (out == out.transpose(2, 1, 0)).all()
    assert out.max() == out[4, 4, 4]


def test_all_columns_and_slices_survive(spark):
    """Sigma 0 returns the input: no column, first or last slice gets lost."""
    stack = RNG.integers(0, 256, (5, 4, 6), dtype=np.uint8)
    out = gauss3d_tile(frame(spark, [tile(stack)]), 0.0, 0.0, 0.0).first()
    assert (stack_of(out) == stack).all()


def test_all_three_sigmas_count(spark):
    stack = RNG.integers(0, 256, (6, 6, 6), dtype=np.uint8)
    df = frame(spark, [tile(stack)])
    base = stack_of(gauss3d_tile(df, 1.0, 1.0, 1.0).first())
    for sigmas in ((2.0, 1.0, 1.0), (1.0, 2.0, 1.0), (1.0, 1.0, 2.0)):
        assert (stack_of(gauss3d_tile(df, *sigmas).first()) != base).any()


def test_strip_mixes_rows_across_slices_but_not_z(spark):
    stack = np.zeros((2, 3, 3), np.uint8)
    stack[0, 2, 1] = 255
    out = stack_of(gauss_strip2d(frame(spark, [tile(stack)])).first())
    assert out[1, 0, 1] > 0
    strip = as_voxels(stack.reshape(1, 6, 3))
    assert as_voxels(out.reshape(1, 6, 3)) == slow_blur(strip, (1.0, 1.0, 0.0))


def test_a_wrong_payload_length_stops_the_job(spark):
    row = list(tile(np.zeros((2, 2, 2))))
    row[-1] = bytearray(7)
    with pytest.raises(Exception, match="does not fill box"):
        gauss3d_tile(frame(spark, [tuple(row)])).collect()


def seamless_voxels(df):
    return {k[1:]: v for k, v in voxels_of(df.collect()).items()}


@pytest.mark.parametrize("cell", [None, (4, 4, 4), (5, 3, 7), (8, 8, 8)])
def test_seamless_equals_brute_force_with_gaps(spark, cell):
    volume = RNG.integers(0, 256, (8, 9, 10), dtype=np.uint8)
    rows = cut_volume(volume, (4, 4, 4), origin=(-6, 3, -1))
    rows = rows[:4] + rows[6:]
    df = frame(spark, rows)
    present = {k[1:]: v for k, v in voxels_of(df.collect()).items()}
    out = gauss3d_seamless(df, 1.0, 0.9, 1.0, cell=cell)
    assert seamless_voxels(out) == slow_blur(present, (1.0, 0.9, 1.0))
    assert sorted(r["name"] for r in out.collect()) == sorted(r[1] for r in rows)


def test_seamless_with_a_radius_beyond_the_neighbour(spark):
    volume = RNG.integers(0, 256, (3, 6, 11), dtype=np.uint8)
    df = frame(spark, cut_volume(volume, (2, 2, 3)))
    out = gauss3d_seamless(df, 2.0, 1.5, 0.0, cell=(2, 2, 3))
    assert seamless_voxels(out) == slow_blur(as_voxels(volume), (2.0, 1.5, 0.0))


def test_seamless_agrees_with_the_whole_volume_as_one_tile(spark):
    volume = RNG.integers(0, 256, (8, 12, 12), dtype=np.uint8)
    whole = stack_of(gauss3d_tile(frame(spark, [tile(volume)])).first())
    out = gauss3d_seamless(frame(spark, cut_volume(volume, (4, 4, 4))))
    assert seamless_voxels(out) == as_voxels(whole)


def test_seamless_ignores_copies_and_keeps_images_apart(spark):
    volume = RNG.integers(0, 256, (4, 8, 8), dtype=np.uint8)
    one = cut_volume(volume, (4, 4, 4))
    other = cut_volume(255 - volume, (4, 4, 4), image_id=2)
    once = gauss3d_seamless(frame(spark, one + other)).collect()
    often = gauss3d_seamless(frame(spark, one * 20 + other)).collect()
    assert voxels_of(once) == voxels_of(often)
    assert len(once) == len(often) == 8


def test_seamless_total_is_kept_away_from_the_edge(spark):
    volume = np.zeros((16, 16, 16), np.uint8)
    volume[8, 8, 8] = 200
    out = voxels_of(gauss3d_seamless(frame(spark, cut_volume(volume, (4, 4, 4)))).collect())
    assert abs(sum(out.values()) - 200) <= 60


def test_long_axes_give_the_same_as_short_ones(monkeypatch):
    stack = RNG.integers(0, 256, (2, 5, 40, 31), dtype=np.uint8)
    bright = np.full((1, 3, 30, 30), 255, np.uint8)
    by_matrix = [blur(s, (2.0, 1.3, 0.7)) for s in (stack, bright)]
    monkeypatch.setattr(gauss, "MATRIX_SIZE", 0)
    for s, expected in zip((stack, bright), by_matrix):
        assert (blur(s, (2.0, 1.3, 0.7)) == expected).all()
    assert (by_matrix[1] == 255).all()
    monkeypatch.setattr(gauss, "BLOCK_VOXELS", 100)
    assert (blur(stack, (2.0, 1.3, 0.7)) == by_matrix[0]).all()


@pytest.mark.parametrize("sigma", [30.0, 300.0, 1000.0, 2000.0])
def test_wide_kernels_fall_evenly_from_the_centre(sigma):
    weights = kernel_weights(sigma)
    assert weights[0] + 2 * sum(weights[1:]) == 65536 and weights[0] - weights[1] <= gauss.CENTRE_UNITS + 1
    assert all(a >= b for a, b in zip(weights, weights[1:]))
