import numpy as np
import pytest

from helpers import frame, stack_of, tile
from voxelloom.operators import bandpass as bp
from voxelloom.operators.histogram import contrast_range, contrast_stretch, histogram_from_voxels, range_of, histograms, slice_histogram
from voxelloom.operators.layout import voxel_explode

RNG = np.random.default_rng(3)


def test_pad_size_is_the_smallest_power_of_two(spark):
    for size in list(range(1, 200)) + [128, 1365, 1366, 21845]:
        n = bp.pad_size(size, 1)
        assert n >= 2 and n >= 1.5 * size and (n == 2 or n / 2 < 1.5 * size) and n & (n - 1) == 0
    assert bp.pad_size(128, 128) == 256
    df = spark.createDataFrame([(w, 1 + w % 7) for w in range(1, 3000, 7)], "w int, h int")
    for row in bp.fft_pad_size(df, "w", "h").collect():
        assert row["pad_size"] == bp.pad_size(row["w"], row["h"])


@pytest.mark.parametrize("size", range(1, 24))
def test_mirror_index_repeats_the_edge(size):
    canvas = bp.pad_size(size, size)
    left = bp.canvas_origin(canvas, size)
    padded = np.pad(np.arange(size), (left, canvas - size - left), mode="symmetric")
    assert (bp.mirror_index(canvas, size) == padded).all()


def test_a_slice_must_fit_its_canvas():
    with pytest.raises(ValueError):
        bp.canvas_origin(4, 9)


def direct_factor(n, j, c, band):
    """Frequency factor written out for one place."""
    a, b = min(j, n - j), min(c, n - c)
    if a == b == 0:
        return 1.0
    r = a * a + b * b
    value = (1 - np.exp(-r * (2 * band.large / n) ** 2)) * np.exp(-r * (2 * band.small / n) ** 2)
    sharp = ((100 - band.tolerance) / 100) ** 2
    if band.stripes == "horizontal":
        value *= 1 - np.exp(-b * b * sharp)
    if band.stripes == "vertical":
        value *= 1 - np.exp(-a * a * sharp)
    return value


@pytest.mark.parametrize("stripes", bp.STRIPES)
def test_filter_grid_and_its_dataframe(spark, stripes):
    band = bp.Band(10.0, 2.0, stripes, 20.0)
    for n in (8, 16):
        grid = bp.filter_grid(n, band)
        assert np.allclose(grid, [[direct_factor(n, j, c, band) for c in range(n)] for j in range(n)], atol=1e-15)
    df = frame(spark, [tile(np.zeros((1, 4, 4))), tile(np.zeros((1, 9, 4)))])
    for row in bp.bandpass_filter_grid(df, band).collect():
        assert abs(row["factor"] - direct_factor(row["canvas"], row["row"], row["col"], band)) < 1e-12


def test_stripe_choice_matters():
    slices = RNG.integers(0, 256, (1, 16, 16), dtype=np.uint8)
    results = [bp.filter_slices(slices, bp.Band(stripes=s)) for s in bp.STRIPES]
    assert not np.allclose(results[0], results[1]) and not np.allclose(results[1], results[2])
    with pytest.raises(ValueError):
        bp.Band(stripes="diagonal")


def test_transform_equals_a_direct_sum():
    band = bp.Band(12.0, 2.5, "vertical")
    slices = RNG.integers(0, 256, (2, 5, 3), dtype=np.uint8)
    n = bp.pad_size(3, 5)
    rows, cols = bp.mirror_index(n, 5), bp.mirror_index(n, 3)
    grid = bp.filter_grid(n, band)
    k = np.arange(n)
    wave = np.exp(2j * np.pi * np.outer(k, k) / n)
    for i, got in enumerate(bp.filter_slices(slices, band)):
        padded = slices[i][np.ix_(rows, cols)].astype(float)
        spectrum = wave.conj() @ padded @ wave.conj()
        back = (wave @ (spectrum * grid) @ wave).real / n**2
        top, left = bp.canvas_origin(n, 5), bp.canvas_origin(n, 3)
        assert np.allclose(got, back[top : top + 5, left : left + 3], atol=1e-9)


@pytest.mark.parametrize("stripes", bp.STRIPES)
@pytest.mark.parametrize("shape", [(1, 1), (2, 7), (16, 16), (33, 20)])
def test_matrix_form_equals_the_transform(stripes, shape):
    band = bp.Band(17.0, 2.0, stripes, 10.0)
    slices = RNG.integers(0, 256, (3, *shape), dtype=np.uint8)
    assert np.allclose(bp._multiply(slices, band), bp._transform(slices, band), atol=1e-9)


def test_constant_slices_are_kept(spark):
    for scale in (True, False):
        out = bp.bandpass(frame(spark, [tile(np.full((3, 7, 5), 91))]), bp.Band(scale=scale)).first()
        assert (stack_of(out) == 91).all()


def test_every_slice_is_filtered(spark):
    stack = RNG.integers(0, 256, (3, 16, 16), dtype=np.uint8)
    whole = stack_of(bp.bandpass(frame(spark, [tile(stack)])).first())
    for z in range(3):
        single = stack_of(bp.bandpass(frame(spark, [tile(stack[z : z + 1])])).first())
        assert (whole[z] == single[0]).all() and (whole[z] != stack[z]).any()


def test_saturation_clips_half_a_percent_at_each_end():
    values = np.arange(400.0).reshape(1, 20, 20)
    out = bp.to_grey(values, bp.Band())
    assert (out.ravel()[:3] == 0).all() and (out.ravel()[-3:] == 255).all() and out.ravel()[3] > 0
    free = bp.to_grey(values, bp.Band(saturate=False))
    assert free.ravel()[1] > 0


def test_contrast_range_agrees_between_forms(spark):
    stacks = [RNG.integers(30, 200, (2, 16, 16), dtype=np.uint8), np.full((2, 4, 4), 9), RNG.integers(0, 2, (2, 30, 30))]
    df = frame(spark, [tile(s, (100 * i, 0, 0)) for i, s in enumerate(stacks)])
    for saturated in (0.0, 1.0, 30.0):
        found = contrast_range(slice_histogram(df), "name", "z", saturated=saturated).collect()
        by_key = {(r["name"], r["z"]): (r["lo"], r["hi"]) for r in found}
        for row in df.collect():
            low, high = range_of(histograms(stack_of(row)), saturated)
            for z in range(2):
                assert by_key[row["name"], z] == (low[z], high[z])


def test_histogram_forms_agree(spark):
    df = frame(spark, [tile(RNG.integers(0, 9, (3, 8, 8)))])
    narrow = slice_histogram(df)
    wide = histogram_from_voxels(voxel_explode(df), "image_id", "z")
    assert sorted(map(tuple, narrow.select("image_id", "z", "v", "n").collect())) == sorted(map(tuple, wide.collect()))
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_stretch_by_hand(spark):
    stack = np.array([[[50, 100, 150, 200]], [[7, 7, 7, 7]]])
    out = stack_of(contrast_stretch(frame(spark, [tile(stack)])).first())
    assert out.tolist() == [[[0, 85, 170, 255]], [[7, 7, 7, 7]]]
