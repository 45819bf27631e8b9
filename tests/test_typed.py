"""Typed payloads: 8 bits as before, 16 bits and floats against slow versions, mixed tables, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import as_voxels, frame, slow_weights, tile
from voxelloom.operators import gauss, histogram, threshold, typed
from voxelloom.operators.bandpass import Band, bandpass, filter_slices
from voxelloom.schema import TILES

SIGMAS = (1.0, 0.5, 0.3)
SCHEMA = TILES.simpleString()[7:-1].replace(":", " ") + ", pixel_type string"


def typed_tile(stack, **kwargs):
    name = {"u1": "uint8", "u2": "uint16", "f4": "float32"}[stack.dtype.str[1:]]
    row = list(tile(np.zeros(stack.shape, np.uint8), **kwargs))
    row[-1] = bytearray(np.ascontiguousarray(stack).tobytes())
    return (*row, name)


def table(spark, *stacks):
    return spark.createDataFrame([typed_tile(s, image_id=at) for at, s in enumerate(stacks)], SCHEMA)


def stacks(df):
    return [np.frombuffer(bytes(r["pixels"]), typed.DTYPES[r["pixel_type"]]).reshape(r["z_dim"], r["y_dim"], r["x_dim"]) for r in sorted(df.collect())]


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(4)
    return [
        rng.integers(0, 65536, (3, 6, 7)).astype("<u2"), rng.normal(0, 1e3, (3, 6, 7)).astype("<f4"), rng.integers(0, 256, (3, 6, 7)).astype("u1"),
        np.full((2, 3, 4), 65535, "<u2"), np.full((1, 1, 1), -2.5, "<f4"), rng.integers(40_000, 40_100, (2, 5, 9)).astype("<u2"),
    ]


def slow_blur_of(stack):
    voxels = {p: v for p, v in zip(as_voxels(np.zeros(stack.shape)), stack.reshape(-1).tolist(), strict=True)}
    for axis, sigma in enumerate(SIGMAS):
        last = max(p[axis] for p in voxels)
        out = {}
        for p in voxels:
            total = 0
            for offset, weight in slow_weights(sigma).items():
                q = list(p)
                q[axis] = max(0, min(last, p[axis] + offset))
                total += weight * voxels[tuple(q)]
            out[p] = (total + 32768) // 65536 if stack.dtype.kind == "u" else float(np.float32(total / 65536))
        voxels = out
    return np.array(list(voxels.values())).reshape(stack.shape)


def test_blur_keeps_types(spark, samples):
    for got, stack in zip(stacks(typed.gauss3d_typed(table(spark, *samples), *SIGMAS)), samples, strict=True):
        assert got.dtype == stack.dtype
        want = slow_blur_of(stack)
        assert (got == want).all() if stack.dtype.kind == "u" else np.allclose(got, want, rtol=1e-6)


def test_eight_bits_equal_the_plain_operators(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, [tile(rng.integers(0, 256, (3, 8, 8)), (8 * i, 0, 0)) for i in range(4)])
    band = Band()
    pairs = [
        (typed.gauss3d_typed(df, *SIGMAS), gauss.gauss3d_tile(df, *SIGMAS)),
        (typed.stretch_typed(df, 1.0), histogram.contrast_stretch(df)),
        (typed.threshold_typed(df, "Li"), threshold.auto_threshold(df, "Li")),
        (typed.bandpass_typed(df, band), bandpass(df, band)),
    ]
    for got, want in pairs:
        assert sorted(map(tuple, got.drop("pixel_type").collect())) == sorted(map(tuple, want.collect()))
        assert {r[0] for r in got.select("pixel_type").distinct().collect()} == {"uint8"}
    counts = typed.histogram_typed(df).select("image_id", "zoom_out", "name", "z", F.col("v").cast("int").alias("v"), "n")
    assert sorted(counts.collect()) == sorted(histogram.slice_histogram(df).select(*counts.columns).collect())


def test_stretch_and_conversion(spark, samples):
    for got, stack in zip(stacks(typed.stretch_typed(table(spark, *samples), 0.0)), samples, strict=True):
        assert got.dtype == stack.dtype
        for plane, source in zip(got, stack.astype(np.float64), strict=True):
            low, high = source.min(), source.max()
            top = {"u2": 65535, "u1": 255, "f4": 1}[stack.dtype.str[1:]]
            if low == high:
                assert (plane == source).all()
            elif top == 1:
                assert np.allclose(plane, (source - low) / (high - low), atol=1e-6)
            else:
                assert (plane == np.floor((source - low) * top / (high - low) + 0.5)).all()
    for to, top in (("uint8", 255), ("uint16", 65535)):
        for got, stack in zip(stacks(typed.convert_type(table(spark, *samples), to, scale=False)), samples, strict=True):
            assert got.dtype == typed.DTYPES[to] and (got == np.clip(np.floor(stack.astype(np.float64) + 0.5), 0, top)).all()
        for got, stack in zip(stacks(typed.convert_type(table(spark, *samples), to)), samples, strict=True):
            for plane, source in zip(got, stack, strict=True):
                if stack.dtype != typed.DTYPES[to] and source.min() < source.max():
                    assert plane.min() == 0 and plane.max() == top
                    order = np.argsort(source, axis=None, kind="stable")
                    assert (np.diff(plane.reshape(-1)[order].astype(int)) >= 0).all()
    floats = stacks(typed.convert_type(table(spark, *samples), "float32"))
    assert all((got == stack).all() and got.dtype == "<f4" for got, stack in zip(floats, samples, strict=True))


def test_bins_and_thresholds(spark, samples):
    narrow = samples[5]  # fewer values than bins: every value has a bin of its own
    bins = typed.binned(narrow)
    assert all((bins[i] == narrow[i] - narrow[i].min()).all() for i in range(len(narrow)))
    two = np.where(np.random.default_rng(1).random((2, 16, 16)) < 0.4, 50_000, 300).astype("<u2")
    for method in ("Otsu", "Huang", "Li", "Triangle"):
        got = stacks(typed.threshold_typed(table(spark, two, two.astype("<f4") / 7), method))
        assert all(g.dtype == np.uint8 and (g == np.where(two == 50_000, 255, 0)).all() for g in got)


def test_bandpass_keeps_floats_and_ranges(spark, samples):
    band = Band()
    got = stacks(typed.bandpass_typed(table(spark, *samples), band))
    assert np.allclose(got[1], filter_slices(samples[1], band), rtol=1e-4, atol=1e-2)
    assert got[0].dtype == "<u2" and got[0].min() == 0 and got[0].max() == 65535


def test_voxels_and_histogram(spark, samples):
    df = table(spark, *samples)
    rows = typed.voxels_typed(df.withColumn("zoom_out", F.lit(3))).collect()
    assert len(rows) == sum(s.size for s in samples) and {r["zoom_out"] for r in rows} == {3}
    found = {(r["image_id"], r["x"], r["y"], r["z"]): r["v"] for r in rows}
    assert found == {(at, x, y, z): float(v) for at, s in enumerate(samples) for (z, y, x), v in np.ndenumerate(s)}
    counts = typed.histogram_typed(df).groupBy("image_id").agg(F.sum("n")).collect()
    assert dict(map(tuple, counts)) == {at: s.size for at, s in enumerate(samples)}


def test_refuses_what_does_not_fit(spark, samples):
    df = table(spark, samples[0])
    for wrong in (df.withColumn("pixel_type", F.lit("uint8")), df.withColumn("pixel_type", F.lit("int64")), df.withColumn("pixel_type", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="does not fill box|unknown pixel type"):
            typed.gauss3d_typed(wrong).collect()
    with pytest.raises(ValueError):
        typed.convert_type(df, "uint32")
    assert typed.gauss3d_typed(df.limit(0)).count() == 0


def test_plans_have_no_exchange(spark, samples):
    df = table(spark, *samples)
    for out in (typed.gauss3d_typed(df), typed.threshold_typed(df), typed.convert_type(df, "uint8"), typed.histogram_typed(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
