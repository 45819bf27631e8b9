import math

import numpy as np
import pytest

from helpers import frame, stack_of, tile
from voxelloom.operators.histogram import histograms, slice_histogram
from voxelloom.operators.threshold import METHODS, auto_threshold, levels, threshold_levels

RNG = np.random.default_rng(5)


def samples():
    flat = [RNG.integers(0, 256, 64), RNG.integers(90, 120, 64), np.full(64, 77), np.full(64, 0), np.full(64, 255)]
    flat += [np.r_[np.full(40, 10), np.full(24, 200)], np.r_[np.full(1, 0), np.full(63, 255)], np.r_[np.full(63, 5), [6]]]
    flat += [np.clip(np.r_[RNG.normal(60, 8, 40), RNG.normal(180, 12, 24)], 0, 255)]
    flat += [np.arange(64) * 4, np.arange(64) + 96, np.repeat([3, 9, 200, 250], 16)]
    flat += [RNG.choice([0, 1, 2, 254, 255], 64) for _ in range(4)]
    flat += [RNG.integers(lo, lo + w, 64) for lo in (0, 100, 200) for w in (2, 3, 5, 56)]
    return np.array(flat).astype(np.uint8)


def slow_level(values, method):
    """One slice, straight from the published rule."""
    h = np.bincount(values, minlength=256)
    n = len(values)
    occupied = np.flatnonzero(h)
    if len(occupied) == 1:
        return int(occupied[0])
    candidates = [t for t in range(256) if 0 < h[: t + 1].sum() < n]

    def classes(t):
        return values[values <= t].astype(float), values[values > t].astype(float)

    def first_min(score):
        scores = {t: round(score(t), 9) for t in candidates}
        best = min(scores.values())
        return min(t for t, s in scores.items() if s <= best + 1e-9)

    if method == "default":
        for t in candidates:
            a, b = classes(t)
            if t >= (a.mean() + b.mean()) / 2 - 1e-9:
                return t
        return candidates[-1]
    if method == "mean":
        return int(values.astype(int).sum() // n)
    if method == "percentile":
        return first_min(lambda t: abs(len(classes(t)[0]) / n - 0.5))
    if method == "otsu":
        return first_min(lambda t: -len(classes(t)[0]) * len(classes(t)[1]) / n**2 * (classes(t)[0].mean() - classes(t)[1].mean()) ** 2)

    def entropy(p):
        p = p[p > 0] / p.sum()
        return -(p * np.log(p)).sum()

    if method == "maxentropy":
        return first_min(lambda t: -entropy(h[: t + 1]) - entropy(h[t + 1 :]))
    if method == "yen":
        p = h / n

        def score(t):
            a, b = p[: t + 1], p[t + 1 :]
            return math.log((a**2).sum() * (b**2).sum()) - 2 * math.log(a.sum() * b.sum())

        return first_min(score)
    if method == "huang":
        span = occupied[-1] - occupied[0]

        def score(t):
            a, b = classes(t)
            total = 0.0
            for v in occupied:
                mean = math.floor((a if v <= t else b).mean() + 0.5)
                u = 1 / (1 + abs(v - mean) / span)
                total += h[v] * -(u * math.log(u) + ((1 - u) * math.log(1 - u) if u < 1 else 0))
            return total

        return first_min(score)
    if method == "triangle":
        peak = int(np.argmax(h))
        end = occupied[-1] if occupied[-1] - peak >= peak - occupied[0] else occupied[0]
        line = range(min(peak, end), max(peak, end) + 1)
        gap = {v: h[peak] + (h[end] - h[peak]) * abs(v - peak) / abs(end - peak) - h[v] for v in line}
        best = max(gap.values())
        return min(v for v, g in gap.items() if g >= best - 1e-9)
    if method == "minerror":
        def score(t):
            total = 0.0
            for part in classes(t):
                share, var = len(part) / n, part.var()
                if len(np.unique(part)) == 1:
                    return math.inf
                total += share * math.log(var) - 2 * share * math.log(share)
            return total
        if all(score(t) == math.inf for t in candidates):
            return int(values.astype(int).sum() // n)
        return first_min(score)
    if method == "shanbhag":
        p = h / n
        c = np.cumsum(p)

        def score(t):
            a, b = c[t], 1 - c[t]
            dark = -sum(p[v] * math.log(1 - 0.5 / a * c[v - 1]) for v in range(1, t + 1) if p[v]) * 0.5 / a
            light = -sum(p[v] * math.log(1 - 0.5 / b * (1 - c[v])) for v in range(t + 1, 256) if p[v]) * 0.5 / b
            return abs(dark - light)

        return first_min(score)
    raise AssertionError(method)


CHECKED = ["default", "mean", "percentile", "otsu", "maxentropy", "yen", "huang", "triangle", "minerror", "shanbhag"]


@pytest.mark.parametrize("method", CHECKED)
def test_level_equals_the_published_rule(method):
    values = samples()
    got = levels(histograms(values), method).tolist()
    assert got == [slow_level(v, method) for v in values]


def test_window_form_equals_the_kernel_form(spark):
    values = samples()
    rows = [tile(v.reshape(1, 8, 8), (0, 0, i), name=f"s{i:03d}") for i, v in enumerate(values)]
    found = threshold_levels(slice_histogram(frame(spark, rows)), "image_id", "zoom_out", "name", "z").orderBy("name").collect()
    for method in [m for m in CHECKED[:8] if m != "huang"]:
        assert [r[f"t_{method}"] for r in found] == levels(histograms(values), method).tolist(), method


@pytest.mark.parametrize("method", sorted(METHODS))
def test_every_method_splits_two_levels(method):
    values = np.repeat(np.array([[20, 220]], np.uint8), 32, axis=1)
    level = int(levels(histograms(values), method)[0])
    assert 20 <= level < 220


@pytest.mark.parametrize("method", sorted(METHODS))
def test_a_constant_slice_becomes_black(spark, method):
    out = auto_threshold(frame(spark, [tile(np.full((2, 3, 3), 99))]), method).first()
    assert (stack_of(out) == 0).all()


@pytest.mark.parametrize("method", ["li", "intermodes", "minimum", "moments", "renyientropy"])
def test_iterative_methods_find_the_gap_of_two_populations(method):
    values = np.clip(np.r_[RNG.normal(60, 6, 4000), RNG.normal(190, 6, 3000)], 0, 255).astype(np.uint8)[None, :]
    assert 65 < int(levels(histograms(values), method)[0]) < 185


def test_li_is_a_fixed_point():
    values = np.clip(np.r_[RNG.normal(60, 20, 3000), RNG.normal(170, 30, 1000)], 1, 255).astype(np.uint8)
    t = int(levels(histograms(values[None, :]), "li")[0])
    a, b = values[values <= t].mean(), values[values > t].mean()
    assert abs((b - a) / (math.log(b) - math.log(a)) - t) <= 1


def test_each_slice_has_its_own_threshold_and_bright_background_inverts(spark):
    stack = np.stack([np.repeat([[10, 20]], 2, axis=0), np.repeat([[100, 200]], 2, axis=0)])
    df = frame(spark, [tile(stack)])
    dark = stack_of(auto_threshold(df, "Otsu").first())
    assert dark.tolist() == [[[0, 255], [0, 255]]] * 2
    assert (stack_of(auto_threshold(df, "Otsu", dark=False).first()) == 255 - dark).all()


def test_unknown_method_is_refused_before_any_job(spark):
    with pytest.raises(ValueError, match="unknown threshold"):
        auto_threshold(frame(spark, [tile(np.zeros((1, 1, 1)))]), "nope")


def slow_peaks(values):
    """Smooth until two strict peaks are left; None if that never happens."""
    h = np.bincount(values, minlength=256).astype(float)
    for _ in range(10_000):
        noise = h.max() / 1e9
        peaks = [i for i in range(1, 255) if h[i] - h[i - 1] > noise and h[i] - h[i + 1] > noise]
        if len(peaks) <= 2:
            return (h, peaks) if len(peaks) == 2 else (h, None)
        wide = np.r_[0.0, h, 0.0]
        h = (wide[:-2] + wide[1:-1] + wide[2:]) / 3
    return h, None


def test_peaks_of_the_smoothed_histogram():
    values = np.array([v for v in samples() if v.min() != v.max()])
    middle, valley = levels(histograms(values), "intermodes"), levels(histograms(values), "minimum")
    for v, m, low in zip(values, middle.tolist(), valley.tolist()):
        h, peaks = slow_peaks(v)
        if peaks is None:
            assert m == low == int(v.astype(int).sum() // len(v))
        else:
            assert m == sum(peaks) // 2
            inside = np.floor(h / (h.max() / 1e9) + 0.5)[peaks[0] : peaks[1] + 1]
            assert low == peaks[0] + int(np.argmin(inside))


def test_method_names_ignore_case_and_the_background_suffix():
    values = samples()
    assert (levels(histograms(values), "HUANG dark") == levels(histograms(values), "huang")).all()


def test_large_stacks_are_worked_off_in_parts(spark, monkeypatch):
    from voxelloom.functions import batches

    stack = RNG.integers(0, 256, (7, 5, 6), dtype=np.uint8)
    from voxelloom.operators.threshold import binarise

    whole = batches.per_slices(stack[None], lambda s: binarise(s, "otsu"))
    monkeypatch.setattr(batches, "STACK_VOXELS", 60)
    assert (batches.per_slices(stack[None], lambda s: binarise(s, "otsu")) == whole).all()


@pytest.mark.parametrize("method", sorted(METHODS))
def test_many_small_slices_need_little_memory(method):
    import tracemalloc

    from voxelloom.operators.threshold import binarise

    slices = RNG.integers(60, 200, (1 << 15, 4, 4), dtype=np.uint8)
    few = binarise(slices[: 1029], method)
    tracemalloc.start()
    whole = binarise(slices, method)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (whole[: 1029] == few).all() and len(binarise(slices[:0], method)) == 0
    assert peak < 128 << 20  # one table of all slices alone takes 64 MiB


LARGE = [1 << 14, 1 << 18, 1 << 22]  # 64 pixels become up to 16384 x 16384


@pytest.mark.parametrize("method", sorted(METHODS))
@pytest.mark.parametrize("factor", LARGE)
def test_levels_do_not_depend_on_the_size_of_the_slice(method, factor):
    counts = histograms(samples())
    assert levels(counts * factor, method).tolist() == levels(counts, method).tolist()


@pytest.mark.parametrize("method", ["yen", "minerror", "otsu", "default"])
def test_bright_population_on_a_dark_background(method):
    rng = np.random.default_rng(2)
    shares = np.zeros(256)
    shares[:40] = np.exp(-((np.arange(40) - 15) ** 2) / 60)
    shares[180:220] = 0.05 * np.exp(-((np.arange(40) - 20) ** 2) / 90)
    base = np.floor(shares / shares.sum() * 4000).astype(np.int64) + rng.integers(0, 2, 256) * (shares > 0)
    assert int(levels(base[None, :] * 16384, method)[0]) == int(levels(base[None, :], method)[0])


def test_window_form_at_every_size_and_with_copies(spark):
    counts = histograms(samples())
    rows = [(i, int(v), int(n) * f, f) for f in LARGE for i, c in enumerate(counts) for v, n in enumerate(c) if n]
    once = spark.createDataFrame(rows, "slice int, v int, n long, size long")
    found = threshold_levels(once, "size", "slice").orderBy("size", "slice").collect()
    twice = threshold_levels(once.unionByName(once), "size", "slice").orderBy("size", "slice").collect()
    assert found == twice
    for method in [m for m in CHECKED[:8] if m != "huang"]:
        assert [r[f"t_{method}"] for r in found] == levels(counts, method).tolist() * len(LARGE), method


def test_zooms_are_slices_of_their_own(spark):
    near, far = RNG.integers(0, 100, (1, 8, 8)), RNG.integers(100, 256, (1, 8, 8))
    rows = [tile(near, name="t"), tile(far, zoom_out=2, name="t"), tile(near, name="t")]
    found = threshold_levels(slice_histogram(frame(spark, rows)), "image_id", "zoom_out", "name", "z").orderBy("zoom_out").collect()
    assert [r["t_otsu"] for r in found] == levels(histograms(np.stack([near, far]).astype(np.uint8)), "otsu").tolist()
