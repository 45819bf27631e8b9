"""Automatic thresholds per slice.

Every method chooses a grey level t from the slice's histogram; a pixel becomes 255 if it is above t and 0
otherwise (the other way round for a bright background). Only levels that leave pixels on both
sides compete, the smallest level wins a tie, and a slice of one grey value keeps t at that value. Criteria
that are not integers are compared at a resolution of 1e-9, so that all engines agree on ties.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.functions.batches import map_payloads, per_slices
from voxelloom.operators.histogram import LEVELS, apply_levels, histograms, merged

GREY = np.arange(LEVELS)
RESOLUTION = 1e9
# Products of three such factors, each at most a slice's pixels or 255 times them, leave 64 bits beyond this size.
EXACT_PIXELS = 1 << 22
# Slices whose histograms are worked on at once: a method holds dozens of tables of 256 numbers per slice, however small the slice.
TOGETHER = 1 << 10


class Cumulative:
    """Running sums of a batch of histograms, one row per slice."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.below = np.cumsum(counts, axis=1)
        self.total = self.below[:, -1:]
        self.above = self.total - self.below
        self.mass = np.cumsum(counts * GREY, axis=1)
        self.mass_total = self.mass[:, -1:]
        self.valid = (self.below > 0) & (self.above > 0)
        self.darkest = np.argmax(counts > 0, axis=1)
        self.brightest = LEVELS - 1 - np.argmax(counts[:, ::-1] > 0, axis=1)

    def exact(self, values: np.ndarray) -> np.ndarray:
        """The same whole numbers in a form whose products cannot overflow."""
        return values.astype(object) if self.total.max(initial=0) > EXACT_PIXELS else values

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        low = self.mass / np.maximum(self.below, 1)
        high = (self.mass_total - self.mass) / np.maximum(self.above, 1)
        return low, high

    def splits(self, t: int) -> np.ndarray:
        """Slices in which level t occurs and divides the pixels; in between nothing changes on either side."""
        return self.valid[:, t] & (self.counts[:, t] > 0)

    def smallest(self, score: np.ndarray) -> np.ndarray:
        """First level with the least score among the valid ones."""
        if score.dtype.kind == "f":
            with np.errstate(invalid="ignore"):
                score = np.floor(score * RESOLUTION + 0.5)
            score = np.where(np.isnan(score), np.inf, score)
            return np.argmin(np.where(self.valid, score, np.inf), axis=1)
        return np.argmin(np.where(self.valid, score, np.iinfo(np.int64).max), axis=1)

    def largest(self, score: np.ndarray) -> np.ndarray:
        return self.smallest(-score)

    def mean_level(self) -> np.ndarray:
        return (self.mass_total // self.total).ravel()


def _log(values: np.ndarray) -> np.ndarray:
    """Natural logarithm with 0 where the argument is not positive."""
    return np.log(np.where(values > 0, values, 1.0))


def isodata(h: Cumulative) -> np.ndarray:
    """First level not below the midpoint of the two class means; else the highest level that splits."""
    below, above = h.exact(h.below), h.exact(h.above)
    reached = (2 * GREY * below * above >= h.mass * above + (h.mass_total - h.mass) * below).astype(bool)
    reached &= h.valid
    last = LEVELS - 1 - np.argmax(h.valid[:, ::-1], axis=1)
    return np.where(reached.any(axis=1), np.argmax(reached, axis=1), last)


def otsu(h: Cumulative) -> np.ndarray:
    """Largest variance between the classes."""
    gap = (h.exact(h.mass_total) * h.below - h.exact(h.mass) * h.total).astype(np.float64)
    pairs = (h.exact(h.below) * h.above).astype(np.float64)
    score = np.where(h.valid, gap * gap / np.maximum(pairs, 1.0), -np.inf)
    return np.argmax(score, axis=1)


def mean(h: Cumulative) -> np.ndarray:
    return h.mean_level()


def percentile(h: Cumulative) -> np.ndarray:
    """Half of the pixels on each side."""
    return h.smallest(np.abs(2 * h.below - h.total))


def max_entropy(h: Cumulative) -> np.ndarray:
    """Largest sum of the class entropies."""
    spread = np.cumsum(h.counts * _log(h.counts), axis=1)
    low = _log(h.below) - spread / np.maximum(h.below, 1)
    high = _log(h.above) - (spread[:, -1:] - spread) / np.maximum(h.above, 1)
    return h.largest(low + high)


def yen(h: Cumulative) -> np.ndarray:
    """Largest entropic correlation."""
    square = np.cumsum(h.counts * h.counts, axis=1)
    product = h.below.astype(np.float64) * h.above
    return h.largest(2 * _log(product) - _log(square) - _log(square[:, -1:] - square))


def triangle(h: Cumulative) -> np.ndarray:
    """Farthest below the chord from the peak to the more distant end of the histogram."""
    peak = np.argmax(h.counts, axis=1)
    end = np.where(h.brightest - peak >= peak - h.darkest, h.brightest, h.darkest)
    rows = np.arange(len(peak))
    top, foot = h.counts[rows, peak][:, None], h.counts[rows, end][:, None]
    length, step = np.abs(end - peak)[:, None], np.abs(GREY - peak[:, None])
    between = (GREY >= np.minimum(peak, end)[:, None]) & (GREY <= np.maximum(peak, end)[:, None])
    drop = top * length + (foot - top) * step - h.counts * length
    return np.argmax(np.where(between, drop, -1), axis=1)


def fuzzy_entropy_table(span: int) -> np.ndarray:
    """Entropy, in units of 1e-9, of belonging to a class whose mean is d grey levels away, d = 0..span."""
    u = span / (span + np.arange(span + 1.0))
    entropy = -u * np.log(u) - (1 - u) * _log(1 - u)
    return np.floor(entropy * RESOLUTION + 0.5).astype(np.int64)


def huang(h: Cumulative) -> np.ndarray:
    """Least fuzziness around the two rounded class means."""
    low = (2 * h.mass + h.below) // np.maximum(2 * h.below, 1)
    high = (2 * (h.mass_total - h.mass) + h.above) // np.maximum(2 * h.above, 1)
    score = np.full(h.counts.shape, np.iinfo(np.int64).max)
    span = h.brightest - h.darkest
    tables = np.zeros((LEVELS, LEVELS), np.int64)
    for width in np.unique(span[span > 0]).tolist():
        tables[width, : width + 1] = fuzzy_entropy_table(width)
    for t in range(LEVELS - 1):
        rows = np.flatnonzero(h.splits(t))
        side = np.where(GREY <= t, low[rows, t][:, None], high[rows, t][:, None])
        entropy = tables[span[rows][:, None], np.abs(GREY - side)]
        score[rows, t] = (h.counts[rows] * entropy).sum(axis=1)
    return h.smallest(score)


def li(h: Cumulative) -> np.ndarray:
    """Fixed point of the minimum cross entropy iteration, started at the mean; of a cycle the smallest level.

    After as many steps as there are levels the walk is in its cycle, and as many again go through all of it.
    """
    low, high = h.means()
    rows = np.arange(len(h.counts))
    top = np.maximum(h.brightest - 1, h.darkest)
    level = np.clip(np.floor(h.mass_total / h.total + 0.5).astype(np.int64).ravel(), h.darkest, top)
    smallest = level
    for step in range(2 * LEVELS):
        a, b = low[rows, level], high[rows, level]
        root = np.where(a > 0, (b - a) / np.where((b > a) & (a > 0), _log(b) - _log(a), 1.0), 0.0)
        fresh = np.clip(np.where(b > a, np.floor(root + 0.5), level).astype(np.int64), h.darkest, top)
        smallest = fresh if step <= LEVELS else np.minimum(smallest, fresh)
        if (fresh == level).all():
            break
        level = fresh
    return smallest


def min_error(h: Cumulative) -> np.ndarray:
    """Least classification error of two normal populations; the mean if a class never has any spread."""
    square = np.cumsum(h.counts * GREY * GREY, axis=1)
    n = h.total.astype(np.float64)
    score = np.zeros(h.counts.shape)
    solid = h.valid.copy()
    for count, mass, power in (
        (h.below, h.mass, square),
        (h.above, h.mass_total - h.mass, square[:, -1:] - square),
    ):
        # the integer numerator tells a class without spread exactly
        spread = h.exact(power) * count - h.exact(mass) * mass
        solid &= (spread > 0).astype(bool)
        share = count / n
        variance = spread.astype(np.float64) / np.maximum(count.astype(np.float64) ** 2, 1)
        score += share * _log(variance) - 2 * share * _log(share)
    score = np.where(solid, score, np.inf)
    return np.where(solid.any(axis=1), h.smallest(score), h.mean_level())


def _smoothed_modes(h: Cumulative) -> tuple[np.ndarray, np.ndarray]:
    """Histograms smoothed by a three-point mean until two peaks are left, and where those peaks are."""
    smooth = h.counts.astype(np.float64)
    peaks = np.zeros(smooth.shape, bool)
    todo = np.arange(len(smooth))
    while todo.size:  # every pass flattens; in the end two peaks are left, or one
        part = smooth[todo]
        inner = part[:, 1:-1]
        # slopes below the resolution are rounding noise, not peaks
        noise = part.max(axis=1, keepdims=True) / RESOLUTION
        peaks[todo, 1:-1] = (inner - part[:, :-2] > noise) & (inner - part[:, 2:] > noise)
        number = peaks[todo].sum(axis=1)
        todo = todo[number > 2]
        part = np.pad(smooth[todo], ((0, 0), (1, 1)))
        smooth[todo] = (part[:, :-2] + part[:, 1:-1] + part[:, 2:]) / 3
    return smooth, peaks


def intermodes(h: Cumulative) -> np.ndarray:
    """Midpoint of the two peaks of the smoothed histogram; the mean if there are not two."""
    _, peaks = _smoothed_modes(h)
    first, last = np.argmax(peaks, axis=1), LEVELS - 1 - np.argmax(peaks[:, ::-1], axis=1)
    return np.where(peaks.sum(axis=1) == 2, (first + last) // 2, h.mean_level())


def minimum(h: Cumulative) -> np.ndarray:
    """Valley between the two peaks of the smoothed histogram; the mean if there are not two."""
    smooth, peaks = _smoothed_modes(h)
    first, last = np.argmax(peaks, axis=1), LEVELS - 1 - np.argmax(peaks[:, ::-1], axis=1)
    inside = (GREY >= first[:, None]) & (GREY <= last[:, None])
    scale = smooth.max(axis=1, keepdims=True) / RESOLUTION
    valley = np.argmin(np.where(inside, np.floor(smooth / scale + 0.5), np.inf), axis=1)
    return np.where(peaks.sum(axis=1) == 2, valley, h.mean_level())


def moments(h: Cumulative) -> np.ndarray:
    """Two-level image with the same first three moments."""
    share = h.counts / h.total
    m1, m2, m3 = ((share * GREY.astype(np.float64) ** k).sum(axis=1) for k in (1, 2, 3))
    spread = np.where(m2 - m1 * m1 > 0, m2 - m1 * m1, 1.0)
    c0, c1 = (m1 * m3 - m2 * m2) / spread, (m1 * m2 - m3) / spread
    root = np.sqrt(np.maximum(c1 * c1 - 4 * c0, 0.0))
    high = (root - c1) / 2
    dark = (high - m1) / np.where(root > 0, root, 1.0)
    reached = h.below / h.total >= dark[:, None] - 1 / RESOLUTION
    return np.argmax(reached & h.valid, axis=1)


def renyi_entropy(h: Cumulative) -> np.ndarray:
    """Weighted mean of the levels that maximise the entropies of order 1/2, 1 and 2."""

    def order(alpha: float) -> np.ndarray:
        power = np.where(h.counts > 0, h.counts.astype(np.float64), 0.0) ** alpha
        low = np.cumsum(power, axis=1)
        high = low[:, -1:] - low
        ratio = _log(low) + _log(high) - alpha * (_log(h.below) + _log(h.above))
        return h.largest(ratio / (1 - alpha))

    levels = np.sort(np.stack([order(0.5), max_entropy(h), order(2.0)], axis=1), axis=1)
    first, middle, last = levels.T
    near_low, near_high = middle - first <= 5, last - middle <= 5
    weights = np.where((near_low == near_high)[:, None], (1, 2, 1), np.where(near_low[:, None], (0, 1, 3), (3, 1, 0)))
    rows = np.arange(len(levels))
    share_first = (h.below[rows, first] / h.total.ravel())
    share_last = (h.below[rows, last] / h.total.ravel())
    part = (share_last - share_first) / 4
    level = (
        first * (share_first + part * weights[:, 0])
        + middle * part * weights[:, 1]
        + last * (1 - share_last + part * weights[:, 2])
    )
    return np.floor(level + 1 / RESOLUTION).astype(np.int64)


def shanbhag(h: Cumulative) -> np.ndarray:
    """Equal information in the two fuzzy classes."""
    share = h.counts / h.total
    below, above = h.below / h.total, h.above / h.total
    before = below - share
    score = np.full(share.shape, np.inf)
    for t in range(LEVELS - 1):
        rows = np.flatnonzero(h.splits(t))
        low, high = 0.5 / below[rows, t], 0.5 / above[rows, t]
        dark = (share[rows, 1 : t + 1] * _log(1 - low[:, None] * before[rows, 1 : t + 1])).sum(axis=1) * low
        light = (share[rows, t + 1 :] * _log(1 - high[:, None] * above[rows, t + 1 :])).sum(axis=1) * high
        score[rows, t] = np.abs(dark - light)
    return h.smallest(score)


METHODS: dict[str, Callable[[Cumulative], np.ndarray]] = {
    "default": isodata,
    "isodata": isodata,
    "huang": huang,
    "otsu": otsu,
    "mean": mean,
    "percentile": percentile,
    "maxentropy": max_entropy,
    "yen": yen,
    "triangle": triangle,
    "li": li,
    "minerror": min_error,
    "intermodes": intermodes,
    "minimum": minimum,
    "moments": moments,
    "renyientropy": renyi_entropy,
    "shanbhag": shanbhag,
}


def method_of(name: str) -> Callable[[Cumulative], np.ndarray]:
    """Method by name, whatever its case; a trailing " dark" is the default background and changes nothing."""
    try:
        return METHODS[name.lower().removesuffix(" dark")]
    except KeyError:
        raise ValueError(f"unknown threshold method {name!r}; known: {sorted(METHODS)}") from None


def levels(counts: np.ndarray, method: str) -> np.ndarray:
    """Threshold of every histogram row."""
    h = Cumulative(counts)
    return np.where(h.darkest == h.brightest, h.darkest, method_of(method)(h))


def binarise(slices: np.ndarray, method: str, dark: bool = True) -> np.ndarray:
    """Black and white (n, y, x) slices."""
    out = np.empty(slices.shape, np.uint8)
    for first in range(0, len(slices), TOGETHER):
        part = slices[first : first + TOGETHER]
        level = levels(histograms(part), method)[:, None]
        above = GREY[None, :] > level
        table = np.where(above if dark else ~above, 255, 0).astype(np.uint8)
        out[first : first + TOGETHER] = apply_levels(part, table)
    return out


def auto_threshold(tiles: DataFrame, method: str = "Default", dark: bool = True) -> DataFrame:
    """Binarise every slice by its own threshold; a narrow step."""
    method_of(method)
    return tiles.mapInArrow(map_payloads(lambda s: per_slices(s, lambda part: binarise(part, method, dark))), tiles.schema)


def threshold_levels(histogram: DataFrame, *keys: str) -> DataFrame:
    """Thresholds of the closed-form methods from (keys, v, n) rows, all in one pass over each slice.

    Rows with equal keys and grey value are added up, so copies of a tile weigh more but change no level. Between two grey values that occur nothing changes on either side, so only occurring values compete, except where the level itself enters the rule.
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("v")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    v, n = F.col("v"), F.col("n")
    log_n = n * F.log(n.cast("double"))
    bins = merged(histogram, *keys).select(
        *keys, "v", "n",
        F.sum("n").over(upto).alias("p"), F.sum("n").over(whole).alias("pt"),
        F.sum(v * n).over(upto).alias("s"), F.sum(v * n).over(whole).alias("st"),
        F.sum(log_n).over(upto).alias("e"), F.sum(log_n).over(whole).alias("et"),
        F.sum(n * n).over(upto).alias("q"), F.sum(n * n).over(whole).alias("qt"),
        F.min("v").over(whole).alias("v0"), F.max("v").over(whole).alias("v1"),
        F.max(F.struct("n", -v)).over(whole).alias("_peak"),
        F.lead("v").over(order).alias("up"), F.lag("v").over(order).alias("down"),
        F.max(F.struct("v", "n")).over(whole).alias("_last"), F.min(F.struct("v", "n")).over(whole).alias("_first"),
    )
    p, pt, s, st = F.col("p"), F.col("pt"), F.col("s"), F.col("st")
    above = pt - p
    valid = above > 0

    def fixed(score: Column) -> Column:
        return F.floor(score * RESOLUTION + 0.5)

    def first_best(score: Column, level: Column = v, ok: Column = valid) -> Column:
        return F.min(F.when(ok, F.struct(score.alias("score"), level.alias("t"))))["t"]

    # midpoint of the class means, rounded up in integers
    wide = {c: f"cast({c} as decimal(18, 0))" for c in ("p", "pt", "s", "st")}
    twice = "2 * {p} * ({pt} - {p})".format(**wide)
    sums = "{s} * ({pt} - {p}) + ({st} - {s}) * {p}".format(**wide)
    mid = F.expr(f"cast(({sums} + {twice} - 1) div nullif({twice}, 0) as int)")
    iso_level = F.greatest(v, mid)
    iso = F.coalesce(
        F.min(F.when(valid & (iso_level < F.col("up")), iso_level)), F.max(F.when(valid, F.col("up") - 1))
    )
    gap = F.expr("cast({st} * {p} - {s} * {pt} as double)".format(**wide))
    product = F.nullif(p.cast("double") * above, F.lit(0.0))
    otsu_score = -(gap * gap / product)
    rest = F.nullif(above, F.lit(0))
    entropy = F.log(p) - F.col("e") / p + F.log(rest) - (F.col("et") - F.col("e")) / rest
    yen_score = 2 * F.log(product) - F.log("q") - F.log(F.nullif(F.col("qt") - F.col("q"), F.lit(0)))
    peak, top = -F.col("_peak")["col2"], F.col("_peak")["n"]
    rising = (F.col("v1") - peak) >= (peak - F.col("v0"))
    end = F.when(rising, F.col("_last")).otherwise(F.col("_first"))
    length = F.abs(end["v"] - peak)
    inside = v.between(F.least(peak, end["v"]), F.greatest(peak, end["v"]))

    def drop(level: Column, count: Column) -> Column:
        return top * length + (end["n"] - top) * F.abs(level - peak) - count * length

    # in a gap the chord only comes closer towards the end; if it is level, the first grey value counts
    falling_level = F.when(end["n"] == top, F.col("down") + 1).otherwise(v - 1)
    gap_level = F.when(rising, v + 1).otherwise(falling_level)
    next_level = F.when(rising, F.col("up")).otherwise(F.col("down"))
    in_gap = inside & (v != end["v"]) & (F.abs(next_level - v) > 1)
    at_bin = F.when(inside, F.struct((-drop(v, n)).alias("score"), v.alias("t")))
    at_gap = F.when(in_gap, F.struct((-drop(gap_level, F.lit(0))).alias("score"), gap_level.alias("t")))

    picked = bins.groupBy(*keys).agg(
        F.min("v").alias("_only"),
        iso.alias("t_default"),
        first_best(otsu_score).alias("t_otsu"),
        F.min(F.expr("cast(st div pt as int)")).alias("t_mean"),
        first_best(F.abs(2 * p - pt)).alias("t_percentile"),
        first_best(-fixed(entropy)).alias("t_maxentropy"),
        first_best(-fixed(yen_score)).alias("t_yen"),
        F.least(F.min(at_bin), F.min(at_gap))["t"].alias("t_triangle"),
    )
    methods = [c for c in picked.columns if c.startswith("t_")]
    return picked.select(*keys, *[F.coalesce(c, "_only").cast("int").alias(c) for c in methods])
