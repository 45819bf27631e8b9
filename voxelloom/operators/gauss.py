"""Gaussian blur in fixed-point arithmetic, tile by tile.

Weights are integers summing to 65536 and every axis pass rounds half up, so results do not depend on the
order of summation. Passes run along x, then y, then z; the border value is repeated at the tile's edge.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from voxelloom.functions.batches import map_payloads

ONE = 1 << 16
# Units of 1 / 65536 that the centre weight may be off by.
CENTRE_UNITS = 4
# Longest axis that is blurred by a matrix product.
MATRIX_SIZE = 1024
# Voxels blurred at once.
BLOCK_VOXELS = 1 << 18
Z, Y, X = 1, 2, 3


def kernel_weights(sigma: float) -> list[int]:
    """Integer weights for offsets 0..radius.

    The centre takes what rounding leaves over, up to ``CENTRE_UNITS``; more of it, as wide kernels have it, goes to the
    offsets that lost most by rounding, in pairs.
    """
    if sigma < 0 or not math.isfinite(sigma):
        raise ValueError(f"sigma must be finite and not negative, got {sigma}")
    radius = math.ceil(3 * sigma)
    raw = [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(radius + 1)] if radius else [1.0]
    total = raw[0] + 2 * sum(raw[1:])
    ideal = [w / total * ONE for w in raw]
    side = [round(w) for w in ideal[1:]]
    left = ONE - 2 * sum(side) - round(ideal[0])
    step = 1 if left > 0 else -1
    losses = sorted(range(len(side)), key=lambda o: (step * (side[o] - ideal[o + 1]), step * o))
    for o in losses[: max(0, abs(left) - CENTRE_UNITS + 1) // 2]:
        side[o] += step
    return [ONE - 2 * sum(side), *side]


@lru_cache(maxsize=64)
def _weight_matrix(weights: tuple[int, ...], size: int) -> np.ndarray:
    """Row i holds the weight of every source for output i; offsets beyond the border add to the border."""
    matrix = np.zeros((size, size), np.float32)
    rows = np.arange(size)
    for offset in range(1 - len(weights), len(weights)):
        np.add.at(matrix, (rows, np.clip(rows + offset, 0, size - 1)), weights[abs(offset)])
    return matrix


def _matrix_sum(values: np.ndarray, weights: list[int], axis: int) -> np.ndarray:
    """:func:`weighted_sum` as a matrix product.

    Single precision is exact here: every partial sum is an integer of at most 255 * 65536, below 2**24.
    """
    matrix = _weight_matrix(tuple(weights), values.shape[axis])
    axis %= values.ndim
    values = values.astype(np.float32, copy=False)
    if axis == values.ndim - 1:
        return (values.reshape(-1, values.shape[-1]) @ matrix.T).reshape(values.shape)
    lines = values.reshape(*values.shape[: axis + 1], -1)
    return (matrix @ lines).reshape(values.shape)


def _shifted_sum(values: np.ndarray, weights: list[int], axis: int) -> np.ndarray:
    """:func:`weighted_sum` by shifted additions, for axes too long for a matrix."""
    radius = len(weights) - 1
    size = values.shape[axis]
    pad = [(0, 0)] * values.ndim
    pad[axis] = (radius, radius)
    wide = np.pad(values.astype(np.float32, copy=False), pad, mode="edge")

    def shifted(offset: int) -> np.ndarray:
        window = [slice(None)] * values.ndim
        window[axis] = slice(radius + offset, radius + offset + size)
        return wide[tuple(window)]

    total = shifted(0) * np.float32(weights[0])
    for offset, weight in enumerate(weights[1:], 1):
        total += (shifted(-offset) + shifted(offset)) * np.float32(weight)
    return total


def weighted_sum(values: np.ndarray, weights: list[int], axis: int) -> np.ndarray:
    """Sum of weighted neighbours along one axis with repeated border values: whole numbers as float32."""
    return (_matrix_sum if values.shape[axis] <= MATRIX_SIZE else _shifted_sum)(values, weights, axis)


def blur_axis(stack: np.ndarray, weights: list[int], axis: int) -> np.ndarray:
    """One pass, in blocks along the longest other axis, so that a large tile needs little extra memory."""
    along = max((a for a in range(stack.ndim) if a != axis), key=lambda a: stack.shape[a])
    step = max(1, BLOCK_VOXELS * stack.shape[along] // stack.size)
    out = np.empty(stack.shape, np.uint8)
    block = [slice(None)] * stack.ndim
    for first in range(0, stack.shape[along], step):
        block[along] = slice(first, first + step)
        total = weighted_sum(stack[tuple(block)], weights, axis)
        total += ONE // 2
        total *= 1 / ONE
        # whole numbers below 256 after truncation
        out[tuple(block)] = total.astype(np.uint8)
    return out


def blur(stack: np.ndarray, sigmas: tuple[float, float, float]) -> np.ndarray:
    """Blur uint8 stacks of shape (n, z, y, x) with one sigma per axis x, y, z."""
    for axis, sigma in zip((X, Y, Z), sigmas):
        weights = kernel_weights(sigma)
        if len(weights) > 1:
            stack = blur_axis(stack, weights, axis)
    return stack


def blur_strip(stack: np.ndarray, sigma_x: float, sigma_y: float) -> np.ndarray:
    """Blur the slices as one tall 2-D strip: rows mix across slice borders, z is not blurred."""
    n, depth, height, width = stack.shape
    strip = stack.reshape(n, 1, depth * height, width)
    return blur(strip, (sigma_x, sigma_y, 0.0)).reshape(stack.shape)


def gauss3d_tile(
    tiles: DataFrame, sigma_x: float = 1.0, sigma_y: float = 1.0, sigma_z: float = 1.0
) -> DataFrame:
    """Blur each tile in isolation; a narrow step."""
    sigmas = (sigma_x, sigma_y, sigma_z)
    return tiles.mapInArrow(map_payloads(lambda s: blur(s, sigmas)), tiles.schema)


def gauss3d_iso(tiles: DataFrame, sigma: float = 1.0) -> DataFrame:
    """The same sigma on all three axes."""
    return gauss3d_tile(tiles, sigma, sigma, sigma)


def gauss_strip2d(tiles: DataFrame, sigma_x: float = 1.0, sigma_y: float = 1.0) -> DataFrame:
    """Blur each tile's slice strip as a plane image."""
    return tiles.mapInArrow(map_payloads(lambda s: blur_strip(s, sigma_x, sigma_y)), tiles.schema)
