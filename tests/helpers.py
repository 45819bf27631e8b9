"""Volumes made by hand and slow, obvious versions of the operators."""

from __future__ import annotations

import math

import numpy as np

from voxelloom.schema import TILES


def tile(stack, origin=(0, 0, 0), image_id=1, zoom_out=1, name=None):
    """One tile row from a (z, y, x) array."""
    stack = np.asarray(stack, np.uint8)
    depth, height, width = stack.shape
    x, y, z = origin
    label = name or f"{x}-{x + width}_{y}-{y + height}_{z}-{z + depth}"
    return (image_id, label, zoom_out, x, y, z, width, height, depth, bytearray(stack.tobytes()))


def frame(spark, rows):
    return spark.createDataFrame(rows, TILES)


def cut_volume(volume, dims, origin=(0, 0, 0), **kwargs):
    """Tiles of a (z, y, x) volume; border tiles may be smaller."""
    depth, height, width = volume.shape
    dx, dy, dz = dims
    return [
        tile(volume[z : z + dz, y : y + dy, x : x + dx], (origin[0] + x, origin[1] + y, origin[2] + z), **kwargs)
        for z in range(0, depth, dz)
        for y in range(0, height, dy)
        for x in range(0, width, dx)
    ]


def stack_of(row):
    return np.frombuffer(bytes(row["pixels"]), np.uint8).reshape(row["z_dim"], row["y_dim"], row["x_dim"])


def voxels_of(rows):
    """Voxel values by absolute coordinate; the greatest value wins."""
    out = {}
    for row in rows:
        for (iz, iy, ix), v in np.ndenumerate(stack_of(row)):
            key = (row["image_id"], row["x"] + ix, row["y"] + iy, row["z"] + iz)
            out[key] = max(out.get(key, 0), int(v))
    return out


def slow_weights(sigma):
    radius = math.ceil(3 * sigma)
    if radius == 0:
        return {0: 65536}
    raw = {o: math.exp(-o * o / (2 * sigma**2)) for o in range(-radius, radius + 1)}
    weights = {o: round(w / sum(raw.values()) * 65536) for o, w in raw.items()}
    weights[0] = 65536 - sum(w for o, w in weights.items() if o)
    return weights


def slow_blur(voxels, sigmas):
    """Blur {(x, y, z): v}: repeat the border of the bounding box, leave missing voxels out."""
    for axis, sigma in enumerate(sigmas):
        low = min(p[axis] for p in voxels)
        high = max(p[axis] for p in voxels)
        weights = slow_weights(sigma)
        result = {}
        for place in voxels:
            total = used = 0
            for offset, weight in weights.items():
                source = list(place)
                source[axis] = max(low, min(high, place[axis] + offset))
                if tuple(source) in voxels:
                    total += weight * voxels[tuple(source)]
                    used += weight
            result[place] = (total + used // 2) // used
        voxels = result
    return voxels


def as_voxels(stack):
    return {(x, y, z): int(v) for (z, y, x), v in np.ndenumerate(stack)}
