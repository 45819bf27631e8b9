"""Registration of overlapping stacks: shifts along every axis, the graph of pairs against plain least squares, odd input."""

import numpy as np
import pytest

from helpers import frame, tile
from voxelloom.operators import stacks

PAIRS = "image_id int, zoom_out int, a string, b string, dx int, dy int, dz int, score double"


@pytest.mark.parametrize("shift", [(0, 0, 0), (1, 0, 0), (0, -2, 0), (0, 0, 3), (-3, 2, 1), (2, -3, -2)])
def test_shift_with_the_wrap_resolved(shift):
    volume = np.random.default_rng(5).integers(0, 256, (20, 20, 20), dtype=np.uint8)
    at = lambda s: volume[tuple(slice(4 + d, 14 + d) for d in s)]
    assert stacks.stack_shift(at((0, 0, 0)), at(shift)) == (shift, 1.0)


def test_flat_and_noisy_regions():
    assert stacks.stack_shift(np.zeros((4, 4, 4)), np.zeros((4, 4, 4)))[1] == -1.0
    rng = np.random.default_rng(7)
    volume = rng.normal(0, 40, (24, 24, 24))
    one, two = volume[4:20, 4:20, 4:20], volume[5:21, 2:18, 4:20] + rng.normal(0, 15, (16, 16, 16))
    found, score = stacks.stack_shift(one, two)
    assert found == (1, -2, 0) and 0.8 < score < 1
    assert stacks.stack_shift(one, rng.normal(0, 40, (16, 16, 16)))[1] < 0.5


def solved(pairs):
    """Weighted least squares by numpy, per linked part; the least name has offset 0."""
    out = {}
    names = sorted({n for p in pairs for n in (p[2], p[3])})
    part = {n: n for n in names}
    for _ in names:
        for p in pairs:
            part[p[2]] = part[p[3]] = min(part[p[2]], part[p[3]])
    for root in set(part.values()):
        own = [n for n in names if part[n] == root]
        rows = [p for p in pairs if part[p[2]] == root and p[2] != p[3]]
        matrix, right = np.zeros((len(rows) + 1, len(own))), np.zeros((len(rows) + 1, 3))
        matrix[-1, own.index(root)] = 1
        for at, p in enumerate(rows):
            w = np.sqrt(p[7])
            matrix[at, own.index(p[3])], matrix[at, own.index(p[2])] = w, -w
            right[at] = w * np.array(p[4:7])
        for n, x in zip(own, np.linalg.lstsq(matrix, right, rcond=None)[0], strict=True):
            out[n] = (root, *np.round(x, 4).tolist())
    return out


def test_offsets_are_consistent_around_cycles(spark):
    rng = np.random.default_rng(3)
    true = {f"t{i}": rng.integers(-3, 4, 3) for i in range(9)}
    pairs = [(1, 1, a, b, *(true[b] - true[a]).tolist(), 0.9) for a in true for b in true if a < b and rng.random() < 0.5]
    found = {r["name"]: (r["dx"], r["dy"], r["dz"]) for r in stacks.solve_offsets(spark.createDataFrame(pairs, PAIRS)).collect()}
    least = {n: v[0] for n, v in solved(pairs).items()}
    assert found == {n: tuple((true[n] - true[least[n]]).astype(float)) for n in found}


def test_disagreeing_cycles_are_balanced(spark):
    rng = np.random.default_rng(4)
    names = [f"t{i}" for i in range(8)]
    pairs = [(1, 1, a, b, *rng.integers(-5, 6, 3).tolist(), float(rng.uniform(0.5, 1))) for a in names for b in names if a < b and rng.random() < 0.5]
    pairs += [(1, 1, "x", "y", 2, 0, -1, 0.7), (1, 1, "x", "y", 4, 0, -1, 0.7), (1, 1, "z", "z", 1, 1, 1, 1.0)]
    got = {r["name"]: (r["root"], *(round(r[c], 4) for c in ("dx", "dy", "dz"))) for r in stacks.solve_offsets(spark.createDataFrame(pairs, PAIRS)).collect()}
    want = {n: v for n, v in solved(pairs).items() if n != "z"}
    assert got.keys() == want.keys()
    for name, (root, *offset) in want.items():
        assert got[name][0] == root and np.allclose(got[name][1:], offset, atol=2e-4)
    assert got["y"][1:] == (3.0, 0.0, -1.0)


def test_long_chains_reach_their_root(spark):
    pairs = [(1, 2, f"n{i + 1:03d}", f"n{i:03d}", 1, 0, -2, 1.0) for i in range(40)]
    found = {r["name"]: (r["root"], r["dx"], r["dz"]) for r in stacks.solve_offsets(spark.createDataFrame(pairs, PAIRS)).collect()}
    assert found == {f"n{i:03d}": ("n000", float(-i), 2.0 * i) for i in range(41)}


def test_tiles_go_to_their_places(spark):
    """Four tiles beside their places, one repeated, one flat and one alone; zooms are registered apart."""
    volume = np.random.default_rng(9).integers(0, 256, (20, 40, 40), dtype=np.uint8)
    moves = {(0, 0): (0, 0, 0), (10, 0): (2, -1, 1), (0, 10): (-1, 1, 0), (10, 10): (1, 2, -1)}
    rows = []
    for (x, y), (dx, dy, dz) in moves.items():
        z0, y0, x0 = 3 + dz, 5 + y + dy, 5 + x + dx
        rows.append(tile(volume[z0 : z0 + 14, y0 : y0 + 16, x0 : x0 + 16], (x, y, 0)))
    rows += [rows[1], tile(np.zeros((14, 16, 16)), (5, 5, 0)), tile(volume[:4, :4, :4], (100, 0, 0)), tile(volume[:14, :16, :16], (0, 0, 0), zoom_out=2)]
    found = sorted((r["zoom_out"], r["x"], r["y"], r["z"], r["name"]) for r in stacks.place_tiles(frame(spark, rows)).collect())
    origin = moves[(0, 0)]
    places = [(x + m[0] - origin[0], y + m[1] - origin[1], m[2] - origin[2]) for (x, y), m in moves.items()]
    want = [(1, *p) for p in [*places, places[1], (5, 5, 0), (100, 0, 0)]] + [(2, 0, 0, 0)]
    assert [f[:4] for f in found] == sorted(want)
    assert all(name.startswith(f"{x}-") for _, x, _, _, name in found)
    assert stacks.place_tiles(frame(spark, [])).count() == 0


def test_only_common_boxes_are_shuffled(spark):
    rows = [tile(np.zeros((4, 64, 64)), (56 * i, 0, 0)) for i in range(4)]
    df = frame(spark, rows)
    slabs = stacks._slabs(df, stacks.overlaps(df))
    assert {len(r["slab"]) for r in slabs.collect()} == {8 * 64 * 4}
    plan = slabs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
