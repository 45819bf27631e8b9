"""Vector codes: trees hold what they say, k-means equals plain k-means, odd vectors."""

import math
from hashlib import sha256

import numpy as np
import pytest

from voxelloom.llm import vector_codes as vc


def nearest(x, book):
    away = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    return away.argmin(axis=1), away.min(axis=1)


def brute(rows, rounds=2, entries=64):
    """Plain k-means over (key, vector, label); null keys last."""
    kept = [r for r in rows if r[1] is not None and all(e is not None and math.isfinite(e) for e in r[1])]
    if not kept:
        return []
    width = max(1, -(-max(len(r[1]) for r in kept) // 16)) * 16
    x = np.array([[math.floor(256 * e) for e in r[1]] + [0] * (width - len(r[1])) for r in kept], dtype=np.int64)
    order = sorted(range(len(kept)), key=lambda at: (kept[at][0] is None, kept[at][0] or 0, kept[at][1]))[:entries]
    parts, books, codes, error = np.split(x, 16, axis=1), [], [], np.zeros(len(kept), np.int64)
    for part in parts:
        book = part[order].copy()
        for _ in range(rounds):
            own, _ = nearest(part, book)
            for entry in set(own.tolist()):
                book[entry] = part[own == entry].sum(axis=0) // (own == entry).sum()
        own, far = nearest(part, book)
        books.append(book)
        codes.append(own)
        error += far
    digest = sha256(",".join(str(v) for book in books for v in book.reshape(-1)).encode()).hexdigest()
    sums = {}
    for row, far in zip(kept, error.tolist(), strict=True):
        sums[row[2]] = sums.get(row[2], 0) + far
    texts = ["".join(f"{own[at]:02x}" for own in codes) for at in range(len(kept))]
    return sorted(((r[0], c, e, sums[r[2]], digest) for r, c, e in zip(kept, texts, error.tolist(), strict=True)), key=repr)


def found(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code int, _share int, trees string"


def made(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, "x") for row in rows], SCHEMA)


@pytest.mark.parametrize("spread", [3, 40, 100_000])
def test_trees_hold_their_points(spread):
    rng = np.random.default_rng(spread)
    parts = np.concatenate([rng.integers(-spread, spread + 1, (900, 4)), np.repeat(rng.integers(-9, 9, (1, 4)), 300, axis=0), 2 ** np.arange(40)[:, None] % (1 << 19) * np.ones((1, 4), int)])
    tree = vc.grown(parts)
    assert (tree.points[tree.member] == parts).all() and tree.weights.sum() == len(parts)
    for ball in range(len(tree.radius)):
        own = slice(tree.first[ball], tree.last[ball])
        gap = np.sqrt(((tree.points[own] - tree.pivot[ball]) ** 2).sum(axis=1))
        assert gap.max() <= tree.radius[ball] * (1 + 1e-9) + 1e-9
        assert tree.count[ball] == tree.weights[own].sum()
        assert (tree.total[ball] == (tree.points[own] * tree.weights[own, None]).sum(axis=0)).all()
        if tree.left[ball] >= 0:
            assert {tree.first[tree.left[ball]], tree.first[tree.right[ball]]} >= {tree.first[ball]}
    again = vc.unpacked(vc.packed(tree))
    assert all((a == b).all() for a, b in zip(tree, again, strict=True))


@pytest.mark.parametrize("spread", [2, 30, 5000])
def test_rounds_equal_plain_ones(spread):
    """Many ties at a small spread; balls with one owner are taken as a whole."""
    rng = np.random.default_rng(spread)
    parts, book = rng.integers(-spread, spread + 1, (3000, 4)), rng.integers(-spread, spread + 1, (64, 4))
    tree = vc.grown(parts)
    own, far = nearest(parts, book)
    entry, error = vc.assigned(tree, book)
    assert (entry == own).all() and (error == far).all()
    total, count = vc.gathered(tree, book)
    assert (count == np.bincount(own, minlength=64)).all()
    assert all((total[at] == parts[own == at].sum(axis=0)).all() for at in range(64))


def test_clusters_are_owned_by_balls():
    """Lists of candidates shrink: of well separated groups hardly a point is compared itself."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-10_000, 10_000, (64, 4))
    parts = centres[rng.integers(0, 64, 4000)] + rng.integers(-5, 6, (4000, 4))
    compared = sum(len(place) for what, place, _ in vc._owned(vc.grown(parts), centres) if what == "points")
    assert compared < 100


def test_compress_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    hot = rng.normal(size=64) / 8
    rows = [(int(i) * 3 % 1000, (hot if i % 3 == 0 else rng.normal(size=64) / 8).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 5)) for i in range(900)]
    monkeypatch.setattr(vc, "BLOCK", 100)
    for few in (vc.FEW_KEYS, 0):  # labels broadcast, and dealt
        monkeypatch.setattr(vc, "FEW_KEYS", few)
        assert found(vc.compress(made(spark, rows))) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5] * 20, 1), (1, [0.25] * 20, 1), (2, None, 1), (3, [None] * 20, 1), (4, [nan] + [0.0] * 19, 2), (5, [inf] * 20, 2),
        (6, [], None), (7, [-0.001] * 3, None), (None, [-0.5] * 40, 3), (8, [0.5] * 20, None),
    ]
    assert found(vc.compress(made(spark, rows))) == brute(rows)
    assert found(vc.compress(made(spark, [(1, [], 1), (2, [], None)]))) == brute([(1, [], 1), (2, [], None)])
    assert vc.compress(made(spark, rows).limit(0)).count() == 0
    assert vc.compress(made(spark, [(2, None, 1)])).count() == 0
    assert vc.encoded(vc.fitted(made(spark, [(1, [1e30] * 16, 1)]))).first()["error"] == 0
    with pytest.raises(ValueError):
        vc.fitted(made(spark, rows), entries=65)
