"""Places of overlapping tiles, found by their content.

Tiles of one image lie about where their boxes say. Every two whose boxes overlap are compared over the common box by phase
correlation in three dimensions; which way round a cyclic shift goes is settled by the correlation of the voxels that really meet.
The shifts of all pairs make a graph that is solved for one offset per tile: along a spanning forest first, then, where
cycles disagree, by weighted least squares. Payloads are cut to common boxes before they are shuffled, and the graph never
leaves the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.functions.batches import binary_column, ints, payload_view
from voxelloom.functions.names import name_of_box
from voxelloom.operators.blocks import cut
from voxelloom.operators.boxjoin import box_join
from voxelloom.operators.registration import WEAK
from voxelloom.schema import AXES, BOX, DIMS, EXTENT, ORIGIN, VOLUME
from voxelloom.session import reliable_checkpoint

#: Shortest side of a common box that is compared.
LEAST_SIDE = 4
#: Least correlation of a shift that is believed.
LEAST_SCORE = 0.5
#: Share of the common box's side that a shift may have.
LARGEST_SHIFT = 0.5
#: Peaks of the phase correlation that are tried.
PEAKS = 3
#: Tiles whose pairs are sent to where the payloads are.
BROADCAST_TILES = 500_000
#: Rounds of the least-squares solution, and the change in voxels at which it ends.
ROUNDS, ENOUGH = 200, 1e-9

_REGION = ["rx", "ry", "rz", "rw", "rh", "rd"]
_OFFSET = ["dx", "dy", "dz"]


def score(fixed: np.ndarray, moving: np.ndarray, shift: tuple[int, ...]) -> float:
    """Correlation of ``moving[p]`` with ``fixed[p + shift]`` over the voxels that both have; -1 where there is no contrast."""
    ours = tuple(slice(max(0, s), n + min(0, s)) for s, n in zip(shift, fixed.shape, strict=True))
    theirs = tuple(slice(max(0, -s), n - max(0, s)) for s, n in zip(shift, fixed.shape, strict=True))
    a, b = fixed[ours].ravel(), moving[theirs].ravel()
    a, b = a - a.mean(), b - b.mean()
    power = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / power) if power > WEAK else -1.0


def stack_shift(fixed: np.ndarray, moving: np.ndarray) -> tuple[tuple[int, ...], float]:
    """The shift s, in the axes of the arrays, for which ``moving[p]`` is ``fixed[p + s]``, and its correlation.

    Of equal correlations the smallest shift wins.
    """
    fixed, moving = fixed.astype(np.float64), moving.astype(np.float64)
    cross = np.conj(np.fft.fftn(moving - moving.mean())) * np.fft.fftn(fixed - fixed.mean())
    strength = np.abs(cross)
    surface = np.fft.ifftn(np.where(strength > WEAK, cross / np.maximum(strength, WEAK), 0)).real
    tried: set[tuple[int, ...]] = {(0,) * fixed.ndim}
    for peak in np.argsort(-np.round(surface, 6), axis=None, kind="stable")[:PEAKS]:
        place = np.unravel_index(peak, surface.shape)
        ways = [[s for s in {int(p), int(p) - n} if abs(s) <= LARGEST_SHIFT * n] for p, n in zip(place, surface.shape, strict=True)]
        tried.update(product(*ways))
    found = [(round(score(fixed, moving, s), 9), [-abs(x) for x in s], s) for s in tried]
    best = max(found)
    return best[2], best[0]


def overlaps(tiles: DataFrame, least_side: int = LEAST_SIDE) -> DataFrame:
    """Pairs of tiles of one image and zoom whose boxes overlap, by boxes only: box of a, box of b (``b_``) and the common box."""
    boxes = tiles.select(*VOLUME, *BOX).distinct()
    asked = boxes.withColumnsRenamed(dict(zip(DIMS, EXTENT, strict=True)))
    pairs = box_join(boxes, asked)
    other = dict(zip([f"roi_{c}" for c in ORIGIN] + list(EXTENT), [f"b_{c}" for c in BOX], strict=True))
    pairs = pairs.withColumnsRenamed(other).where(F.struct(*BOX) < F.struct(*[f"b_{c}" for c in BOX]))
    for axis, low, size in zip(AXES, _REGION[:3], _REGION[3:], strict=True):
        pairs = pairs.withColumn(low, F.greatest(axis, f"b_{axis}"))
        end = F.least(F.col(axis) + F.col(f"{axis}_dim"), F.col(f"b_{axis}") + F.col(f"b_{axis}_dim"))
        pairs = pairs.withColumn(size, end - F.col(low)).where(F.col(size) >= least_side)
    return pairs


def _slabs(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both tiles' voxels of every common box."""
    both = [f"b_{c}" for c in BOX]
    mine = F.struct(F.lit(False).alias("second"), *both, *_REGION).alias("pair")
    theirs = F.struct(F.lit(True).alias("second"), *[F.col(c).alias(f"b_{c}") for c in BOX], *_REGION).alias("pair")
    sides = pairs.select(*VOLUME, *BOX, mine).unionByName(pairs.select(*VOLUME, *[F.col(f"b_{c}").alias(c) for c in BOX], theirs))
    wanted = reliable_checkpoint(sides.groupBy(*VOLUME, *BOX).agg(F.collect_list("pair").alias("pairs")))  # as many as tiles overlap
    few = wanted.limit(BROADCAST_TILES + 1).count() <= BROADCAST_TILES
    rows = tiles.select(*VOLUME, *BOX, "pixels").join(F.broadcast(wanted) if few else wanted, [*VOLUME, *BOX])
    names = [*VOLUME, *BOX, *both, *_REGION]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = payload_view(batch.column("pixels"))
            volume, boxes = ints(batch, VOLUME), ints(batch, BOX)
            for r in range(batch.num_rows):
                stack = data[starts[r] : starts[r + 1]].reshape(boxes[r, :2:-1])
                heads, slabs, second = [], [], []
                for pair in batch.column("pairs")[r].as_py():
                    region = np.array([pair[c] for c in _REGION])
                    own, other = boxes[r].tolist(), [pair[c] for c in both]
                    heads.append([*volume[r].tolist(), *(other + own if pair["second"] else own + other), *region.tolist()])
                    second.append(pair["second"])
                    slabs.append(np.ascontiguousarray(cut(stack, boxes[r, :3], region[:3], region[:3] + region[3:])).reshape(-1))
                columns = [pa.array(c, pa.int32()) for c in zip(*heads, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(second), binary_column(slabs)], names=[*names, "second", "slab"])

    fields = ", ".join(f"{c} int" for c in names)
    return rows.mapInArrow(run, f"{fields}, second boolean, slab binary")


def register_stacks(tiles: DataFrame, least_side: int = LEAST_SIDE, least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per pair of overlapping tiles: image_id, zoom_out, a and b (names of their boxes), dx, dy, dz and the correlation.

    The content of b lies (dx, dy, dz) further than its box says, as seen from a. Pairs without a shift that correlates are left
    out. Of several tiles with one box the greatest voxels, byte by byte, are used.
    """
    both = [f"b_{c}" for c in BOX]
    keys = [*VOLUME, *BOX, *both, *_REGION]
    slabs = _slabs(tiles, reliable_checkpoint(overlaps(tiles, least_side)))
    paired = slabs.groupBy(*keys).agg(
        F.max(F.when(~F.col("second"), F.col("slab"))).alias("one"), F.max(F.when(F.col("second"), F.col("slab"))).alias("two")
    )
    named = paired.select(*VOLUME, name_of_box().alias("a"), name_of_box("b_").alias("b"), *_REGION[3:], "one", "two")

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = ints(batch, _REGION[:2:-1])
            (one, one_at), (two, two_at) = payload_view(batch.column("one")), payload_view(batch.column("two"))
            found = [
                stack_shift(one[one_at[r] : one_at[r + 1]].reshape(size[r]), two[two_at[r] : two_at[r + 1]].reshape(size[r]))
                for r in range(batch.num_rows)
            ]
            shifts = [pa.array([s[axis] for s, _ in found], pa.int32()) for axis in (2, 1, 0)]
            heads = [batch.column(c) for c in (*VOLUME, "a", "b")]
            yield pa.RecordBatch.from_arrays([*heads, *shifts, pa.array([v for _, v in found], pa.float64())], names=[*VOLUME, "a", "b", *_OFFSET, "score"])

    schema = "image_id int, zoom_out int, a string, b string, dx int, dy int, dz int, score double"
    return named.mapInArrow(correlate, schema).where(F.col("score") >= least_score)


def solve_offsets(pairs: DataFrame, tolerance: float = ENOUGH, rounds: int = ROUNDS) -> DataFrame:
    """image_id, zoom_out, name, root, dx, dy, dz: the offset of every tile of a pair, that of the least name it is linked to being 0.

    Where the shifts around a cycle do not add up to nothing, the offsets have the least sum of squared errors, each weighted by the
    pair's correlation.
    """
    weight = F.col("score").alias("w")
    one = pairs.select(*VOLUME, F.col("a").alias("u"), F.col("b").alias("v"), *[F.col(c).cast("double").alias(c) for c in _OFFSET], weight)
    two = pairs.select(*VOLUME, F.col("b").alias("u"), F.col("a").alias("v"), *[(-F.col(c)).cast("double").alias(c) for c in _OFFSET], weight)
    edges = reliable_checkpoint(one.unionByName(two).where("u <> v"))
    start = edges.select(*VOLUME, "u").distinct().withColumn("root", F.col("u"))
    state = reliable_checkpoint(_spread(edges, start.select("*", *[F.lit(0.0).alias(c) for c in _OFFSET])))
    return _refined(edges, state, tolerance, rounds).select(*VOLUME, F.col("u").alias("name"), "root", *[(F.round(c, 6) + 0.0).alias(c) for c in _OFFSET])


def _spread(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Every tile takes the least root among its neighbours', and its place from there, until none changes: a spanning forest."""
    while True:
        moved = edges.withColumnsRenamed({c: f"_{c}" for c in _OFFSET}).join(state, [*VOLUME, "u"])
        reached = moved.groupBy(*VOLUME, F.col("v").alias("u")).agg(F.min(F.struct("root", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in _OFFSET])).alias("new"))
        nearer = F.col("new.root") < F.col("root")
        joined = state.join(reached, [*VOLUME, "u"], "left")
        kept = [F.when(nearer, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("root", *_OFFSET)]
        after = reliable_checkpoint(joined.select(*VOLUME, "u", *kept, F.coalesce(nearer, F.lit(False)).alias("moved")))
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            return state


def _pull(edges: DataFrame, values: DataFrame, columns: list[str], shifts: bool) -> DataFrame:
    """Per tile the weighted sum of what its neighbours say of it, less what it says itself: the residual, or minus the Laplacian."""
    ends = values.select(*VOLUME, "u", *columns)
    there = ends.withColumnsRenamed({"u": "v", **{c: f"v_{c}" for c in columns}})
    here = edges.withColumnsRenamed({c: f"_{c}" for c in _OFFSET}).join(ends, [*VOLUME, "u"]).join(there, [*VOLUME, "v"])
    sums = []
    for c, d in zip(columns, _OFFSET, strict=True):
        said = F.col(f"v_{c}") - (F.col(f"_{d}") if shifts else F.lit(0.0))
        sums.append(F.sum(F.col("w") * (said - F.col(c))).alias(f"pull_{d}"))
    return here.groupBy(*VOLUME, "u").agg(*sums)


def _refined(edges: DataFrame, state: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    """Conjugate gradients from the forest's offsets, all tiles and the three axes side by side."""
    r, p = [f"r_{c}" for c in _OFFSET], [f"p_{c}" for c in _OFFSET]
    pulled = _pull(edges, state, _OFFSET, True)
    rows = state.join(pulled, [*VOLUME, "u"])
    rows = rows.withColumns({a: F.col(f"pull_{c}") for a, c in zip(r, _OFFSET, strict=True)} | {a: F.col(f"pull_{c}") for a, c in zip(p, _OFFSET, strict=True)})
    rows = reliable_checkpoint(rows.drop(*[f"pull_{c}" for c in _OFFSET]))
    old = rows.agg(*[F.sum(F.col(a) * F.col(a)) for a in r]).first()
    for _ in range(rounds):
        if not any(value and value > tolerance**2 for value in old):
            break
        drawn = _pull(edges, rows, p, False)
        rows = reliable_checkpoint(rows.join(drawn, [*VOLUME, "u"]))
        bend = rows.agg(*[F.sum(-F.col(a) * F.col(f"pull_{c}")) for a, c in zip(p, _OFFSET, strict=True)]).first()
        step = [value / b if value > tolerance**2 and b > 0 else 0.0 for value, b in zip(old, bend, strict=True)]
        rows = rows.withColumns(
            {c: F.col(c) + s * F.col(a) for c, a, s in zip(_OFFSET, p, step, strict=True)}
            | {a: F.col(a) + s * F.col(f"pull_{c}") for c, a, s in zip(_OFFSET, r, step, strict=True)}
        )
        new = rows.agg(*[F.sum(F.col(a) * F.col(a)) for a in r]).first()
        turn = [n / value if value > tolerance**2 else 0.0 for n, value in zip(new, old, strict=True)]
        rows = rows.withColumns({b: F.col(a) + t * F.col(b) for a, b, t in zip(r, p, turn, strict=True)})
        rows = reliable_checkpoint(rows.drop(*[f"pull_{c}" for c in _OFFSET]))
        old = new
    fixed = rows.where("u = root").select(*VOLUME, "root", *[F.col(c).alias(f"_{c}") for c in _OFFSET])
    return rows.join(fixed, [*VOLUME, "root"]).select(*VOLUME, "u", "root", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in _OFFSET])


def place_tiles(tiles: DataFrame) -> DataFrame:
    """The tiles moved to where their content lies, to whole voxels; tiles linked to no other stay. Payloads are not shuffled while
    the offsets can be broadcast."""
    offsets = reliable_checkpoint(solve_offsets(register_stacks(tiles)))
    few = offsets.limit(BROADCAST_TILES + 1).count() <= BROADCAST_TILES
    found = offsets.select(*VOLUME, F.col("name").alias("_box"), *_OFFSET)
    rows = tiles.withColumn("_box", name_of_box()).join(F.broadcast(found) if few else found, [*VOLUME, "_box"], "left")
    moved = [(F.col(a) + F.coalesce(F.round(d), F.lit(0.0))).cast("int").alias(a) for a, d in zip(AXES, _OFFSET, strict=True)]
    placed = rows.select(*[c for c in tiles.columns if c not in (*AXES, "name")], *moved)
    return placed.withColumn("name", name_of_box()).select(*tiles.columns)
