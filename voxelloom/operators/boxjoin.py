"""Three-dimensional box join as an equi-join on grid cells.

Both sides are spread over the cells they touch and joined on the cell; a pair is kept only in the cell
that holds the lower corner of its intersection, so it comes out once. Boxes much larger than a cell live
on a coarser level, where a cell is twice as long per axis for each level, so that the number of cells a
box touches is bounded whatever its size. A pair meets on the coarser of its two levels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.operators.copies import collapse_copies, restore_copies
from voxelloom.schema import AXES, DIMS, EXTENT, ORIGIN, VOLUME

# Cell lengths a request, and a tile, may span per axis before it moves to a coarser level.
SPAN = 16
TILE_SPAN = 1
# Request cells that may be sent to every executor (about 100 bytes each).
BROADCAST_CELLS = 1_000_000
# Rows of one side that may share a cell before the cell is split.
HOT_ROWS = 50_000
# Upper bound for the number of keys that are treated as hot on one side (about 100 bytes each).
HOT_KEYS = 100_000

_CELL = ["_level", "_cx", "_cy", "_cz"]


@dataclass(frozen=True)
class Grid:
    cell: tuple[int, int, int]
    tile_level: int
    request_level: int
    tile_rows: int
    tile_voxels: int
    request_cells: int

    def strategy(self) -> str:
        """Send the requests out if they are few, else shuffle both sides."""
        return "broadcast" if self.request_cells <= BROADCAST_CELLS else "shuffle"


def _level_sql(extents: list[str], cell: tuple[int, int, int], span: int) -> str:
    """Smallest level on which no extent is longer than ``span`` cells."""
    needed = "greatest(1L, " + ", ".join(f"ceil({e} / {span * g})" for e, g in zip(extents, cell)) + ")"
    return f"if({needed} <= 1, 0, length(bin({needed} - 1)))"


def _cell_sql(place: str, base: int) -> str:
    """Cell of a coordinate on the row's level."""
    return f"floor(({place}) / ({base}L * shiftleft(1L, _level)))"


def _level(extents: list[int], cell: tuple[int, int, int], span: int) -> int:
    """:func:`_level_sql` for plain numbers."""
    return (max(1, *(-(-e // (span * g)) for e, g in zip(extents, cell))) - 1).bit_length()


def measure(tiles: DataFrame, requests: DataFrame, cell: tuple[int, int, int] | None = None) -> Grid:
    """Choose the cell and find the sizes of both sides by one small aggregate over the metadata of each."""
    middle = [f"percentile_approx({c}, 0.5)" for c in DIMS]
    longest = [f"max({c})" for c in DIMS]
    count, *dims = tiles.selectExpr("count(1)", *middle, *longest).first()
    dims = [max(1, d or 1) for d in dims]
    cell = tuple(cell or dims[:3])

    # a box of length e touches at most e / g + 2 cells, and at most SPAN + 2 on its own level
    cells = " * ".join(f"least({SPAN + 2}D, greatest(0, {e}) / {g} + 2)" for e, g in zip(EXTENT, cell))
    longest = [f"max({e})" for e in EXTENT]
    request_cells, *extents = requests.selectExpr(f"cast(sum({cells}) as long)", *longest).first()

    tile_level = _level(dims[3:], cell, TILE_SPAN)
    request_level = _level([e or 1 for e in extents], cell, SPAN)
    # a request is repeated on every coarser level that tiles use, on fewer cells each time
    request_cells = (request_cells or 0) * (1 + tile_level)
    return Grid(cell, tile_level, request_level, count, math.prod(dims[3:]), request_cells)


def _spread(df: DataFrame, corners: list[tuple[str, str]], own: str, level: str, grid: Grid, other: int) -> DataFrame:
    """One row per touched cell on the own level and on every coarser level used by the other side."""
    spread = df.selectExpr("*", f"{level} as {own}")
    spread = spread.selectExpr("*", f"explode(sequence({own}, greatest({own}, {other}))) as _level")
    for axis, g, (low, high) in zip(AXES, grid.cell, corners):
        cells = f"sequence({_cell_sql(low, g)}, {_cell_sql(high, g)})"
        spread = spread.selectExpr("*", f"explode({cells}) as _c{axis}")
    return spread


def split_hot(
    left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int, right_by: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add join columns ``_a``/``_b`` that deal the rows of crowded keys out over several tasks.

    A key with n left and m right rows becomes ceil(n/hot) * ceil(m/hot) buckets: each row picks its share
    on its own side by a hash of its other columns (or of ``right_by``) and is repeated over the shares of the
    other side, so every pair meets once. The tables of crowded keys are sent to all tasks: the caller chooses
    ``hot_rows`` so that neither side can have more than ``HOT_KEYS`` of them.
    """
    shares = F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")
    crowded = []
    for side, name in ((left, "_fa"), (right, "_fb")):
        sizes = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        crowded.append(sizes.select(*keys, shares.alias(name)))
    one = F.lit(1)

    def deal(side: DataFrame, by: list[str], own: str, own_share: str, other: str, other_share: str) -> DataFrame:
        marked = side
        for found in crowded:
            marked = marked.join(F.broadcast(found), keys, "left")
        marked = marked.withColumn(own_share, F.pmod(F.xxhash64(*by), F.coalesce(own, one)).cast("int"))
        repeats = F.sequence(F.lit(0), F.coalesce(other, one) - 1)
        return marked.withColumn(other_share, F.explode(repeats)).drop("_fa", "_fb")

    left_by = [c for c in left.columns if c not in keys]
    right_by = right_by or [c for c in right.columns if c not in keys]
    return deal(left, left_by, "_fa", "_a", "_fb", "_b"), deal(right, right_by, "_fb", "_b", "_fa", "_a")


def hot_limit(hot_rows: int, *sizes: int) -> int:
    """Rows a key may have before it is split, such that at most ``HOT_KEYS`` keys are."""
    return max(hot_rows, *[size // HOT_KEYS for size in sizes])


def box_join(
    tiles: DataFrame,
    requests: DataFrame,
    touching: bool = False,
    strategy: str = "auto",
    grid: Grid | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All (request, tile) pairs of the same image and zoom whose boxes share a voxel.

    With ``touching`` boxes that only share a face count as well. ``strategy`` is ``broadcast`` (request
    cells are sent out, tiles are not shuffled), ``shuffle`` (both sides are shuffled by cell, crowded cells
    are split) or ``auto``, which broadcasts when the measured number of request cells is small.
    Request origins come out as ``roi_x``, ``roi_y``, ``roi_z``; all other columns keep their names.
    """
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError(f"unknown strategy {strategy!r}")
    grid = grid or measure(tiles, requests)
    if strategy == "auto":
        strategy = grid.strategy()
    if strategy == "broadcast" and grid.request_cells > BROADCAST_CELLS:
        raise ValueError(f"{grid.request_cells} request cells are too many to broadcast")

    extra = 0 if touching else 1
    asked = requests.select(*[F.col(c).alias(f"roi_{c}") if c in ORIGIN else F.col(c) for c in requests.columns])
    if strategy == "shuffle":
        tiles = collapse_copies(tiles)

    tile_low = [f"cast({a} as long)" for a in AXES]
    roi_low = [f"cast(roi_{a} as long)" for a in AXES]
    tile_corners = [(lo, f"{lo} + greatest({d} - {extra}, 0)") for lo, d in zip(tile_low, DIMS)]
    roi_corners = [(lo, f"{lo} + greatest({e} - {extra}, 0)") for lo, e in zip(roi_low, EXTENT)]
    tile_level, roi_level = _level_sql(DIMS, grid.cell, TILE_SPAN), _level_sql(EXTENT, grid.cell, SPAN)
    left = _spread(tiles, tile_corners, "_tile_level", tile_level, grid, grid.request_level)
    right = _spread(asked, roi_corners, "_roi_level", roi_level, grid, grid.tile_level)

    keys = [*VOLUME, *_CELL]
    if strategy == "broadcast":
        joined = left.join(F.broadcast(right), keys)
    else:
        spread_rows = grid.tile_rows * 8 * (1 + grid.request_level) + grid.request_cells
        left, right = split_hot(left, right, keys, hot_limit(hot_rows, spread_rows))
        # sizes are guessed from files, before rows are spread over cells: without the hint Spark would send out either side whole
        joined = left.join(right.hint("merge"), [*keys, "_a", "_b"]).drop("_a", "_b")

    tests = ["_level = greatest(_tile_level, _roi_level)"]
    low, high = (">=", "<=") if touching else (">", "<")
    for axis, g, t, r, dim, extent in zip(AXES, grid.cell, tile_low, roi_low, DIMS, EXTENT):
        tests.append(f"{_cell_sql(f'greatest({t}, {r})', g)} = _c{axis}")
        tests.append(f"{t} {low} {r} - {dim} and {t} {high} {r} + {extent}")
    pairs = joined.where(" and ".join(tests)).drop(*_CELL, "_tile_level", "_roi_level")
    return restore_copies(pairs) if strategy == "shuffle" else pairs
