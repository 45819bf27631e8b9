"""Codes of vectors: a codebook per part of a vector, fitted by exact k-means over anchors hierarchies.

Vectors are worked off in blocks. Within a block, and for each part position, equal parts are one point with a weight, and the
points make a metric tree by the anchors hierarchy, middle-out: about the square root of their number of anchors is chosen, each
the point farthest from the anchor that holds it, and takes over what lies nearer to it; anchors are merged upwards, the pair
with the smallest common ball first, and divided downwards by the same method. Every ball caches how many parts it holds
and their sum. The trees are stored once and read in each round.

A round goes down the trees with lists of candidate entries. A ball inherits its parent's list, the candidate nearest to its
pivot rules out every other one whose bisecting plane lies beyond the ball, and a ball that is left with one candidate is owned as
a whole: its cached sum and count go to that entry. Only in a leaf are points compared, and only with the leaf's
candidates. All sums and distances of points are whole numbers; the bounds of balls have a margin for rounding, so nothing is
ruled out that could win or tie.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.common import FEW_KEYS, dealt_join, kind, schema, scratch_folder

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Whole components are held within this, so that every sum of squares fits in 64 bits.
LARGEST = 1 << 20
#: Vectors of a block.
BLOCK = 8192
#: Bytes of components that a block holds at most, however long vectors are.
BLOCK_BYTES = 16 << 20
#: Points of a leaf.
LEAF = 24
#: Bounds of balls are widened by this share, far more than rounding can move them.
MARGIN = 1e-9


class Tree(NamedTuple):
    """Balls over points that stand in the order of the tree; a ball holds the points [first, last)."""

    points: np.ndarray  # (n, width) whole numbers, all different
    weights: np.ndarray  # (n,) equal parts of each
    member: np.ndarray  # point of each vector of the block
    pivot: np.ndarray  # (balls, width)
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray  # children, -1 for leaves
    right: np.ndarray
    count: np.ndarray  # parts within
    total: np.ndarray  # (balls, width), their sum


def _gap(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    away = points - pivot
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def anchors(points: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors (rows of ``points``) and the anchor that each point belongs to, its nearest.

    A new anchor is the point farthest from its own one. A point nearer to its anchor than half the way between both anchors
    cannot change sides and is not measured.
    """
    chosen = [0]
    owner = np.zeros(len(points), dtype=np.int64)
    away = _gap(points, points[0])
    while len(chosen) < many:
        fresh = int(away.argmax())
        if away[fresh] == 0:
            break
        half = _gap(points[chosen], points[fresh]) * 0.5
        asked = np.flatnonzero(away > half[owner])
        near = _gap(points[asked], points[fresh])
        taken = near < away[asked]
        owner[asked[taken]] = len(chosen)
        away[asked[taken]] = near[taken]
        chosen.append(fresh)
    return np.array(chosen), owner


class _Build:
    """Balls of one tree as they come up."""

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        self.points, self.weights = points, weights
        self.pivot: list[np.ndarray] = []
        self.radius: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.held: list[np.ndarray | None] = []

    def ball(self, pivot: np.ndarray, radius: float, left: int = -1, right: int = -1, held: np.ndarray | None = None) -> int:
        for column, value in ((self.pivot, pivot), (self.radius, radius), (self.left, left), (self.right, right), (self.held, held)):
            column.append(value)
        return len(self.pivot) - 1

    def subtree(self, rows: np.ndarray) -> int:
        """The ball of these points, divided where they are many."""
        own = self.points[rows]
        if len(rows) <= LEAF:
            pivot = own.mean(axis=0)
            return self.ball(pivot, float(_gap(own, pivot).max()), held=rows)
        chosen, owner = anchors(own, int(np.ceil(np.sqrt(len(rows)))))
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(chosen) + 1))
        return self.merged([self.subtree(rows[order[a:b]]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])

    def merged(self, balls: list[int]) -> int:
        """Merge the two balls that fit in the smallest ball until one is left."""
        many = len(balls)
        pivot = np.array([self.pivot[b] for b in balls])
        radius = np.array([self.radius[b] for b in balls])
        gap = np.sqrt(((pivot[:, None] - pivot[None]) ** 2).sum(axis=2))
        both = np.maximum((gap + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
        np.fill_diagonal(both, np.inf)
        number = list(balls)
        for _ in range(many - 1):
            a, b = divmod(int(both.argmin()), many)
            apart = _gap(pivot[a : a + 1], pivot[b])[0]
            if apart + radius[b] <= radius[a]:
                middle, wide = pivot[a], radius[a]
            elif apart + radius[a] <= radius[b]:
                middle, wide = pivot[b], radius[b]
            else:
                wide = (apart + radius[a] + radius[b]) / 2
                middle = pivot[a] + (pivot[b] - pivot[a]) * ((wide - radius[a]) / apart)
            wide *= 1 + MARGIN
            number[a] = self.ball(middle, wide, number[a], number[b])
            pivot[a], radius[a] = middle, wide
            both[b] = both[:, b] = np.inf
            left = np.isfinite(both[a])
            left[a] = False
            to = np.maximum((_gap(pivot, middle) + radius + wide) / 2, np.maximum(radius, wide))
            both[a, left] = to[left]
            both[left, a] = to[left]
        return number[a] if many > 1 else number[0]


def grown(parts: np.ndarray) -> Tree:
    """The tree of the parts (rows of whole numbers), at least one."""
    points, member, weights = np.unique(parts, axis=0, return_inverse=True, return_counts=True)
    build = _Build(points.astype(np.float64), weights)
    root = build.subtree(np.arange(len(points)))
    # parents come after their children; number them from the root down, each ball's points side by side
    many = len(build.pivot)
    size = np.array([0 if held is None else len(held) for held in build.held])
    for ball in range(many):
        if build.left[ball] >= 0:
            size[ball] = size[build.left[ball]] + size[build.right[ball]]
    first = np.zeros(many, dtype=np.int64)
    for ball in range(root, -1, -1):
        if build.left[ball] >= 0:
            first[build.left[ball]] = first[ball]
            first[build.right[ball]] = first[ball] + size[build.left[ball]]
    order = np.empty(len(points), dtype=np.int64)
    for ball, held in enumerate(build.held):
        if held is not None:
            order[first[ball] : first[ball] + len(held)] = held
    place = np.empty(len(points), dtype=np.int64)
    place[order] = np.arange(len(points))
    points, weights = points[order], weights[order]
    last = first + size
    upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points * weights[:, None], axis=0)])
    counts = np.concatenate([[0], np.cumsum(weights)])
    return Tree(
        points, weights, place[member.reshape(-1)], np.array(build.pivot).reshape(many, -1), np.array(build.radius), first, last,
        np.array(build.left), np.array(build.right), counts[last] - counts[first], upto[last] - upto[first],
    )


def _nearest(place: np.ndarray, entry: np.ndarray, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of points and candidate entries, sorted by both: the nearest entry of each point, the lowest of equal ones, and the
    squared distance."""
    away = points[place] - book[entry]
    rank = np.einsum("ij,ij->i", away, away) * ENTRIES + entry
    best = np.minimum.reduceat(rank, np.flatnonzero(np.diff(place, prepend=-1)))
    return best % ENTRIES, best // ENTRIES


def _owned(tree: Tree, book: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("balls", balls, owners) for balls with one owner, and ("points", points, owners) for the points of mixed leaves."""
    ball = np.full(len(book), len(tree.radius) - 1)  # the root is the last ball
    entry = np.arange(len(book))
    exact = book.astype(np.float64)
    between = np.sqrt(((exact[:, None] - exact[None]) ** 2).sum(axis=2))
    while len(ball):
        start = np.flatnonzero(np.diff(ball, prepend=-1))
        away = tree.pivot[ball] - exact[entry]
        far = np.einsum("ij,ij->i", away, away)
        size = np.diff(np.append(start, len(ball)))
        least = np.repeat(np.minimum.reduceat(far, start), size)
        which = np.flatnonzero(far == least)
        best = entry[which[np.searchsorted(which, start)]]  # the first nearest candidate of each ball
        best = np.repeat(best, size)
        # an entry is out if the ball lies wholly on the winner's side of the plane between both
        slack = 2 * tree.radius[ball] * between[entry, best]
        stays = (far - least <= slack + MARGIN * (far + least + slack + 1)) | (entry == best)
        ball, entry = ball[stays], entry[stays]
        start = np.flatnonzero(np.diff(ball, prepend=-1))
        size = np.diff(np.append(start, len(ball)))
        one = size == 1
        yield "balls", ball[start[one]], entry[start[one]]
        many = np.repeat(~one, size)
        leaf = tree.left[ball] < 0
        at, to = ball[many & leaf], entry[many & leaf]
        if len(at):
            start = np.flatnonzero(np.diff(at, prepend=-1))
            lists = np.diff(np.append(start, len(at)))
            points = tree.last[at[start]] - tree.first[at[start]]
            # every point of a leaf with every candidate of the leaf, candidates side by side
            pairs = np.repeat(start, points)
            many_each = np.repeat(lists, points)
            place = _ranges(tree.first[at[start]], points)
            row = np.repeat(np.arange(len(place)), many_each)
            candidate = to[_ranges(pairs, many_each)]
            owner, _ = _nearest(row, candidate, tree.points[place], book)
            yield "points", place, owner
        inner = many & ~leaf
        ball, entry = ball[inner], entry[inner]
        if len(ball):
            children = np.concatenate([tree.left[ball], tree.right[ball]])
            entry = np.concatenate([entry, entry])
            order = np.lexsort((entry, children))
            ball, entry = children[order], entry[order]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` numbers."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def gathered(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry of the codebook the sum and the number of the parts that are nearest to it."""
    total, count = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    for what, place, owner in _owned(tree, book):
        sums, sizes = (tree.total[place], tree.count[place]) if what == "balls" else (tree.points[place] * tree.weights[place, None], tree.weights[place])
        np.add.at(total, owner, sums)
        np.add.at(count, owner, sizes)
    return total, count


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of the block its part's entry and the squared distance."""
    entry = np.zeros(len(tree.points), np.int64)
    for what, place, owner in _owned(tree, book):
        if what == "balls":
            size = tree.last[place] - tree.first[place]
            entry[_ranges(tree.first[place], size)] = np.repeat(owner, size)
        else:
            entry[place] = owner
    away = tree.points - book[entry]
    return entry[tree.member], np.einsum("ij,ij->i", away, away)[tree.member]


_KINDS = ("i4", "i4", "u2", "f8", "f8", "i4", "i4", "i4", "i4", "i4", "i8")


def packed(tree: Tree) -> bytes:
    """The tree as bytes."""
    head = struct.pack("<4q", len(tree.points), tree.points.shape[1], len(tree.member), len(tree.radius))
    return head + b"".join(np.ascontiguousarray(column, dtype=f"<{of}").tobytes() for column, of in zip(tree, _KINDS, strict=True))


def unpacked(data: bytes) -> Tree:
    n, width, members, balls = struct.unpack_from("<4q", data)
    shapes = ((n, width), (n,), (members,), (balls, width), (balls,), *(((balls,),) * 5), (balls, width))
    columns, at = [], 32
    for shape, of in zip(shapes, _KINDS, strict=True):
        size = int(np.prod(shape))
        column = np.frombuffer(data, dtype=f"<{of}", count=size, offset=at).reshape(shape)
        at += column.nbytes
        columns.append(column if of == "f8" else column.astype(np.int64))
    return Tree(*columns)


def whole(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """_vec, _label and _x, the vectors as 64-bit numbers; rows without a usable vector are left out."""
    x = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    named = F.lit(None).cast("int") if label is None else F.col(label)
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(key).alias("_vec"), named.alias("_label"), x.alias("_x"))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as whole components, shorter ones with zeros at their ends."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    values = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    out[np.repeat(np.arange(len(column)), sizes), _ranges(np.zeros(len(column), np.int64), sizes)] = values
    return out


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of vectors: their keys, labels and the trees of all parts."""
    of_key, of_label = kind(rows, "_vec"), kind(rows, "_label")
    out = schema(("vecs", T.ArrayType(of_key)), ("labels", T.ArrayType(of_label)), ("trees", T.ArrayType(T.BinaryType())))
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, width))))

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        x = np.concatenate([_rows(part.column("_x"), width) for part in parts])
        trees = [packed(grown(part)) for part in np.split(x, PARTS, axis=1)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), _joined(table.column(c))) for c in ("_vec", "_label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == most:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, out)


def _joined(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class Codebooks(NamedTuple):
    """The stored trees and the entries (entries, width) of each part."""

    trees: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimals, by part, entry and place, joined by commas."""
        return sha256(",".join(str(x) for book in self.books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def _start(rows: DataFrame, width: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the least keys; null keys come last, equal keys by their components."""
    least = rows.orderBy(F.col("_vec").asc_nulls_last(), "_x").limit(entries).select("_x").collect()  # ``entries`` rows
    x = _rows(pa.array([r["_x"] for r in least], pa.list_(pa.float64())), width)
    return np.split(x, PARTS, axis=1)


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the mean of its parts, rounded down; unused entries stay."""
    out = schema(("part", "integer"), ("entry", "integer"), ("count", "long"), ("total", T.ArrayType(T.LongType())))
    shape = books[0].shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS, *shape), np.int64), np.zeros((PARTS, shape[0]), np.int64)
        for batch in batches:
            for row in batch.column("trees"):
                for part, data in enumerate(row):
                    sums, sizes = gathered(unpacked(data.as_buffer()), books[part])
                    total[part] += sums
                    count[part] += sizes
        part, entry = np.nonzero(count)
        sums = total[part, entry]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * shape[1], pa.int32()), pa.array(sums.reshape(-1)))
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), lists]
        yield pa.RecordBatch.from_arrays(columns, names=out.names)

    found = trees.select("trees").mapInArrow(gather, out)
    places = [F.sum(F.col("total")[at].cast("decimal(38,0)")).alias(f"t{at}") for at in range(shape[1])]
    sums = found.groupBy("part", "entry").agg(F.sum("count").alias("n"), *places).collect()  # a row per part and entry at most
    fresh = [book.copy() for book in books]
    for row in sums:
        fresh[row["part"]][row["entry"]] = [int(row[f"t{at}"]) // row["n"] for at in range(shape[1])]
    return fresh


def fitted(
    vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", label: str | None = "label"
) -> Codebooks:
    """Codebooks of at most ``entries`` (64 or fewer) entries for each of the 16 parts of the vectors."""
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"a codebook has 1 to {ENTRIES} entries, not {entries}")
    spark: SparkSession = vectors.sparkSession
    rows = whole(vectors, key, vector, label)
    longest = rows.agg(F.max(F.size("_x")).alias("n")).first()["n"] or 0
    width = max(1, -(-longest // PARTS)) * PARTS
    books = _start(rows, width, entries)
    folder = scratch_folder(spark, "vector-trees")
    # small row groups: a reader holds one of them
    _blocks(rows, width).write.option("parquet.block.size", 32 << 20).parquet(folder)
    trees = spark.read.parquet(folder)
    for _ in range(rounds if len(books[0]) else 0):
        books = _round(trees, books)
    return Codebooks(trees, books)


def encoded(fit: Codebooks) -> DataFrame:
    """_vec, _label, code (two hex digits a part) and error (squared distances summed over parts) of every vector."""
    of_key, of_label = (fit.trees.schema[c].dataType.elementType for c in ("vecs", "labels"))
    out = schema(("_vec", of_key), ("_label", of_label), ("code", "string"), ("error", "long"))
    books = fit.books
    digits = np.array([f"{at:02x}" for at in range(ENTRIES)], dtype="S2")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = [assigned(unpacked(data.as_buffer()), books[part]) for part, data in enumerate(batch.column("trees")[at])]
                codes = digits[np.stack([entry for entry, _ in found], axis=1)]
                texts = np.ascontiguousarray(codes).view(f"S{2 * PARTS}").reshape(-1).astype(str)
                error = sum(far for _, far in found)
                keys, labels = (batch.column(c)[at].values for c in ("vecs", "labels"))
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array(texts, pa.string()), pa.array(error)], names=out.names)

    return fit.trees.mapInArrow(encode, out)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every usable vector.

    Null vectors and those with null or non-finite components are dropped. Vectors are filled up with zeros to the length of
    the longest, and that to a multiple of 16 and 16 at least. Components beyond 4096 in size count as 4096. Rows with equal keys are vectors of
    their own; a null key comes after all others; equal and null labels add up their errors. With fewer than 64 vectors the
    codebooks are shorter; without any there are no rows.
    """
    fit = fitted(vectors, key=key, vector=vector, label=label)
    spark: SparkSession = vectors.sparkSession
    folder = scratch_folder(spark, "vector-codes")
    encoded(fit).write.parquet(folder)
    codes = spark.read.parquet(folder)
    totals = codes.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    if totals.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        rows = codes.join(F.broadcast(totals), codes["_label"].eqNullSafe(totals["_of"]))
    else:
        rows = dealt_join(codes, totals, codes["_label"].eqNullSafe(totals["_of"]), "_vec", "code")
    return rows.select(F.col("_vec").alias(key), "code", "error", "label_error", F.lit(fit.digest()).alias("codebooks_sha256"))
