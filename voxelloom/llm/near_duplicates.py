"""Near duplicates by ProbMinHash: probability Jaccard similarity of weighted word shingles.

Every shingle of a text makes a Poisson process whose rate is its weight; each arrival goes to a random register, and a
register keeps its first arrival. A process ends when its time is past the last register's. Two texts agree in a register
with the probability Jaccard similarity of their weights.

Texts with the same words are one node. Nodes that agree in a band of registers share a bucket; buckets with the same nodes count
once. Within a bucket no list of all pairs is made. Twice a node asks for one partner in another component, the centre of its
block if that is surely alike and else the node most alike by the registers: first within blocks of a bucket, then across
them. Asked pairs are verified on their whole shingle weights and links join components. What is alike by the registers, down to
``PLAUSIBLE``, and still lies in different components is then decided tile by tile: the shingle sets of the nodes in question
come together once per tile, an upper bound sorts out most pairs, and only links that join components leave the tile. So rows
grow with the members of a bucket, not with their pairs. Every link between components is found that the bands and registers
show; with 32 bands of 4 the bands miss a pair at the threshold once in about 2e7, and the registers one in 1e5.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxelloom.llm.common import dealt_join, keyed, kind, lean, map_batches, portions, release, rows_of, schema, stored
from voxelloom.llm.components import components
from voxelloom.llm.shingles import SHINGLE, digest, hashed, mixed, runs, weighted

THRESHOLD = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Estimated similarity from which a pair is verified: the threshold less 4.25 standard errors.
PLAUSIBLE = THRESHOLD - 4.25 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Estimate from which the centre of a bucket is asked first.
SURE = 0.92
#: Nodes of a bucket that are compared together.
BLOCK = 512
#: Asked pairs that a task hands on at once.
PAIRS_TOGETHER = 100_000


def registers(texts: list[np.ndarray]) -> np.ndarray:
    """One row of ``REGISTERS`` 32-bit element hashes per text, from the hashes of each text's shingles with repeats."""
    text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    element = np.concatenate([np.zeros(0, np.uint64), *map(np.sort, texts)])
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (element[1:] != element[:-1])
    first = np.flatnonzero(fresh)
    weight = np.diff(np.append(first, len(text))).astype(np.float64)
    text, element = text[first], element[first]
    held = np.full(len(texts) * REGISTERS, np.iinfo(np.uint64).max)
    time, state, low = np.zeros(len(text)), element.copy(), element >> np.uint64(32)
    while len(text):
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))  # the next of the element's own random numbers
        time = time - np.log1p(-((state >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        slot = (state & np.uint64(REGISTERS - 1)).astype(np.int64)  # bits that the time does not use
        arrival = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
        latest = np.argsort(arrival)[::-1]  # of arrivals at one register the earliest is written last
        place = (text * REGISTERS + slot)[latest]
        found = np.full(len(held), np.iinfo(np.uint64).max) if len(text) > len(held) // 8 else held.copy()
        found[place] = arrival[latest]
        np.minimum(held, found, out=held)
        last = (held.reshape(-1, REGISTERS).max(axis=1) >> np.uint64(32)).astype(np.uint32)
        going = time.astype(np.float32).view(np.uint32) <= last[text]
        text, time, state, low, weight = text[going], time[going], state[going], low[going], weight[going]
    return (held.reshape(-1, REGISTERS) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two sets of (elements, weights), elements ascending.

    Weights are whole numbers and so are all sums; only the last quotient is rounded, so a pair at the threshold reaches it.
    """
    common, at, to = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = one[1].astype(np.int64), other[1].astype(np.int64)
    alone = int(a.sum() - a[at].sum()), int(b.sum() - b[to].sum())
    a, b = a[at], b[to]
    _, first, inverse = np.unique(a / b, return_index=True, return_inverse=True)
    above, below = 0, 1
    for number, (p, q) in enumerate(zip(a[first].tolist(), b[first].tolist(), strict=True)):
        share = q * int(a[inverse == number].sum())
        total = q * alone[0] + p * alone[1] + int(np.maximum(q * a, p * b).sum())
        above, below = above * total + share * below, below * total
    return above / below


def nodes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row its key as _doc, node (digest of its words; null without any), sketch (a byte per register) and band hashes."""
    out = schema(("_doc", kind(docs, key)), ("node", "binary"), ("sketch", "binary"), ("bands", "binary"))

    def describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, own in portions(batch, text):
            found = registers([runs(hashed(x), SHINGLE) for x in own])
            bands = found.reshape(len(own), BANDS, ROWS).astype(np.uint64)
            mix = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
            for row in range(ROWS):
                mix = mixed(mix * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, row])
            digests = [digest(x) for x in own]
            sketches = [None if d is None else row.tobytes() for d, row in zip(digests, found.astype(np.uint8), strict=True)]
            keys = [None if d is None else row.tobytes() for d, row in zip(digests, mix, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(key), *(pa.array(x, pa.binary()) for x in (digests, sketches, keys))], names=out.names
            )

    return map_batches(keyed(docs, key, text), describe, out)


def _buckets(texts: DataFrame) -> DataFrame:
    """(band, node) of all buckets with more than one node."""

    def listed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype=np.int64)
        row = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(bands), batch.column("node").take(pa.array(row))], names=["band", "node"])

    rows = map_batches(texts.select("node", "bands"), listed, schema(("band", "long"), ("node", "binary")))
    alike = F.sum(F.xxhash64("node").cast("decimal(20,0)"))
    crowded = rows.groupBy("band").agg(F.count("*").alias("n"), alike.alias("nodes")).filter("n > 1")
    once = crowded.groupBy("n", "nodes").agg(F.min("band").alias("band")).select("band")
    return rows.join(once, "band", "left_semi")


def _members(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(band, _tile, node, root, asks): what is compared within each tile, of the buckets that reach over several components.

    A bucket of up to ``BLOCK`` nodes is one tile. In larger ones nodes outside the bucket's largest component ask and the others
    only answer; both are cut into blocks, and every block that asks makes a tile with each other block. So rows grow with the
    bucket times the blocks that ask. Without roots, before there are components, blocks are compared within themselves.
    """
    rows = buckets
    if roots is None:
        rows = rows.withColumn("root", F.col("node"))
    else:
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = rows.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band")
    size = parts.agg(F.sum("n").alias("_n"), F.max(F.struct("n", "root")).alias("_most"), F.count("*").alias("_parts")).filter("_parts > 1")
    few = F.col("_n") <= BLOCK
    own = F.when(few | F.lit(roots is None), 0).otherwise(F.col("_most.n"))
    asking = F.greatest(F.lit(1), F.ceil((F.col("_n") - own) / BLOCK)).cast("int")
    size = size.select("band", F.col("_most.root").alias("_largest"), asking.alias("_asking"), (asking + F.ceil(own / BLOCK)).cast("int").alias("_blocks"))
    rows = rows.join(size, "band")
    asks = F.lit(True) if roots is None else F.col("root") != F.col("_largest")
    within = F.pmod(F.xxhash64("node"), F.when(F.col("asks") | (F.col("_blocks") == F.col("_asking")), F.col("_asking")).otherwise(F.col("_blocks") - F.col("_asking")))
    first = F.when(F.col("asks") | (F.col("_blocks") == F.col("_asking")), 0).otherwise(F.col("_asking"))
    rows = rows.withColumn("asks", asks).withColumn("_block", (first + within).cast("int"))
    tile = lambda one, other: one.cast("long") * (1 << 32) + other
    if roots is None:
        rows = rows.withColumn("_tile", tile(F.col("_block"), F.col("_block")))
    else:
        others = F.sequence(F.lit(0), F.when(F.col("_block") < F.col("_asking"), F.col("_blocks")).otherwise(F.col("_asking")) - 1)
        rows = rows.withColumn("_tile", F.explode(F.transform(others, lambda b: tile(F.least("_block", b), F.greatest("_block", b)))))
    return rows.select("band", "_tile", "node", "root", "asks")


def _tiles(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(band, tile, members) from rows sorted by band and tile; members in the order of their nodes, the first of ``columns``."""
    place, members = None, []
    for batch in batches:
        for band, tile, *member in zip(*(batch.column(c).to_pylist() for c in ("band", "_tile", *columns)), strict=True):
            if (band, tile) != place:
                if members:
                    yield *place, sorted(members, key=lambda m: m[0])
                place, members = (band, tile), []
            members.append(tuple(member))
    if members:
        yield *place, sorted(members, key=lambda m: m[0])


def _alike(sketches: list[bytes], roots: list[bytes], asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that ask, the registers in which each agrees with each row (-1 within a component), and the roots as numbers."""
    number = {root: at for at, root in enumerate(dict.fromkeys(roots))}
    part = np.array([number[root] for root in roots])
    sketch = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, REGISTERS)
    asking = np.flatnonzero(asks)
    alike = np.empty((len(asking), len(sketch)), dtype=np.int16)
    for at in range(0, len(asking), 32):
        rows = asking[at : at + 32]
        alike[at : at + 32] = (sketch[rows, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.int16)
    alike[part[asking][:, None] == part[None, :]] = -1
    return asking, alike, part


_ASK = schema(("a", "binary"), ("b", "binary"))


def _ask(members: list[tuple]) -> list[tuple[bytes, bytes]]:
    """(a, b), a < b, for each asking member and the one in another component that it is most alike, the centre if that will do.

    A member is (node, root, asks, sketch), in the order of nodes.
    """
    names, roots, asks, sketches = zip(*members, strict=True)
    if len(set(roots)) < 2 or not any(asks):
        return []
    asking, alike, _ = _alike(sketches, roots, np.array(asks))
    sketch = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, REGISTERS)
    usual = np.array([np.bincount(column, minlength=256).argmax() for column in sketch.T], dtype=np.uint8) if len(names) > 2 else sketch[0]
    centre = int((sketch == usual).sum(axis=1).argmax())
    best = alike.argmax(axis=1)
    best[alike[:, centre] >= SURE * REGISTERS] = centre
    good = alike[np.arange(len(asking)), best] >= PLAUSIBLE * REGISTERS
    ends = {(min(a, b), max(a, b)) for a, b in zip(asking[good].tolist(), best[good].tolist(), strict=True)}
    return [(names[a], names[b]) for a, b in sorted(ends)]


def _askings(buckets: DataFrame, texts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs to verify: one partner at most for each node and tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, _, members in _tiles(batches, ("node", "root", "asks", "sketch")):
            found += _ask(members)
            if len(found) > PAIRS_TOGETHER:
                yield _columns(found, _ASK)
                found = []
        yield _columns(found, _ASK)

    rows = _members(buckets, roots).join(texts.select("node", "sketch"), "node")
    return rows.repartition("band", "_tile").sortWithinPartitions("band", "_tile").mapInArrow(lean(run), _ASK).distinct()


def _columns(rows: list[tuple], out: T.StructType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(out)
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, out, strict=True)], names=out.names)


def _plausible(members: list[tuple], band: int) -> Iterator[tuple[int, np.ndarray]]:
    """For the asking members of a tile the members in other components that are alike by the registers, the most alike first.

    A member is (node, root, asks, sketch, bands, ...), bands being its buckets. A pair that meets in several buckets belongs to
    the least of them; of two that ask the smaller one has the pair.
    """
    roots, asks = [m[1] for m in members], np.array([m[2] for m in members])
    if len(set(roots)) < 2 or not asks.any():
        return
    asking, alike, _ = _alike([m[3] for m in members], roots, asks)
    alike[asks[None, :] & (np.arange(len(members))[None, :] < asking[:, None])] = -1
    lists = [np.frombuffer(m[4], dtype=np.int64) for m in members]
    size = np.array([len(x) for x in lists])
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(members)), size)
    flat, owner = flat[flat < band], owner[flat < band]
    for row, at in enumerate(asking.tolist()):
        others = np.flatnonzero(alike[row] >= PLAUSIBLE * REGISTERS)
        if len(others):
            before = np.zeros(len(members), dtype=bool)
            before[owner[np.isin(flat, lists[at])]] = True
            others = others[~before[others]]
        if len(others):
            yield at, others[np.argsort(-alike[row, others], kind="stable")]


def _undecided(buckets: DataFrame, info: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, _tile, node, root, asks) of the members that some other member of the tile has to be compared with."""
    out = schema(("band", "long"), ("_tile", "long"), ("node", "binary"), ("root", "binary"), ("asks", "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, tile, members in _tiles(batches, ("node", "root", "asks", "sketch", "bands")):
            wanted: set[int] = set()
            for at, others in _plausible(members, band):
                wanted.add(at)
                wanted.update(others.tolist())
            if wanted:
                yield _columns([(band, tile, *members[at][:3]) for at in sorted(wanted)], out)

    rows = _members(buckets, roots).join(info, "node")
    return rows.repartition("band", "_tile").sortWithinPartitions("band", "_tile").mapInArrow(lean(run), out)


class _Sets:
    """The shingle sets of a tile, with an upper bound of the similarities of one to many."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sets = sets
        self.size = np.array([len(x[0]) for x in sets])
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        names, self.ids = np.unique(np.concatenate([x[0] for x in sets]), return_inverse=True)
        self.weights = np.concatenate([x[1] for x in sets]).astype(np.float64)
        self.total = np.add.reduceat(self.weights, self.ends[:-1])
        self.own = np.zeros(len(names))

    def bounds(self, one: int, others: np.ndarray) -> np.ndarray:
        """At least the similarity, and equal to it where the weights of common shingles are in one proportion."""
        span = slice(self.ends[one], self.ends[one + 1])
        self.own[self.ids[span]] = self.weights[span]
        size = self.size[others]
        starts = np.cumsum(size) - size
        flat = np.arange(size.sum()) + np.repeat(self.ends[others] - starts, size)
        x, y = self.own[self.ids[flat]], self.weights[flat]
        self.own[self.ids[span]] = 0
        common = x > 0
        mine, theirs = np.add.reduceat(x, starts), np.add.reduceat(y * common, starts)
        spread = lambda values: np.repeat(values, size)[common]
        x, y = x[common], y[common]
        below = spread(self.total[one] - mine) / x + spread(self.total[others] - theirs) / y + np.maximum(spread(mine) / x, spread(theirs) / y)
        terms = np.zeros(len(common))
        terms[common] = 1 / below
        return np.add.reduceat(terms, starts)


def _joined(members: list[tuple], band: int, threshold: float) -> Iterator[tuple[bytes, bytes, float]]:
    """Links that join components of a tile, after which no pair of members in different ones is alike.

    A member is (node, root, asks, sketch, bands, elements, weights).
    """
    sets = _Sets([tuple(np.frombuffer(x, dtype=np.uint32) for x in m[5:7]) for m in members])
    parent: dict[bytes, bytes] = {}

    def root(of: bytes) -> bytes:
        while (up := parent.get(of, of)) != of:
            of = up
        return of

    for at, others in _plausible(members, band):
        for first in range(0, len(others), 64):
            some = np.array([o for o in others[first : first + 64].tolist() if root(members[o][1]) != root(members[at][1])], dtype=np.int64)
            if not len(some):
                continue
            for other in some[sets.bounds(at, some) >= threshold - 1e-9].tolist():
                if (mine := root(members[at][1])) != (theirs := root(members[other][1])):
                    found = similarity(sets.sets[at], sets.sets[other])
                    if found >= threshold:
                        parent[mine] = theirs
                        a, b = sorted((members[at][0], members[other][0]))
                        yield a, b, found


_LINK = schema(("a", "binary"), ("b", "binary"), ("similarity", "double"))


def _decided(undecided: DataFrame, info: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Links between the members of the tiles, whole sets compared where they lie together; no pairs leave a tile but links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, _, members in _tiles(batches, ("node", "root", "asks", "sketch", "bands", "elements", "weights")):
            yield _columns(list(_joined(members, band, threshold)), _LINK)

    rows = undecided.join(info.join(shingles, "node"), "node")
    return rows.repartition("band", "_tile").sortWithinPartitions("band", "_tile").mapInArrow(lean(run), _LINK)


def _shingles_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node, elements and weights (32-bit numbers) of the wanted nodes (node, _doc)."""

    def describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, own in portions(batch, text):
            found = [weighted(hashed(x)) for x in own]
            columns = [pa.array([digest(x) for x in own], pa.binary()), *(pa.array([x[side].tobytes() for x in found], pa.binary()) for side in (0, 1))]
            same = pc.equal(columns[0], part.column("node"))
            yield pa.RecordBatch.from_arrays(columns, names=["node", "elements", "weights"]).filter(same)

    found = map_batches(rows_of(docs, wanted, key, text), describe, schema(("node", "binary"), ("elements", "binary"), ("weights", "binary")))
    return stored(found.dropDuplicates(["node"]))


def _verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs at or above the threshold."""
    side = lambda name: shingles.select(F.col("node").alias(name), F.struct("elements", "weights").alias(f"_{name}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        read = lambda column: [tuple(np.frombuffer(x[c], dtype=np.uint32) for c in ("elements", "weights")) for x in column.to_pylist()]
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [similarity(x, y) for x, y in zip(read(part.column("_a")), read(part.column("_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return map_batches(rows.select("a", "b", "_a", "_b"), measure, _LINK).filter(F.col("similarity") >= threshold)


def links(
    docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the rows of ``nodes``, links, roots): verified links (a, b, similarity) between different texts that join all alike
    ones, and the root of every node that has a link."""
    described = stored(nodes(docs, key, text))
    texts = described.filter("node is not null").groupBy("node").agg(F.min(F.struct("_doc", "sketch", "bands")).alias("x"))
    texts = stored(texts.select("node", "x.*"))
    buckets = stored(_buckets(texts))
    spark = docs.sparkSession
    suspects = texts.join(buckets.select("node").distinct(), "node", "left_semi")
    shingles = _shingles_of(docs, suspects.select("node", "_doc"), key, text)
    found, roots = None, None
    for _ in range(2):  # within blocks, then across them
        good = stored(_verified(_askings(buckets, texts, roots), shingles, threshold))
        release(spark)
        found, roots = good if found is None else found.unionByName(good), _roots(good, roots)
        release(spark)
    lists = buckets.groupBy("node").agg(F.collect_set("band").alias("bands"))  # a row per band at most
    info = stored(_packed(lists.join(texts.select("node", "sketch"), "node")))
    undecided = stored(_undecided(buckets, info, roots))
    release(spark)
    if not undecided.isEmpty():
        good = stored(_decided(undecided, info, shingles, threshold))
        found, roots = found.unionByName(good), _roots(good, roots)
        release(spark)
    return described, found.dropDuplicates(["a", "b"]), roots


def _roots(links: DataFrame, known: DataFrame | None) -> DataFrame:
    """node and root of every node that the links, or those that made the known roots, join to another one."""
    edges = links.select("a", "b")
    if known is not None:
        edges = edges.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return stored(components(edges).withColumnRenamed("node", "_node").select(F.col("_node").alias("node"), "root"))


def _packed(rows: DataFrame) -> DataFrame:
    """node, sketch and its buckets, 8 bytes each."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bands = [np.array(own, dtype=np.int64).tobytes() for own in batch.column("bands").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("sketch"), pa.array(bands, pa.binary())], names=["node", "sketch", "bands"])

    return map_batches(rows.select("node", "sketch", "bands"), pack, schema(("node", "binary"), ("sketch", "binary"), ("bands", "binary")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, class_id (the least key of its class) and class_size (rows).

    Texts with the same words are one class, as are texts that a chain of links joins. A text without words, null or not, is
    a class of its own. Null keys are counted but name no class, unless a class has no other.
    """
    described, _, roots = links(docs, threshold, key, text)
    rows = described.select(F.col("_doc").alias(key), "node").join(roots, "node", "left").withColumn("_root", F.coalesce("root", "node"))
    named = rows.filter("_root is not null").groupBy(F.col("_root").alias("_class")).agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"))
    # most classes are one row, which needs no looking up; a large class is dealt over several tasks
    out = dealt_join(rows, named.filter("class_size > 1"), F.col("_root") == F.col("_class"), key, "node", how="left")
    alone = F.col("_class").isNull()
    size = F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size"))
    return out.select(key, F.when(alone, F.col(key)).otherwise(F.col("class_id")).alias("class_id"), size.alias("class_size"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of each class the one with the least key stays.

    Rows with one key are one document and stay or go together; it stays if any of its texts names a class.
    """
    found = classes(docs, threshold, key, text)
    stay = found.filter(F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("_stay")).distinct()
    return docs.join(stay, docs[key].eqNullSafe(stay["_stay"]), "left_semi")
