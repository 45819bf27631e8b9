"""Benchmark passages in training texts, found through a positional inverted index that is spread over the cluster.

The index has one row per shard, a run of documents that came to one task together: the shard's documents with the place of
their first word, its terms, and for each term the ascending places at which it stands. Documents of a shard are set apart
by a gap, so no match runs from one into the next. A phrase is looked up shard by shard: the places of its rarest term, less
that term's offset, are the candidates, and each further term keeps those at which its own list agrees, rarest first.

Phrases are read in blocks of a bounded number of (phrase, item) pairs, so their broadcast is bounded. One block is the usual
case, and then the index holds only terms that some phrase has; otherwise it holds all, and every block reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.common import keyed, kind, map_batches, schema, stored, words

#: Words of a window.
SIZE = 10
#: Places between the documents of a shard; phrases and distances must be shorter.
GAP = 256
#: (phrase, item) pairs that are broadcast at once.
BLOCK_PAIRS = 200_000
#: Candidates that are followed up at once.
CANDIDATES = 1 << 21
_WIDE = np.int64(1) << 33


def windows(items: DataFrame, size: int = SIZE, key: str = "item_id", text: str = "text") -> DataFrame:
    """phrase (words with a blank between) and item: every run of ``size`` words of an item, or all words of a shorter one.

    Items without words give nothing. Items are named by their key as a string, null by ``null``; equal names are one item.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = set()
        for name, value in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
            own = words(value)
            if own:
                found |= {(b" ".join(own[at : at + size]), name) for at in range(max(1, len(own) - size + 1))}
        phrases, names = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array(names, pa.string())], names=["phrase", "item"])

    named = keyed(items, key, text).withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return map_batches(named, cut, schema(("phrase", "binary"), ("item", "string"))).distinct()


class Phrases:
    """One block of phrases: the terms, each phrase's terms by number and each phrase's items."""

    def __init__(self, pairs: pa.Table) -> None:
        by_phrase: dict[bytes, list[str]] = {}
        for phrase, item in zip(pairs.column("phrase").to_pylist(), pairs.column("item").to_pylist(), strict=True):
            by_phrase.setdefault(phrase, []).append(item)
        phrases = [phrase.split() for phrase in by_phrase]
        self.terms = {term: at for at, term in enumerate(sorted({term for phrase in phrases for term in phrase}))}
        self.lengths = np.array([len(phrase) for phrase in phrases], dtype=np.int64)
        self.numbers = np.full((len(phrases), max([0, *self.lengths])), -1, dtype=np.int64)
        for row, phrase in enumerate(phrases):
            self.numbers[row, : len(phrase)] = [self.terms[term] for term in phrase]
        self.items = list(by_phrase.values())


def _blocks(pairs: DataFrame) -> list[DataFrame]:
    """The pairs in blocks of about ``BLOCK_PAIRS`` rows; one phrase's items may be in several."""
    pairs = stored(pairs)
    n = 1 + pairs.count() // BLOCK_PAIRS
    return [pairs.filter(F.pmod(F.xxhash64("phrase", "item"), F.lit(n)) == block) for block in range(n)]


def build_index(docs: DataFrame, terms: set[bytes] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Index rows: shard, docs, base, n_words, terms, ends, places. With ``terms``, a bounded set, only their postings are kept.

    Every document is listed, also one without words. ``places`` holds 32-bit places, those of the term at ``i`` from
    ``ends[i - 1]`` to ``ends[i]``. The rows are stored reliably.
    """
    spark = docs.sparkSession
    wanted = None if terms is None else spark.sparkContext.broadcast({term: at for at, term in enumerate(sorted(terms))})
    integers = T.ArrayType(T.LongType())
    out = schema(
        ("docs", T.ArrayType(kind(docs, key))), ("base", integers), ("n_words", integers),
        ("terms", T.ArrayType(T.BinaryType())), ("ends", integers), ("places", "binary"),
    )

    def index(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = {} if wanted is None else wanted.value
        numbers, counts = [], []
        for value in batch.column(text).to_pylist():
            own = words(value)
            counts.append(len(own))
            if wanted is None:
                numbers.append(np.fromiter((known.setdefault(word, len(known)) for word in own), np.int32, len(own)))
            else:
                numbers.append(np.array(list(map(known.get, own, [-1] * len(own))), dtype=np.int32))
        n_words = np.array(counts, dtype=np.int64)
        base = np.cumsum(n_words + GAP) - n_words - GAP
        number = np.concatenate(numbers)
        place = np.arange(len(number)) + np.repeat(np.arange(len(counts)) * GAP, n_words)
        if wanted is not None:
            place, number = place[number >= 0], number[number >= 0]
        order = np.argsort(number, kind="stable")
        number, place = number[order], place[order].astype("<u4")
        used, ends = np.unique(number, return_counts=True)
        names = list(known)
        row = {
            "docs": pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(key)),
            "base": pa.array([base], pa.list_(pa.int64())),
            "n_words": pa.array([n_words], pa.list_(pa.int64())),
            "terms": pa.array([[names[at] for at in used.tolist()]], pa.list_(pa.binary())),
            "ends": pa.array([np.cumsum(ends)], pa.list_(pa.int64())),
            "places": pa.array([place.tobytes()], pa.binary()),
        }
        yield pa.RecordBatch.from_pydict(row)

    shards = map_batches(keyed(docs, key, text), index, out)
    return stored(shards.select(F.monotonically_increasing_id().alias("shard"), "*"))


class _Shard:
    """Postings of one index row, by the term numbers of a block of phrases."""

    def __init__(self, row: pa.RecordBatch, phrases: Phrases) -> None:
        self.docs = row.column("docs").flatten()
        self.base, self.n_words = (row.column(c).flatten().to_numpy() for c in ("base", "n_words"))
        ends = row.column("ends").flatten().to_numpy()
        places = np.frombuffer(row.column("places")[0].as_py(), dtype="<u4")
        own = row.column("terms").flatten().to_pylist()
        number = np.array([phrases.terms.get(term, -1) for term in own], dtype=np.int64)
        counts = np.diff(ends, prepend=0)
        self.start, self.count = np.zeros((2, len(phrases.terms) + 1), dtype=np.int64)
        kept = number >= 0
        of_place = np.repeat(number, counts)
        places, of_place = places[of_place >= 0].astype(np.int64), of_place[of_place >= 0]
        order = np.argsort(of_place, kind="stable")
        self.codes = of_place[order] * _WIDE + places[order]
        self.count[number[kept]] = counts[kept]
        self.start[:-1] = np.cumsum(self.count[:-1]) - self.count[:-1]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the term stands at the place."""
        code = term * _WIDE + place
        at = np.searchsorted(self.codes, code)
        return (place >= 0) & (self.codes[np.minimum(at, len(self.codes) - 1)] == code)

    def near(self, term: np.ndarray, place: np.ndarray, distance: int) -> np.ndarray:
        """Whether the term stands at most ``distance`` words away."""
        low = np.searchsorted(self.codes, term * _WIDE + np.maximum(place - distance, 0))
        return low < np.searchsorted(self.codes, term * _WIDE + place + distance, side="right")

    def candidates(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of each phrase's rarest term: the phrases, the terms' order from the rarest, the places; in bounded parts."""
        if not len(self.codes) or not len(phrases.items):
            return
        counts = np.where(phrases.numbers >= 0, self.count[phrases.numbers], np.iinfo(np.int64).max)
        able = np.flatnonzero(counts.min(axis=1) > 0)
        order = np.argsort(counts[able], axis=1, kind="stable")
        rarest = np.take_along_axis(phrases.numbers[able], order[:, :1], axis=1)[:, 0]
        n = self.count[rarest]
        for part in np.split(np.arange(len(able)), np.flatnonzero(np.diff(np.cumsum(n) // CANDIDATES)) + 1):
            if len(part):
                row = np.repeat(part, n[part])
                within = np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                code = self.codes[self.start[rarest[row]] + within]
                yield able[row], order[row], code - rarest[row] * _WIDE

    def phrase_places(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first place) of every exact occurrence."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for phrase, order, place in self.candidates(phrases):
            first = place - order[:, 0]
            for nth in range(1, phrases.numbers.shape[1]):
                offset = order[:, nth]
                term = phrases.numbers[phrase, offset]
                good = (term < 0) | self.has(term, first + offset)
                phrase, order, first = phrase[good], order[good], first[good]
            found.append((phrase, first))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def near_phrases(self, phrases: Phrases, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its rarest term) where all other terms are at most ``distance`` words away, in any order."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for phrase, order, place in self.candidates(phrases):
            for nth in range(1, phrases.numbers.shape[1]):
                term = phrases.numbers[phrase, order[:, nth]]
                good = (term < 0) | self.near(term, place, distance)
                phrase, order, place = phrase[good], order[good], place[good]
            found.append((phrase, place))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, place, side="right") - 1


def _items(phrases: Phrases, doc: np.ndarray, phrase: np.ndarray, n: int) -> list[list[str]]:
    found: list[set[str]] = [set() for _ in range(n)]
    if len(doc):
        for at, which in np.unique(np.stack([doc, phrase]), axis=1).T.tolist():
            found[at].update(phrases.items[which])
    return [sorted(x) for x in found]


def _each_shard(index: DataFrame, block: DataFrame, out: T.StructType, rows) -> DataFrame:
    phrases = index.sparkSession.sparkContext.broadcast(Phrases(block.toArrow()))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            shard = _Shard(row, phrases.value)
            names = [pa.array([row.column("shard")[0].as_py()] * len(shard.docs), pa.int64()), pa.array(range(len(shard.docs)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*names, shard.docs, pa.array(shard.n_words), *rows(shard, phrases.value)], names=out.names)

    return map_batches(index, run, out)


def _merged(index: DataFrame, pairs: list[DataFrame], key: str, rows, more: tuple) -> DataFrame:
    """The rows of all blocks, one per document."""
    of = index.schema["docs"].dataType.elementType
    out = schema(("shard", "long"), ("row", "integer"), (key, of), ("n_words", "long"), *more)
    found = [_each_shard(index, block, out, rows) for block in pairs]
    if len(found) == 1:
        return found[0]
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    gathered = [F.flatten(F.collect_list(name)).alias(name) for name, _ in more]
    return union.groupBy("shard", "row").agg(F.first(key).alias(key), F.first("n_words").alias("n_words"), *gathered)


def _covered(runs: Column) -> Column:
    """Words in the union of runs that are sorted by start."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))

    def add(acc, run):
        fresh = F.greatest(F.lit(0).cast("long"), run["end"] - F.greatest(acc["end"], run["start"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], run["end"]).alias("end"))

    return F.aggregate(F.array_sort(runs), start, add, lambda acc: acc["n"])


def phrase_matches(index: DataFrame, pairs: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """For every document: shard, row, key, n_words, runs (start, end) of hit words, and the items with a phrase in it."""
    run = T.StructType().add("start", "long").add("end", "long")

    def rows(shard: _Shard, phrases: Phrases) -> list[pa.Array]:
        phrase, place = shard.phrase_places(phrases)
        doc, n = shard.doc_of(place), len(shard.docs)
        order = np.argsort(place, kind="stable")
        start, end = place[order], (place + phrases.lengths[phrase])[order] if len(place) else place
        reach = np.maximum.accumulate(end) if len(end) else end
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = start[1:] > reach[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        of = doc[order][first]
        ends = np.searchsorted(of, np.arange(n + 1))
        base = shard.base[of]
        runs = pa.StructArray.from_arrays([pa.array(start[first] - base), pa.array(reach[last] - base)], names=["start", "end"])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(_items(phrases, doc, phrase, n), pa.list_(pa.string()))]

    return _merged(index, pairs, key, rows, (("runs", T.ArrayType(run)), ("items", T.ArrayType(T.StringType()))))


def proximity_matches(index: DataFrame, pairs: list[DataFrame], distance: int, key: str = "doc_id") -> DataFrame:
    """For every document the items with a phrase whose terms all stand at most ``distance`` words from its rarest term."""
    if distance >= GAP:
        raise ValueError(f"the distance must be below {GAP}")

    def rows(shard: _Shard, phrases: Phrases) -> list[pa.Array]:
        phrase, place = shard.near_phrases(phrases, distance)
        return [pa.array(_items(phrases, shard.doc_of(place), phrase, len(shard.docs)), pa.list_(pa.string()))]

    found = _merged(index, pairs, key, rows, (("items", T.ArrayType(T.StringType())),))
    return found.select(key, "n_words", F.array_sort(F.array_distinct("items")).alias("items"))


def index_for(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """The index of the documents and the blocks of the items' windows."""
    if size >= GAP:
        raise ValueError(f"windows must be shorter than {GAP} words")
    pairs = _blocks(windows(items, size, item_key, item_text))
    terms = set(Phrases(pairs[0].toArrow()).terms) if len(pairs) == 1 else None
    return build_index(docs, terms, key, text), pairs


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items (sorted), contaminated.

    A word is hit if it is part of an occurrence of any window of any item. Documents without words have no hit, as has every
    document where no item has words. Rows with equal keys are documents of their own.
    """
    index, pairs = index_for(docs, items, size, key, text, item_key, item_text)
    found = phrase_matches(index, pairs, key)
    found = found.select(key, "n_words", _covered(F.col("runs")).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
    return found.select("*", F.size("items").cast("long").alias("n_items"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit. Of rows with one key all go if one is hit; null keys are one key."""
    hit = contamination(docs, items, size, key, text).filter("contaminated").select(F.col(key).alias("_hit")).distinct()
    return docs.join(hit, docs[key].eqNullSafe(hit["_hit"]), "left_anti")
