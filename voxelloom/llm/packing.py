"""Best-two-fit packing of token pieces into sequences of bounded length.

A bin is filled greedily, longest piece first. Then its smallest piece gives way to two unpacked pieces if these fill the
widened gap more tightly. Pieces of one length are alike, so the bins are laid out over the histogram of lengths, which has at
most ``size`` rows at any scale: a layout repeats for as long as its lengths last, and the next one starts where one of them
has run out. The same choices are made as bin by bin. Each piece then finds its place from its rank within its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.common import keyed, kind, map_batches, schema, stored, texts_of
from voxelloom.llm.tokens import encoder, word_bpe

SIZE = 2048
#: Id that ends every document.
END = 0
#: Rows that are ranked together.
RANKED = 50_000
#: Texts that are encoded together.
ENCODED = 128


def token_pieces(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids into pieces: key, piece, start, length, ids_crc32, and with ``with_ids`` the ids.

    Null and empty texts give one piece, the end id alone. Rows with equal keys are documents of their own.
    """
    out = schema((key, kind(docs, key)), ("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"))
    if with_ids:
        out.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(word_bpe()), np.array([END], dtype="<u4").tobytes()
        for at in range(0, batch.num_rows, ENCODED):
            part = batch.slice(at, ENCODED)
            rows, numbers, crcs, lengths, ids = [], [], [], [], []
            for row, found in enumerate(encode(texts_of(part, text))):
                found += end
                for number, start in enumerate(range(0, len(found), 4 * size)):
                    piece = found[start : start + 4 * size]
                    rows.append(row)
                    numbers.append(number)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<i4"))
            columns = {
                key: part.column(key).take(pa.array(rows, pa.int64())),
                "piece": pa.array(numbers, pa.int32()),
                "start": pa.array(np.array(numbers, dtype=np.int64) * size),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(crcs, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return map_batches(keyed(docs, key, text), cut, out)


def _tighter_pair(left: np.ndarray, smallest: int, room: int) -> tuple[int, int] | None:
    """Two lengths with the greatest sum that is above ``smallest`` and at most ``room``; of equal sums the most unequal."""
    has = left > 0
    for total in range(room, smallest, -1):
        half = total // 2
        both = has[1 : half + 1] & has[total - 1 : total - half - 1 : -1]
        if total % 2 == 0 and both.size and left[half] < 2:
            both[half - 1] = False
        if both.any():
            first = int(both.argmax()) + 1
            return first, total - first
    return None


def layouts(histogram: dict[int, int], size: int = SIZE) -> list[tuple[Counter, int]]:
    """Bins as (pieces by length, how many bins are laid out so), from the number of pieces of each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    found = []
    while left.any():
        bin_, gap = Counter(), size
        for length in np.flatnonzero(left)[::-1]:
            take = min(int(left[length]), gap // int(length))
            if take:
                bin_[int(length)] = take
                gap -= take * int(length)
        for length, n in bin_.items():
            left[length] -= n
        if gap:
            smallest = min(bin_)
            if pair := _tighter_pair(left, smallest, min(size, gap + smallest)):
                left[smallest] += 1
                bin_[smallest] -= 1
                bin_ = +bin_
                for length in pair:
                    bin_[length] += 1
                    left[length] -= 1
        more = min(int(left[length]) // n for length, n in bin_.items())
        for length, n in bin_.items():
            left[length] -= more * n
        found.append((bin_, more + 1))
    return found


def _places(found: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """For each length the ranks at which a layout begins to use it, with its first bin, offset and pieces per bin."""
    used: Counter = Counter()
    rows, first_bin = [], 0
    for bin_, bins in found:
        offset = 0
        for length in sorted(bin_, reverse=True):
            rows.append((length, used[length], first_bin, offset, bin_[length]))
            used[length] += bins * bin_[length]
            offset += length * bin_[length]
        first_bin += bins
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "bin", "offset", "each"), columns, strict=True))


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to ``size``; rows are told apart by all columns.

    Rows that are equal in all columns get a place each. An empty table stays empty.
    """
    kept = stored(pieces)
    histogram = {int(r["length"]): r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = 1 + sum(histogram.values()) // RANKED
    dealt = kept.withColumn("_bucket", F.pmod(F.xxhash64(*kept.columns), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    starts = starts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy(*[c for c in kept.columns if c != "length"])
    ranked = dealt.withColumn("_row", F.row_number().over(within)).join(starts, ["length", "_bucket"])
    ranked = ranked.select(*kept.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    places = kept.sparkSession.sparkContext.broadcast(_places(layouts(histogram, size)))
    out = T.StructType([*kept.schema.fields]).add("sequence_id", "long").add("offset", "long")

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plan, wide = places.value, 1 << 48
        length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
        at = np.searchsorted(plan["length"] * wide + plan["rank"], length * wide + rank, side="right") - 1
        number, each = rank - plan["rank"][at], plan["each"][at]
        made = {
            "sequence_id": pa.array(plan["bin"][at] + number // each),
            "offset": pa.array(plan["offset"][at] + number % each * length),
        }
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "_rank"} | made)

    return map_batches(ranked, place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences: sequence_id and its ids in order of offset, from pieces that carry ``ids``."""
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut documents into pieces and pack these."""
    return pack(token_pieces(docs, size, key, text, with_ids), size)
