"""How five text filters interact: contractions of a contingency tensor per part of a corpus.

Every document fails or passes each of the filters A to E. Per part the documents are counted by what they fail, which is a
tensor of 2x2x2x2x2 counts, beside it the same tensor of the good and of the toxic documents. All that an order of the filters
does follows from these 32 cells: a step takes along the axis of each filter the passing documents, the failing ones or all of
them, and sums up what is left. So the texts are read once, whatever the number of orders.

A: under 200 words. B: less than half of the words are different. C: more than 2 % of the characters are A to Z.
D: any of ``#$%&*|``. E: the same text as a document with a smaller key, in any part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.common import kind, map_batches, schema

FILTERS = "ABCDE"
FEWEST_WORDS = 200
#: Words must be different for this many in a hundred; capitals are allowed for this many in a hundred.
DIFFERENT, CAPITALS = 50, 2
MARKS = b"#$%&*|"

CELLS = 1 << len(FILTERS)
#: Kinds of documents that are counted: all, good, toxic.
COUNTED = ("n", "good", "bad")
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

_CAPITAL = np.zeros(256, dtype=np.int64)
_CAPITAL[65:91] = 1
_NOT_MARKS = bytes(b for b in range(256) if b not in MARKS)


def failures(text: str) -> int:
    """One bit for each of A to D that the text fails, A the lowest."""
    raw = text.encode()
    own = raw.split()  # at 0x20 and 0x09 to 0x0D, as bytes know no other blanks
    capitals = int(_CAPITAL[np.frombuffer(raw, dtype=np.uint8)].sum())
    fails = (
        len(own) < FEWEST_WORDS,
        100 * len(set(own)) < DIFFERENT * len(own),
        100 * capitals > CAPITALS * len(text),
        len(raw.translate(None, _NOT_MARKS)) > 0,
    )
    return sum(fail << at for at, fail in enumerate(fails))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """_doc, part, digest of the text (128 bits) and the bits of A to D, for every row."""
    rows = docs.select(F.col(key).alias("_doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [value or "" for value in batch.column("text").to_pylist()]
        digests = pa.array([blake2b(t.encode(), digest_size=16).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_doc"), batch.column("part"), digests, pa.array([failures(t) for t in texts], pa.int32())], names=["_doc", "part", "digest", "bits"]
        )

    return map_batches(rows, judge, schema(("_doc", kind(rows, "_doc")), ("part", "string"), ("digest", "binary"), ("bits", "integer")))


def contingency(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, cell (bits of A to E) and the numbers n, good and bad of its documents; cells without documents have no row.

    Rows are collapsed by key, text and part first, then by text and part, so that copies, of whatever number, meet as one row
    per part and kind of label. Rows with one key and one text are not copies of each other. A null key is neither smaller nor
    greater than any, so its row never fails E and makes no other fail it. A document is good (toxic) if any of its labels is.
    """
    marked = labels.groupBy(F.col(key).alias("_doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    text_keys = ["digest", "bits", "part", "good", "bad"]
    rows = judged(docs, key, text, part).groupBy("_doc", "digest", "bits", "part").agg(F.count("*").alias("n"))
    rows = rows.join(marked, "_doc", "left").na.fill(0, ["good", "bad"])
    known = F.col("_doc").isNotNull()
    groups = rows.groupBy(*text_keys).agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(known, F.lit(0)).otherwise(F.col("n"))).alias("unknown"),
        F.min(F.when(known, F.struct("_doc", "n"))).alias("least"),  # one row per key and group
    )
    least = groups.groupBy("digest").agg(F.min("least._doc").alias("_first"))
    groups = groups.join(least, "digest").withColumn("_kept", F.when(F.col("least._doc") == F.col("_first"), F.col("least.n")).otherwise(0))
    failing = F.col("bits") + F.lit(1 << 4)
    cells = F.array(
        F.struct(F.col("bits").alias("cell"), (F.col("_kept") + F.col("unknown")).alias("m")),
        F.struct(failing.alias("cell"), (F.col("n") - F.col("_kept")).alias("m")),
    )
    spread = groups.select("part", "good", "bad", F.inline(cells)).filter("m > 0")
    return spread.groupBy("part", "cell").agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("good")).alias("good"), F.sum(F.col("m") * F.col("bad")).alias("bad")
    )


@lru_cache(maxsize=1)
def orders() -> list[str]:
    return ["".join(order) for order in permutations(FILTERS)]


_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


@lru_cache(maxsize=1)
def selections() -> dict[str, np.ndarray]:
    """For every order and step the vector along each filter's axis: (orders * steps, filters, 2)."""
    chosen: dict[str, list] = {"kept": [], "removed": [], "failing": [], "alone": []}
    for order in orders():
        for at, own in enumerate(order):
            before = set(order[:at])
            chosen["kept"].append([_PASS if f in before or f == own else _ALL for f in FILTERS])
            chosen["removed"].append([_FAIL if f == own else _PASS if f in before else _ALL for f in FILTERS])
            chosen["failing"].append([_FAIL if f == own else _ALL for f in FILTERS])
            chosen["alone"].append([_FAIL if f == own else _PASS for f in FILTERS])
    return {name: np.array(rows, dtype=np.int64) for name, rows in chosen.items()}


def contracted(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of every order and step, (parts, orders * steps), from counts (parts, 2, 2, 2, 2, 2, kinds).

    Axes stand in the order of ``FILTERS``; place 1 of an axis holds the documents that fail.
    """

    def take(name: str) -> np.ndarray:
        along = [selections()[name][:, at] for at in range(len(FILTERS))]
        return np.einsum("pabcdek,sa,sb,sc,sd,se->psk", tensors, *along, optimize=True)

    removed, failing = take("removed"), take("failing")
    own = np.array([FILTERS.index(f) for order in orders() for f in order])
    shapley = np.stack([removed[:, own == at, 0].sum(axis=1) for at in range(len(FILTERS))], axis=1)[:, own]
    return {
        "kept": take("kept")[:, :, 0],
        "removed": removed[:, :, 0],
        "redundant": failing[:, :, 0] - removed[:, :, 0],
        "unique_fails": take("alone")[:, :, 0],
        "good_lost": removed[:, :, 1],
        "toxic_lost": removed[:, :, 2],
        "shapley": shapley,
    }


#: Parts whose tensors are contracted together.
TOGETHER = 64


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, a null part the empty string. An empty table has no parts and no rows. A part has at most 32 cells,
    and parts are contracted where they lie, so there may be any number of them.
    """
    cell = F.struct("cell", *COUNTED)
    parts = contingency(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(cell).alias("cells"))
    out = schema(("part", "string"), ("filter_order", "string"), ("step", "integer"), *((name, "long") for name in MEASURES))

    def contract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        steps = len(orders()) * len(FILTERS)
        names = [order for order in orders() for _ in FILTERS]
        for first in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(first, TOGETHER)
            counts = np.zeros((some.num_rows, CELLS, len(COUNTED)), dtype=np.int64)
            for row, cells in enumerate(some.column("cells").to_pylist()):
                for c in cells:
                    counts[row, c["cell"]] += [c[name] for name in COUNTED]
            # bit 0 is A: of the five axes made from a cell's number the first is the highest bit
            tensors = counts.reshape(-1, *(2,) * len(FILTERS), len(COUNTED)).transpose(0, 5, 4, 3, 2, 1, 6)
            measures = contracted(tensors)
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), steps))),
                    pa.array(names * some.num_rows, pa.string()),
                    pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), some.num_rows * len(orders()))),
                    *(pa.array(measures[name].reshape(-1)) for name in MEASURES),
                ],
                names=out.names,
            )

    return map_batches(parts, contract, out)
