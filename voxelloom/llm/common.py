"""Words, Arrow plumbing and scratch data that the text operators share.

Every operator treats a null text as empty unless it says otherwise, ignores columns it does not know, and
accepts keys of any type that Spark can order.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.session import reliable_checkpoint, ship_package

#: One Arrow batch holds at most this many bytes, whatever the length of its texts.
BATCH_BYTES = 4 << 20
#: Keys, with a few bytes each, that are broadcast at once.
FEW_KEYS = 1_000_000
#: Tasks over which the rows of one key are dealt in a join with a large table of unique keys.
SHARES = 16
#: Words that are hashed or compared together, so that long batches need little memory.
TOGETHER = 200_000
#: A word: a run of lower-cased ASCII letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(byte: int) -> int:
    if 65 <= byte <= 90:
        return byte + 32
    return byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte >= 128 else 32


_FOLD = bytes(_folded(byte) for byte in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode().translate(_FOLD).split() if text else []


def prepared(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors and bound the size of Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Rows kept in the shared checkpoint folder, so that lost executors cost no recomputation."""
    return reliable_checkpoint(df)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that nobody refers to any more, before a loop goes on."""
    gc.collect()
    spark._jvm.System.gc()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, below the shared checkpoint folder."""
    import uuid

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        stored(spark.range(1))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str) -> DataFrame:
    """Rows kept as Parquet in a scratch folder, which takes less disk than ``stored``; the caller deletes it."""
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def delete_folder(spark: SparkSession, where: str) -> None:
    """Delete a scratch folder, whatever the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def schema(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    out = T.StructType()
    for name, of in fields:
        out.add(name, of)
    return out


Batches = Iterator[pa.RecordBatch]


def hand_back() -> None:
    """Give freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # trims what numpy and Python have freed, too


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function of batches; when a task ends, its worker, which lives on, hands back what the task has freed."""

    def returning(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return returning


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], out: T.StructType) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return df.mapInArrow(lean(run), out)


def portions(batch: pa.RecordBatch, column: str, most: int = TOGETHER) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """The rows in parts with about ``most`` words, or one row with more, and the words of each row."""
    start, size, own = 0, 0, []
    for at in range(batch.num_rows):
        mine = words(batch.column(column)[at].as_py())
        if own and size + len(mine) > most:
            yield batch.slice(start, at - start), own
            start, size, own = at, 0, []
        own.append(mine)
        size += len(mine)
    yield batch.slice(start), own


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if text is None else text for text in batch.column(column).to_pylist()]


def shielded(docs: DataFrame, *known: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all but the known columns renamed, so that no name can clash, and a function that takes a result back."""
    names = {c: c if c in known else f"_column_{at}" for at, c in enumerate(docs.columns)}
    renamed = docs.select(*[docs[f"`{c}`"].alias(name) for c, name in names.items()])
    return renamed, lambda out: out.select(*[out[name].alias(c) for c, name in names.items()])


def rows_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``text`` and the other columns of ``wanted`` for the documents whose key is its ``_doc``.

    Wanted keys are sent to where the documents are read if there are ``FEW_KEYS`` at most; else both sides are shuffled.
    """
    wanted = stored(wanted)
    few = wanted.count() <= FEW_KEYS
    rows = keyed(docs, key, text)
    found = rows.join(F.broadcast(wanted) if few else wanted, rows[key].eqNullSafe(wanted["_doc"]))
    return found.select(text, *[c for c in wanted.columns if c != "_doc"])


def dealt_join(rows: DataFrame, unique: DataFrame, condition: Column, *spread: str, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with a table that has one row per key; a key that many rows share is dealt over ``SHARES`` tasks by
    the columns ``spread`` of the rows."""
    dealt = rows.withColumn("_at", F.pmod(F.xxhash64(*spread), F.lit(SHARES)).cast("int"))
    shares = unique.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return dealt.join(shares, condition & (F.col("_at") == F.col("_share")), how).drop("_at", "_share")


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns that the operators read."""
    return df.select(F.col(key), F.col(text).cast("string").alias(text))


def grouped(groups: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of one group of ``applyInArrow`` given as an iterator of batches."""
    found = list(groups)
    return pa.Table.from_batches(found) if found else None
