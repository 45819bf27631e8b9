"""Reversible line dedup: exact reference counts per line, and sharded cuckoo filters of the lines that repeat.

A line's key is a 128-bit digest of the line, stripped and lower-cased in ASCII. The store keeps, as append-only Parquet logs,

* ``refs``: which document holds which key, signed, so that a deletion is an entry of its own;
* ``counts``: for every key that a batch touched, in how many documents it now stands and the largest of these;
* ``filters``: for every shard of the key space that changed, a cuckoo filter of the keys in ``min_docs`` documents or more.

The newest row of a key or shard holds. A batch is committed once under its name; the same name again changes nothing,
and a batch that broke off is written anew. One writer at a time.

Documents are rewritten shard by shard: their keys go to the shard's filter, and what the filter lets through is settled by the
exact counts of that shard. A shard that a frequent line makes large is dealt out over several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.batches import BatchLog
from voxelloom.llm.common import keyed, kind, map_batches, schema, scratch_folder, stored
from voxelloom.llm.cuckoo import CuckooFilter, build

#: Shortest key in code points, and the number of documents from which a line is a repeated one.
MIN_CHARS, MIN_DOCS = 20, 3
#: Documents for which a new store gets one more shard.
DOCS_PER_SHARD = 2000
#: Rows of one shard that one task takes.
CHUNK_ROWS = 100_000
_BLANK = " \t\n\v\f\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line, or None if it is too short to count."""
    line = line.strip(_BLANK)
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= min_chars else None


def line_refs(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """shard, line and ``key``: one row for each different line of a document that is long enough."""

    def found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, keys = [], []
        for row, value in enumerate(batch.column(text).to_pylist()):
            if value:
                own = {line_key(line, min_chars) for line in value.split("\n")} - {None}
                keys += own
                rows += [row] * len(own)
        dealt = [int.from_bytes(k[12:], "little") % shards for k in keys]
        columns = [pa.array(dealt, pa.int32()), pa.array(keys, pa.binary()), batch.column(key).take(pa.array(rows, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "line", "_doc"])

    out = schema(("shard", "integer"), ("line", "binary"), ("_doc", kind(docs, key)))
    return map_batches(keyed(docs, key, text), found, out)


def _update(old: pa.Table, changes: pa.Table) -> pa.Table:
    """The new filter of a shard; without bytes if it must be built anew."""
    shard = (old if old.num_rows else changes).column("shard")[0].as_py()
    entered = changes.filter(changes.column("now")).column("line").to_pylist()
    left = changes.filter(pc.invert(changes.column("now"))).column("line").to_pylist()
    if old.num_rows:
        filter_ = CuckooFilter(old.column("buckets")[0].as_py(), old.column("filter")[0].as_py())
        filter_.delete(left)
        whole = filter_.insert(entered)
    else:
        filter_, whole = build(entered), True
    made = {"shard": [shard], "buckets": [filter_.buckets], "filter": [filter_.tobytes() if whole else None]}
    return pa.Table.from_pydict(made, schema=_FILTER_ARROW)


def _rebuilt(lines: pa.Table) -> pa.Table:
    filter_ = build(lines.column("line").to_pylist())
    made = {"shard": [lines.column("shard")[0].as_py()], "buckets": [filter_.buckets], "filter": [filter_.tobytes()]}
    return pa.Table.from_pydict(made, schema=_FILTER_ARROW)


_FILTER = schema(("shard", "integer"), ("buckets", "long"), ("filter", "binary"))
_FILTER_ARROW = pa.schema([("shard", pa.int32()), ("buckets", pa.int64()), ("filter", pa.binary())])


class LineStore(BatchLog):
    """Lines of a growing and shrinking set of documents, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, shards: int, doc_type: T.DataType | None = None) -> None:
        super().__init__(spark, folder)
        self.shards = shards
        self.doc_type = doc_type or T.LongType()

    def _refs(self) -> DataFrame:
        """Which document holds which line now."""
        shape = schema(("shard", "integer"), ("line", "binary"), ("_doc", self.doc_type), ("sign", "integer"))
        found = self.read("refs", shape).groupBy("shard", "line", "_doc").agg(F.sum("sign").alias("_n"))
        return found.filter("_n > 0").drop("_n")

    def counts(self) -> DataFrame:
        """shard, line, n_docs, last_doc of every line that stands in any document."""
        shape = schema(("step", "long"), ("shard", "integer"), ("line", "binary"), ("n_docs", "long"), ("last_doc", self.doc_type))
        newest = F.max_by(F.struct("n_docs", "last_doc"), "step").alias("_x")
        return self.read("counts", shape).groupBy("shard", "line").agg(newest).select("shard", "line", "_x.*").filter("n_docs > 0")

    def filters(self) -> DataFrame:
        """shard, buckets, filter: the cuckoo filter of each shard's repeated lines."""
        shape = T.StructType([*schema(("step", "long")), *_FILTER])
        newest = F.max_by(F.struct("buckets", "filter"), "step").alias("_x")
        return self.read("filters", shape).groupBy("shard").agg(newest).select("shard", "_x.*")

    def insert(self, batch: str, docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> bool:
        """Add documents. Lines that the store already holds for a document count once. False: the batch is in already."""
        if batch in (done := self.batches()):
            return False
        new = line_refs(docs, self.shards, key, text, min_chars)
        if done:
            known = self._refs()
            same = [new[c].eqNullSafe(known[c]) for c in ("shard", "line", "_doc")]
            new = new.join(known, same, "left_anti")
        return self._commit(batch, new.distinct().withColumn("sign", F.lit(1)), min_docs)

    def delete(self, batch: str, doc_ids: DataFrame, min_docs: int = MIN_DOCS) -> bool:
        """Take out the documents whose ids are in the first column. Unknown ids change nothing."""
        if batch in self.batches():
            return False
        gone = doc_ids.select(F.col(doc_ids.columns[0]).alias("_gone")).distinct()
        held = self._refs()
        return self._commit(batch, held.join(gone, held["_doc"].eqNullSafe(gone["_gone"]), "left_semi").withColumn("sign", F.lit(-1)), min_docs)

    def _commit(self, batch: str, signed: DataFrame, min_docs: int) -> bool:
        before, step = self.counts(), len(self.batches())
        added = self.write(step, "refs", signed)
        if step:  # all documents that hold a line of this batch, with the batch
            held = self._refs().withColumn("sign", F.lit(1)).join(added.select("shard", "line").distinct(), ["shard", "line"], "left_semi")
            live = held.unionByName(added).groupBy("shard", "line", "_doc").agg(F.sum("sign").alias("_n"))
        else:
            live = added.withColumn("_n", F.lit(1))
        there = F.col("_n") > 0
        after = live.groupBy("shard", "line").agg(F.count(F.when(there, 1)).alias("n_docs"), F.max(F.when(there, F.col("_doc"))).alias("last_doc"))
        after = self.write(step, "counts", after.select(F.lit(step).cast("long").alias("step"), "*"))
        if step:
            was = before.select("shard", "line", (F.col("n_docs") >= min_docs).alias("was"))
            turned = after.join(was, ["shard", "line"], "left").withColumn("was", F.coalesce("was", F.lit(False)))
        else:
            turned = after.withColumn("was", F.lit(False))
        turned = turned.withColumn("now", F.col("n_docs") >= min_docs).filter("was != now").select("shard", "line", "now")
        made = stored(self.filters().groupBy("shard").cogroup(turned.groupBy("shard")).applyInArrow(_update, _FILTER))
        full = made.filter("filter is null").select("shard")
        newer = after.filter(F.col("n_docs") >= min_docs).select("shard", "line")
        if step:
            newer = newer.unionByName(before.join(after, ["shard", "line"], "left_anti").filter(F.col("n_docs") >= min_docs).select("shard", "line"))
        larger = newer.join(full, "shard", "left_semi").groupBy("shard").applyInArrow(_rebuilt, _FILTER)
        made = made.filter("filter is not null").unionByName(larger)
        self.write(step, "filters", made.select(F.lit(step).cast("long").alias("step"), "*"))
        self.commit(step, batch)
        return True

    def rewrite(self, docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
        """Documents without the repeated lines, but for the largest document that holds a line; adds n_lines and n_dropped.

        Rows with one key count as one document and lose the same lines; null keys count as one document, smaller than all.
        A null text stays null and counts as one empty line; a text that loses all its lines is empty. Other columns
        are kept as they are; columns named n_lines, n_dropped, _doc or _drop are replaced.
        """
        docs = docs.drop("n_lines", "n_dropped", "_doc", "_drop")
        refs = stored(line_refs(docs, self.shards, key, text, min_chars).distinct())
        chunks = refs.groupBy("shard").agg((F.floor(F.count("*") / CHUNK_ROWS) + 1).cast("int").alias("_chunks"))
        dealt = refs.join(chunks, "shard").withColumn("_chunk", F.pmod(F.xxhash64("_doc"), F.col("_chunks")).cast("int")).drop("_chunks")
        repeated = self.counts().filter(F.col("n_docs") >= min_docs).groupBy("shard")
        exact = repeated.agg(F.collect_list(F.struct("line", "last_doc")).alias("_exact")).join(self.filters(), "shard").join(chunks, "shard")
        exact = exact.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")

        def settle(asked: pa.Table, shard: pa.Table) -> pa.Table:
            none = pa.Table.from_batches([], pa.schema([asked.schema.field("_doc"), ("line", pa.binary()), asked.schema.field("_doc").with_name("_last")]))
            if not asked.num_rows or not shard.num_rows:
                return none
            filter_ = CuckooFilter(shard.column("buckets")[0].as_py(), shard.column("filter")[0].as_py())
            asked = asked.select(["_doc", "line"]).combine_chunks()
            asked = asked.filter(pa.array(filter_.contains(asked.column("line").to_pylist())))
            pairs = shard.column("_exact").combine_chunks().flatten()
            last, lines = pairs.field("last_doc"), pairs.field("line").to_pylist()
            place = {line: at for at, line in enumerate(lines)}
            at = pa.array([place.get(line) for line in asked.column("line").to_pylist()], pa.int64())
            asked = asked.append_column("_last", last.take(at)).append_column("_at", at)
            return asked.filter(pc.is_valid(asked.column("_at"))).drop_columns(["_at"])

        out = schema(("_doc", kind(docs, key)), ("line", "binary"), ("_last", kind(docs, key)))
        at = ("shard", "_chunk")
        settled = dealt.groupBy(*at).cogroup(exact.groupBy(*at)).applyInArrow(settle, out)
        drops = settled.filter(~F.col("_doc").eqNullSafe(F.col("_last"))).groupBy("_doc").agg(F.collect_list("line").alias("_drop"))
        joined = docs.join(drops, docs[key].eqNullSafe(drops["_doc"]), "left").drop("_doc")

        columns = docs.columns

        def kept(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, n_lines, n_dropped = [], [], []
            for value, drop in zip(batch.column(text).to_pylist(), batch.column("_drop").to_pylist(), strict=True):
                lines = (value or "").split("\n")
                left = lines
                if drop:
                    gone = set(drop)
                    left = [line for line in lines if line_key(line, min_chars) not in gone]
                texts.append("\n".join(left) if drop and value else value)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            same = {c: batch.column(c) for c in columns}
            made = {text: pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(same | made)

        return map_batches(joined, kept, T.StructType([*docs.schema.fields]).add("n_lines", "long").add("n_dropped", "long"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All documents put into a new store and rewritten against it; see ``LineStore.rewrite``."""
    spark = docs.sparkSession
    store = LineStore(spark, scratch_folder(spark, "lines"), 8 + docs.count() // DOCS_PER_SHARD, kind(docs, key))
    store.insert("all", docs, key, text, min_docs, min_chars)
    return store.rewrite(docs, key, text, min_docs, min_chars)
