"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A batch inserts, revises or deletes documents. Its ledger part holds signed entries per document: what the store
counted for it so far with a minus, what it counts now with a plus. The sums of these entries by group are the batch's
deltas, and the totals are the sums of all batches' deltas, so they are read from a few rows a batch. A batch is committed
once under its name; the same name again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.batches import BatchLog
from voxelloom.llm.common import kind, map_batches, schema, texts_of, words
from voxelloom.llm.tokens import encoder, word_bpe

GROUP = ("source", "lang", "tokenizer")
#: Texts that are encoded together.
ENCODED = 128


def _word_count(texts: list[str]) -> list[int]:
    return [len(words(text)) for text in texts]


def _bpe_count(texts: list[str]) -> list[int]:
    return [len(ids) // 4 for ids in encoder(word_bpe())(texts)]


#: Tokenizer versions: a name, and a function from texts to their numbers of tokens.
TOKENIZERS = {"word_bpe_49k": _bpe_count, "words_1": _word_count}


def token_counts(docs: DataFrame, tokenizers: tuple[str, ...] = tuple(TOKENIZERS), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, source, lang, tokenizer and tokens: a row per document and tokenizer version. Null texts have no tokens."""
    out = schema(("doc", kind(docs, key)), ("source", "string"), ("lang", "string"), ("tokenizer", "string"), ("tokens", "long"))
    rows = docs.select(F.col(key), *[F.col(c).cast("string").alias(c) for c in (text, "source", "lang")])

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, ENCODED):
            part = batch.slice(at, ENCODED)
            texts = texts_of(part, text)
            for name in tokenizers:
                columns = [part.column(key), part.column("source"), part.column("lang")]
                columns += [pa.array([name] * len(texts)), pa.array(TOKENIZERS[name](texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return map_batches(rows, count, out)


class CountStore(BatchLog):
    """Token totals of a changing set of documents, in a folder that all executors share.

    Rows of a batch with equal keys are counted together and replaced together; null keys are one key. Null sources
    and languages are groups of their own.
    """

    def __init__(self, spark: SparkSession, folder: str, doc_type: T.DataType | None = None) -> None:
        super().__init__(spark, folder)
        self.entry = schema(("doc", doc_type or T.LongType()), *((c, "string") for c in GROUP), ("docs", "long"), ("tokens", "long"))
        self.delta = schema(*((c, "string") for c in GROUP), ("docs", "long"), ("tokens", "long"))

    def ledger(self) -> DataFrame:
        """What the store counts now: doc, source, lang, tokenizer, docs, tokens."""
        sums = [F.sum(c).alias(c) for c in ("docs", "tokens")]
        return self.read("ledger", self.entry).groupBy("doc", *GROUP).agg(*sums).filter("docs != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens of all groups that have documents."""
        sums = [F.sum(c).alias(c) for c in ("docs", "tokens")]
        return self.read("deltas", self.delta).groupBy(*GROUP).agg(*sums).filter("docs != 0 or tokens != 0")

    def upsert(self, batch: str, docs: DataFrame, tokenizers: tuple[str, ...] = tuple(TOKENIZERS), key: str = "doc_id", text: str = "text") -> bool:
        """Insert new documents and revise known ones. False: the batch is in already."""
        if batch in (done := self.batches()):
            return False
        new = token_counts(docs, tokenizers, key, text).select("doc", *GROUP, F.lit(1).cast("long").alias("docs"), "tokens")
        if done:
            new = new.unionByName(self._reversed(docs.select(F.col(key).alias("_doc"))))
        return self._commit(batch, new)

    def delete(self, batch: str, doc_ids: DataFrame) -> bool:
        """Take out the documents whose keys are in the first column. Unknown keys change nothing. False: the batch is in already."""
        if batch in self.batches():
            return False
        return self._commit(batch, self._reversed(doc_ids.select(F.col(doc_ids.columns[0]).alias("_doc"))))

    def _reversed(self, keys: DataFrame) -> DataFrame:
        held, keys = self.ledger(), keys.distinct()
        found = held.join(keys, held["doc"].eqNullSafe(keys["_doc"]), "left_semi")
        return found.select("doc", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))

    def _commit(self, batch: str, entries: DataFrame) -> bool:
        step = len(self.batches())
        written = self.write(step, "ledger", entries)
        self.write(step, "deltas", written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
        self.commit(step, batch)
        return True


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keys of the documents whose text equals that of a document with a smaller key; null texts are no copies."""
    digest = F.sha2(F.col(text).cast("string"), 256)
    rows = docs.select(F.col(key).alias("doc"), digest.alias("digest")).filter("digest is not null")
    first = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(first, "digest").filter("doc != first").select("doc")
