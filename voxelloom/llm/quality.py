"""Quality by supervised subword embeddings.

A text is split at white space; each chunk, lower-cased, has one hashed vector of its own and one for each of its character
n-grams. All word bigrams of a chunk with itself share a vector, so stuttering text shows. The average of all of them is the document's vector, and a softmax layer gives the label's probabilities. Vectors and
layer are learned together by stochastic gradient descent on a bounded sample (``PER_CLASS`` documents of each label).

As the average is linear, a document's score needs only one number per hashed vector, its share in the difference of the two
outputs. That is what executors get: ``BUCKETS`` numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelloom.llm.common import map_batches, schema
from voxelloom.llm.samples import labelled

BUCKETS = 1 << 16
DIMENSIONS = 16
NGRAMS = (3, 4, 5)
PER_CLASS = 1500
EPOCHS, RATE, SEED = 5, 0.5, 17
#: Bucket of the bigrams of a chunk with itself, and how often one such bigram counts.
STUTTER, STUTTERS = zlib.crc32(b"= =") % BUCKETS, 8
#: Chunks that a Python worker remembers.
REMEMBERED = 400_000


@lru_cache(maxsize=100_000)
def chunk_features(chunk: str) -> list[int]:
    """Hashed features of one lower-cased chunk: itself and its n-grams, with marks at both ends."""
    marked = f"<{chunk}>"
    found = [zlib.crc32(marked.encode("utf-8"), 1) % BUCKETS]
    for n in NGRAMS:
        found += [zlib.crc32(marked[at : at + n].encode("utf-8")) % BUCKETS for at in range(len(marked) - n + 1)]
    return found


def stutters(chunks: list[str]) -> int:
    """Chunks that are equal to the one before them."""
    return sum(map(eq, chunks, chunks[1:]))


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text, ascending, and their shares in the average."""
    chunks = (text or "").lower().split()
    features, times = [STUTTER], [STUTTERS * stutters(chunks)]
    for chunk, n in Counter(chunks).items():
        features += chunk_features(chunk)
        times += [n] * (len(features) - len(times))
    counts = np.bincount(features, times, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used] / max(1.0, counts.sum())


@dataclass(frozen=True)
class Quality:
    """Each feature's share in the log odds of label 1, and their constant part."""

    odds: np.ndarray
    bias: float


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Quality:
    """Stochastic gradient descent on the softmax loss, one document a step, with a rate that falls to zero.

    Without samples of both labels all documents get the score 0.5.
    """
    if len(set(labels.tolist())) < 2:
        return Quality(np.zeros(BUCKETS), 0.0)
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for at in random.permutation(len(samples)):
            features, shares = samples[at]
            hidden = shares @ vectors[features]
            output = layer @ hidden + bias
            error = np.exp(output - output.max())
            error /= error.sum()
            error[labels[at]] -= 1
            rate = RATE * (1 - done / steps)
            back = layer.T @ error
            layer -= rate * np.outer(error, hidden)
            bias -= rate * error
            # the shares are small: each vector moves by its share of the document's largest one
            vectors[features] -= rate * np.outer(shares / max(shares.max(initial=0.0), 1e-12), back)
            done += 1
    return Quality(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Quality:
    """A model of labels.quality from a bounded sample; see ``samples.labelled`` for what it leaves out."""

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [text_features(x) for x in batch.column(text).to_pylist()]
        yield pa.RecordBatch.from_pydict({
            key: batch.column(key),
            "quality": batch.column("quality").cast(pa.int32()),
            "features": pa.array([f.astype("<u4").tobytes() for f, _ in found], pa.binary()),
            "shares": pa.array([s.astype("<f4").tobytes() for _, s in found], pa.binary()),
        })

    sample = labelled(docs, labels, "quality", per_class, key, text)
    out = schema((key, sample.schema[key].dataType), ("quality", "integer"), ("features", "binary"), ("shares", "binary"))
    rows = map_batches(sample, features, out).toArrow().sort_by(key)
    parts = zip(rows.column("features").to_pylist(), rows.column("shares").to_pylist(), strict=True)
    samples = [(np.frombuffer(f, dtype="<u4").astype(np.int64), np.frombuffer(s, dtype="<f4").astype(np.float64)) for f, s in parts]
    return train(samples, np.array(rows.column("quality").to_pylist(), dtype=np.int64))


class _Known(dict):
    """Log odds and number of features of each chunk, remembered."""

    def __init__(self, odds: np.ndarray) -> None:
        super().__init__()
        self.odds = odds.tolist()

    def __missing__(self, chunk: str) -> tuple[float, int]:
        features = chunk_features.__wrapped__(chunk)
        found = sum(map(self.odds.__getitem__, features)), len(features)
        if len(self) < REMEMBERED:
            self[chunk] = found
        return found


def score(docs: DataFrame, model: Quality, text: str = "text") -> DataFrame:
    """The documents with score (probability of label 1) and predicted (1 from a score of 0.5).

    Null and empty texts get the score of the constant part. All rows and columns stay; columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted")
    columns, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value.odds)
        for batch in batches:
            totals = []
            for value in batch.column(text).to_pylist():
                chunks = (value or "").lower().split()
                found = list(map(known.__getitem__, chunks))
                more = STUTTERS * stutters(chunks)
                totals.append((sum(x for x, _ in found) + more * known.odds[STUTTER], sum(n for _, n in found) + more))
            odds, n = np.array(totals, dtype=np.float64).reshape(-1, 2).T
            result = 0.5 * (1 + np.tanh(0.5 * (odds / np.maximum(n, 1) + shared.value.bias)))
            made = {"score": pa.array(result), "predicted": pa.array((result >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | made)

    return docs.mapInArrow(rate, T.StructType([*docs.schema.fields]).add("score", "double").add("predicted", "integer"))


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a key belongs to the rows that are not learned from; null keys do not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def assess(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score all documents with a model that never saw the held-out rows."""
    model = fit(docs.select(key, text), labels.filter(~held_out(key)), per_class, key, text)
    return score(docs, model, text).withColumn("held_out", held_out(key))
