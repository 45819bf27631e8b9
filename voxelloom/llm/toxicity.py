"""Severity of toxic language by cumulative-link ordinal regression.

Grades run from 0, clean, to ``GRADES`` - 1. ``P(grade >= k) = s(w . x - t_k)`` with ordered thresholds ``t_1 < t_2 < ...``
that share the weights ``w``. Labels say only whether a document is toxic, so toxic documents of the sample are graded by the
density of words that mark toxic documents, in equal parts. Features are words and word beginnings whose document frequency
differs between the labels; a feature's value is ``1 + log(1 + occurrences per 100 words)``.

The model is fitted on a bounded sample of labelled rows (``PER_CLASS`` of each label); every whole text is scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxelloom.functions.batches import payload_view
from voxelloom.llm.common import hand_back, lean, map_batches, schema, words
from voxelloom.llm.samples import labelled

GRADES = 4
PER_CLASS = 3000
#: Bytes of the word beginnings that are features beside the word itself.
BEGINNINGS = (4, 6)
#: Standard errors, of the pooled frequency, by which a feature's frequency must differ between the labels.
SELECTED_Z = 4.0
ROUNDS, RATE, RIDGE = 600, 0.1, 2e-4
#: Words that a Python worker remembers.
REMEMBERED = 300_000


def word_features(word: bytes) -> list[int]:
    """Hashed features of one word."""
    return [zlib.crc32(word), *(zlib.crc32(word[:n], n) for n in BEGINNINGS if len(word) >= n)]


def text_features(text: str | None) -> tuple[dict[int, int], int]:
    """Occurrences of each feature, and the number of words."""
    own = Counter(words(text))
    counts: Counter = Counter()
    for word, n in own.items():
        for feature in word_features(word):
            counts[feature] += n
    return counts, sum(own.values())


def value(count, n_words):
    return 1 + np.log1p(100.0 * count / np.maximum(n_words, 1))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Severity:
    """Weights by feature, and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def at_least(self, counts: dict[int, int], n_words: int) -> list[float]:
        """Probability of grade k or more, for k from 1."""
        link = sum(self.weights[f] * (1 + math.log1p(100.0 * n / n_words)) for f, n in sorted(counts.items()))
        return [0.5 * (1 + math.tanh(0.5 * (link - t))) for t in self.thresholds]


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, features: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of greatest penalised likelihood, by Adam over all rows.

    The design matrix is given by its entries. Thresholds are the first one and the logarithms of the steps to the next ones.
    """
    n = len(grades)
    theta = np.zeros(features + levels - 1)
    theta[features] = 1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, steps = theta[:features], np.exp(theta[features + 1 :])
        cuts = theta[features] + np.concatenate([[0.0], np.cumsum(steps)])
        link = np.bincount(rows, weights[columns] * values, minlength=n)
        reach = np.concatenate([np.ones((n, 1)), _sigmoid(link[:, None] - cuts), np.zeros((n, 1))], axis=1)
        slope = reach * (1 - reach)
        at = np.arange(n)
        likely = np.maximum(reach[at, grades] - reach[at, grades + 1], 1e-12)
        of_link = (slope[at, grades] - slope[at, grades + 1]) / likely
        of_cut = np.zeros((n, levels - 1))
        low, high = grades > 0, grades < levels - 1
        of_cut[at[low], grades[low] - 1] -= (slope[at, grades] / likely)[low]
        of_cut[at[high], grades[high]] += (slope[at, grades + 1] / likely)[high]
        of_cut = of_cut.mean(axis=0)
        gradient = np.empty_like(theta)
        gradient[:features] = np.bincount(columns, of_link[rows] * values, minlength=features) / n - RIDGE * weights
        gradient[features] = of_cut.sum()
        gradient[features + 1 :] = np.cumsum(of_cut[::-1])[::-1][1:] * steps
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:features], theta[features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[features + 1 :]))])


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, key: str, text: str) -> pa.Table:
    """toxic, n_words, features and counts of the sampled documents."""

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [text_features(x) for x in batch.column(text).to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "toxic": batch.column("toxic").cast(pa.int32()),
            "n_words": pa.array([n for _, n in found], pa.int64()),
            "features": pa.array([np.array(list(c), dtype="<u4").tobytes() for c, _ in found], pa.binary()),
            "counts": pa.array([np.array(list(c.values()), dtype="<u4").tobytes() for c, _ in found], pa.binary()),
        })

    out = schema(("toxic", "integer"), ("n_words", "long"), ("features", "binary"), ("counts", "binary"))
    return map_batches(labelled(docs, labels, "toxic", per_class, key, text), features, out).toArrow()


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, without copies of single rows, and how many each row has."""
    data, starts = payload_view(column.combine_chunks())
    return data[starts[0] : starts[-1]].view("<u4"), np.diff(starts) // 4


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Severity:
    """A model of labels.toxic. Without toxic or without clean labelled documents nothing counts as toxic."""
    try:
        return _fitted(_sample(docs, labels, per_class, key, text))
    finally:
        hand_back()


def _fitted(sample: pa.Table) -> Severity:
    toxic = np.array(sample.column("toxic").to_pylist(), dtype=np.int64)
    never = Severity({}, tuple(20.0 + k for k in range(GRADES - 1)))
    if not toxic.size or toxic.min() == toxic.max():
        return never
    n_words = np.array(sample.column("n_words").to_pylist(), dtype=np.int64)
    (found, sizes), (counts, _) = (_numbers(sample.column(c)) for c in ("features", "counts"))
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    names = np.unique(found)
    columns = np.searchsorted(names, found).astype(np.int32)
    of_toxic = (toxic == 1)[rows]
    held = np.stack([np.bincount(columns[of_toxic == y], minlength=len(names)) for y in (False, True)])
    of = np.array([(toxic == 0).sum(), toxic.sum()])[:, None]
    share = held / of
    pooled = held.sum(axis=0) / of.sum()
    z = (share[1] - share[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / of).sum())
    kept = np.abs(z) >= SELECTED_Z
    marks = (z >= SELECTED_Z) & (held[0] * 20 < held[1])
    number = np.cumsum(kept) - 1
    # only the entries of the kept features, few of all, are needed from here on
    entry = kept[columns]
    rows, columns, counts = rows[entry].astype(np.int64), columns[entry], counts[entry]
    del sample, found, of_toxic, entry
    dose = np.bincount(rows, counts * marks[columns], minlength=len(toxic)) / np.maximum(n_words, 1)
    edges = np.quantile(dose[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(toxic == 1, 1 + np.searchsorted(edges, dose, side="right"), 0)
    grades = np.unique(grades, return_inverse=True)[1]  # equal doses can leave grades out
    levels = int(grades.max()) + 1
    weights, cuts = fit_ordinal(rows, number[columns], value(counts, n_words[rows]), grades, int(kept.sum()), levels)
    return Severity(dict(zip(names[kept].tolist(), weights.tolist(), strict=True)), tuple(cuts.tolist()))


class _Known(dict):
    """The model's features of each word, remembered."""

    def __init__(self, weights: dict[int, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(f for f in word_features(word) if f in self.weights)
        if len(self) < REMEMBERED:
            self[word] = found
        return found


def score(docs: DataFrame, model: Severity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with expected_severity (0 to the top grade), p_toxic, grade (the most probable one) and toxic (p_toxic >= 0.5).

    Null and empty texts are scored from the thresholds alone. All rows and columns stay; columns of these names are replaced.
    """
    made = ("expected_severity", "p_toxic", "grade", "toxic")
    docs = docs.drop(*made)
    columns, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*docs.schema.fields])
    for name, of in zip(made, ("double", "double", "integer", "boolean"), strict=True):
        out.add(name, of)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value.weights)
        for batch in batches:
            found = []
            for value_ in batch.column(text).to_pylist():
                own = words(value_)
                counts = Counter(f for hit in filter(None, map(known.__getitem__, own)) for f in hit)
                reach = shared.value.at_least(counts, max(1, len(own)))
                odds = -np.diff([1.0, *reach, 0.0])
                found.append((sum(reach), reach[0], int(odds.argmax()), reach[0] >= 0.5))
            results = zip(made, (pa.float64(), pa.float64(), pa.int32(), pa.bool_()), zip(*found, strict=True) if found else [()] * 4, strict=True)
            new = {name: pa.array(values, of) for name, of, values in results}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | new)

    return docs.mapInArrow(lean(rate), out)


def severity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit on the labelled documents and score all."""
    return score(docs, fit(docs, labels, per_class, key, text), key, text)
