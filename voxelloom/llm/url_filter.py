"""URL filter: rules, and for what no rule fits a naive Bayes model of segmented host names.

Host names run words together. The words of a host are found by Viterbi over a unigram model: the likeliest split of each run of
letters, by how often the words stand in the documents of the corpus. Words that no document has cost more the
longer they are, so a name that is no sequence of known words stays whole.

The model learns from the URLs themselves: one whose host holds a word of a list of unwanted words, as a word and not within
one, counts as unwanted, and multinomial naive Bayes over all words of host and path finds what goes with them. Words
are hashed to 2^18 numbers, so the model has a bounded size whatever the number of words; two words share a number
once in 260 000 pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from itertools import groupby
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxelloom.llm.common import FEW_KEYS, LOWER, UPPER, dealt_join, kind, map_batches, schema, stored, words

Rule = tuple[str, str]
#: (verdict, host and path) of the production rules.
RULES: tuple[Rule, ...] = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Words that mark a host as unwanted. A parameter; any list will do.
UNWANTED = (
    "ads", "adult", "bet", "bets", "betting", "casino", "escort", "escorts", "gambling", "loans", "lottery", "payday",
    "pills", "poker", "porn", "replica", "sex", "slots", "spam", "viagra", "warez", "xxx",
)

#: Letters of the longest word of the unigram model.
LONGEST = 24
#: An unwanted word counts as if it stood this often in the documents, besides where it does.
SUPPOSED = 10
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Hashed words of the model.
BUCKETS = 1 << 18
#: Added to every count of the model.
SMOOTHING = 1.0
#: Most rows and characters of a table of hosts that is broadcast.
BROADCAST_CHARS = 64 << 20

_RUN = re.compile("[a-z]+")
_TOKEN = re.compile("[a-z]+|[0-9]+|[^\x00-\x7f]+")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _parted(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def ruled(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Of rules of one length a block goes first, then the least."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(set(rules), key=lambda r: (-len(r[1]), r[0] != "block", r[1]), reverse=True):
        of, start = _parted(text)
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def unigrams(docs: DataFrame, extra: Sequence[str] = UNWANTED, text: str = "text") -> DataFrame:
    """word and n, how often each word of at most ``LONGEST`` ASCII letters stands in all documents.

    Words of ``extra`` have ``SUPPOSED`` more. A row without a word has the number of all words in n.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes | None] = Counter()
        for batch in batches:
            for value in batch.column("text"):
                own = words(value.as_py())
                found.update(own)
                found[None] += len(own)
                if len(found) > HELD_WORDS:
                    yield _counted(found)
                    found = Counter()
        yield _counted(found)

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, schema(("word", "string"), ("n", "long")))
    added = docs.sparkSession.createDataFrame([(w, SUPPOSED) for w in sorted(set(extra))], schema(("word", "string"), ("n", "long")))
    return rows.unionByName(added).groupBy("word").agg(F.sum("n").alias("n"))


def _counted(found: Counter[bytes | None]) -> pa.RecordBatch:
    own = {w: n for w, n in found.items() if w is None or (w.isalpha() and len(w) <= LONGEST)}
    names = pa.array([None if w is None else w.decode() for w in own], pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array(list(own.values()), pa.int64())], names=["word", "n"])


def split_run(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run of letters; of equally likely splits the one whose last words are longest.

    A word of the model has its share of all words as probability, a word of n letters that it lacks 10 in ``total`` * 10^n.
    """
    total = max(total, 1)
    best, back = [0.0], [0]
    unknown, jumps = [], []
    for end in range(1, len(run) + 1):
        # words of the model
        score, start = -np.inf, 0
        for at in range(max(0, end - LONGEST), end):
            if n := counts.get(run[at:end]):
                found = best[at] + float(np.log(n / total))
                if found > score:
                    score, start = found, at
        # an unknown word from its best beginning, whatever its length: best[at] + at * log 10 does not depend on the end
        unknown.append(best[end - 1] + (end - 1) * _TEN)
        jumps.append(end - 1 if not jumps or unknown[-1] > unknown[jumps[-1]] else jumps[-1])
        found = unknown[jumps[-1]] - end * _TEN + float(np.log(10 / total))
        if found > score:
            score, start = found, jumps[-1]
        best.append(score)
        back.append(start)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


_TEN = float(np.log(10.0))


_PIECE = schema(("id", "binary"), ("host", "string"), ("piece", "string"))
#: Pieces that a task hands on at once.
TOGETHER = 100_000


def _pieces(hosts: DataFrame) -> DataFrame:
    """A digest of each host with the host itself, and with every piece of its runs of letters that could be a word."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for host in batch.column("host").to_pylist():
            name = blake2b(host.encode(), digest_size=16).digest()
            rows.append((name, host, None))
            for run in set(_RUN.findall(host)):
                for at in range(len(run)):
                    rows += [(name, None, run[at:end]) for end in range(at + 1, min(len(run), at + LONGEST) + 1)]
                    if len(rows) > TOGETHER:
                        yield _batch(rows, _PIECE)
                        rows = []
        yield _batch(rows, _PIECE)

    return map_batches(hosts, cut, _PIECE)


def _batch(rows: list[tuple], out: T.StructType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in out)
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, out, strict=True)], names=out.names)


def segmented(hosts: DataFrame, docs: DataFrame, extra: Sequence[str] = UNWANTED, text: str = "text") -> DataFrame:
    """host and its words, for every different host.

    Counts come to the hosts by a join on the pieces, so the vocabulary of the corpus need not fit anywhere. An empty host, and
    one without ASCII letters, has no words.
    """
    pieces = stored(_pieces(hosts.select("host").distinct()).distinct())
    asked = pieces.filter("piece is not null").select(F.col("piece").alias("word")).distinct()
    counts = stored(unigrams(docs, extra, text))
    total = counts.filter("word is null").agg(F.sum("n").alias("n")).first()["n"] or 0
    known = stored(counts.filter("word is not null").join(asked, "word", "left_semi"))
    condition = pieces["piece"] == known["word"]
    # a word has at most LONGEST letters
    found = pieces.join(F.broadcast(known), condition) if known.count() <= FEW_KEYS else dealt_join(pieces, known, condition, "id")
    rows = found.select("id", "host", "piece", "n").unionByName(pieces.filter("piece is null").withColumn("n", F.lit(None).cast("long")))
    out = schema(("host", "string"), ("words", T.ArrayType(T.StringType())))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("id", "host", "piece", "n")), strict=True))
        done: list[tuple] = []
        for _, group in groupby(rows, key=lambda row: row[0]):
            host, own = "", {}
            for _, name, piece, n in group:
                if piece is None:
                    host = name
                else:
                    own[piece] = n
            done.append((host, [w for run in _RUN.findall(host) for w in split_run(run, own, total)]))
            if len(done) >= 1000:
                yield _batch(done, out)
                done = []
        yield _batch(done, out)

    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(split, out)


def tokens(host_words: list[str], path: str) -> list[str]:
    """The words of the host and the lower-cased words of the path; a number is a word that tells its length only."""
    return host_words + [f"#{len(w)}" if w[0].isdecimal() else w for w in _TOKEN.findall(path.lower())]


class Model(NamedTuple):
    """Naive Bayes as log odds of being unwanted: a prior and a weight for each hashed word."""

    prior: float
    weights: np.ndarray

    def score(self, own: list[str]) -> float:
        """The probability of being unwanted."""
        odds = self.prior + float(self.weights[[bucket(w) for w in own]].sum()) if own else self.prior
        return float(1 / (1 + np.exp(-np.clip(odds, -700, 700))))


def bucket(word: str) -> int:
    return crc32(word.encode()) % BUCKETS


def model_of(urls: np.ndarray, counts: np.ndarray) -> Model:
    """From the numbers of wanted and unwanted urls and the counts (2, buckets) of their words.

    Without urls of both kinds there is nothing to tell them by: none is unwanted, or all.
    """
    if not urls.all():
        return Model(1000.0 if urls[1] else -1000.0, np.zeros(counts.shape[1]))
    used = int((counts.sum(axis=0) > 0).sum())
    likely = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * max(used, 1))
    return Model(float(np.log(urls[1] / urls[0])), likely[1] - likely[0])


def trained(urls: DataFrame, unwanted: Sequence[str] = UNWANTED) -> Model:
    """The model of all urls, rows of (words of the host, path); a url is unwanted if a word of its host is."""
    listed = frozenset(unwanted)
    out = schema(("bucket", "integer"), ("wanted", "long"), ("unwanted", "long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)  # the last one counts urls
        for batch in batches:
            for own, path in zip(batch.column("words").to_pylist(), batch.column("path").to_pylist(), strict=True):
                kind_ = int(not listed.isdisjoint(own))
                np.add.at(counts[kind_], [*map(bucket, tokens(own, path)), BUCKETS], 1)
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(row[used]) for row in counts)], names=out.names)

    sums = urls.select("words", "path").mapInArrow(count, out).groupBy("bucket").agg(F.sum("wanted").alias("a"), F.sum("unwanted").alias("b"))
    counts = np.zeros((2, BUCKETS + 1), dtype=np.float64)
    for row in sums.collect():  # one row per bucket at most
        counts[:, row["bucket"]] = row["a"], row["b"]
    return model_of(counts[:, BUCKETS], counts[:, :BUCKETS])


def with_words(rows: DataFrame, split: DataFrame, spread: str) -> DataFrame:
    """The rows with the words of their hosts; a host may be that of most rows."""
    size = split.agg(F.count("*").alias("n"), F.sum(F.length("host")).alias("chars")).first()
    condition = rows["host"] == split["host"]
    if size["n"] <= FEW_KEYS and (size["chars"] or 0) <= BROADCAST_CHARS:
        return rows.join(F.broadcast(split), condition).drop(split["host"])
    return dealt_join(rows, split, condition, spread, "path").drop(split["host"])


def judge(pages: DataFrame, docs: DataFrame, rules: Sequence[Rule] = RULES, unwanted: Sequence[str] = UNWANTED, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, score (probability of being unwanted by the model) and host_words of every row.

    A null url and one without ``://`` have an empty host and path and are judged by the model like any other. Rows with equal
    keys or urls are judged each for itself. Without documents only the unwanted words themselves are known; without pages
    there are no rows.
    """
    rows = pages.select(F.col(key).alias("_page"), host_of(F.col(url).cast("string")).alias("host"), path_of(F.col(url).cast("string")).alias("path"))
    rows = stored(with_words(rows, stored(segmented(rows, docs, unwanted)), "_page"))
    model = docs.sparkSession.sparkContext.broadcast(trained(rows, unwanted))
    out = schema((key, kind(rows, "_page")), ("host", "string"), ("path", "string"), ("score", "double"), ("host_words", "string"))

    def rate(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("words").to_pylist()
        scores = [model.value.score(tokens(own, path)) for own, path in zip(lists, batch.column("path").to_pylist(), strict=True)]
        joined = pa.array([" ".join(own) for own in lists], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_page", "host", "path")), pa.array(scores, pa.float64()), joined], names=out.names)

    rated = map_batches(rows, rate, out)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return rated.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score", "host_words")
