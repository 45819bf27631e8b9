"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

All shingles of a text are hashed once. The hash's highest bits choose a bin and the least hash of a bin is its value. An empty bin
takes the value of the first bin with one among bins that a hash of its own number and the attempt picks, so that
different empty bins take from different ones. The lowest bits of each bin's value make up the fingerprint, one hexadecimal
digit a bin. Two bins agree by chance once in ``2 ** BITS``; ``likeness`` takes that out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins, a power of two, and the low-order bits kept of each.
BINS, BITS = 128, 4
#: Words of a shingle; a shorter text is one shingle.
SHINGLE = 5
#: Bins an empty one tries before it settles for the bin with the least hash.
ATTEMPTS = 24
#: Rows of neighbouring keys that are put in order together, and the most runs of such rows.
RUN_ROWS, MOST_RUNS = 500, 20_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _bin(value: Column) -> Column:
    """The bin of a signed 64-bit hash; bins ascend with the hash."""
    return F.shiftright(value, 65 - BINS.bit_length()).cast("int") + BINS // 2


def _shingles(text: Column) -> Column:
    """Hashes of the shingles, ascending; none for a text without words."""
    words = F.array_remove(F.split(F.lower(text), _NOT_WORD), "")
    hashes = F.transform(words, lambda word: F.xxhash64(word))

    def runs(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(own) - (SHINGLE - 1)))
        found = F.transform(starts, lambda at: F.xxhash64(F.slice(own, at, SHINGLE)))
        return F.when(F.size(own) > 0, found).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(_let(hashes, runs))


def _least(hashes: Column) -> Column:
    """The least hash of every bin that has one, by bin."""
    return _let(hashes, lambda own: F.filter(own, lambda x, at: (at == 0) | (_bin(x) != _bin(F.get(own, at - 1)))))


def _spread(least: Column) -> Column:
    """All bins in order, null where empty."""

    def laid_out(own: Column) -> Column:
        before = lambda at: F.when(at == 0, F.lit(-1)).otherwise(_bin(F.get(own, at - 1)))
        empty = F.lit(None).cast("bigint")
        parts = F.transform(own, lambda x, at: F.concat(F.array_repeat(empty, _bin(x) - before(at) - 1), F.array(x)))
        tail = F.array_repeat(empty, F.lit(BINS - 1) - _bin(F.element_at(own, -1)))
        return F.concat(F.flatten(parts), tail)

    return _let(least, laid_out)


def _densified(bins: Column, least: Column) -> Column:
    def filled(own: Column) -> Column:
        def value(x: Column, at: Column) -> Column:
            tries = [F.get(own, F.pmod(F.xxhash64(at, F.lit(attempt)), F.lit(BINS)).cast("int")) for attempt in range(ATTEMPTS)]
            rest = F.array_min(F.transform(least, lambda v: F.struct(F.xxhash64(at, _bin(v)).alias("h"), v.alias("v"))))["v"]
            return F.coalesce(x, *tries, rest)

        return F.transform(own, value)

    return _let(bins, filled)


def fingerprint(text: Column) -> Column:
    """``BINS`` hexadecimal digits; the empty string for texts without words, null and empty ones among them."""
    digits = F.split(F.lit("0123456789abcdef"), "")

    def packed(least: Column) -> Column:
        low = lambda v: F.get(digits, v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
        return F.array_join(F.transform(_densified(_spread(least), least), low), "")

    return _let(_least(_shingles(F.coalesce(text, F.lit("")))), lambda least: F.when(F.size(least) > 0, packed(least)).otherwise(F.lit("")))


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1; two texts without words are alike, one and another are not."""
    same = F.size(F.filter(F.zip_with(F.split(one, ""), F.split(other, ""), lambda a, b: a == b), lambda x: x))
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(one == other, F.lit(1.0)).when((one == "") | (other == ""), F.lit(0.0)).otherwise(estimate)


def _runs(docs: DataFrame, key: str) -> tuple[list, object]:
    """Keys at which the runs after the first one begin, taken from the table so that runs are about even; and the least key.

    Their number follows the number of rows up to ``MOST_RUNS``.
    """
    wanted = min(MOST_RUNS, docs.count() // RUN_ROWS)
    keys = docs.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(8 * wanted)
    found = sorted({row[0] for row in keys.collect()})
    least = docs.select(key).orderBy(F.col(key).asc_nulls_first()).limit(1).collect()
    bounds = [found[at] for at in range(len(found) // (2 * max(1, wanted)), len(found), max(1, len(found) // max(1, wanted)))]
    bounds = [b for b in bounds if not least or b != least[0][0]]
    return bounds, least[0][0] if least else None


def _count_up_to(bounds: list, key: Column) -> Column:
    """How many of the ascending bounds are at most the key, in two steps of the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*[F.lit(b) for b in bounds[::step]])
    parts = F.array(*[F.array(*[F.lit(b) for b in bounds[at : at + step]]) for at in range(0, len(bounds), step)])

    def fine(part: Column) -> Column:
        inside = F.size(F.filter(F.get(parts, part - 1), lambda b: b <= key))
        return F.when(part > 0, (part - 1) * step + inside).otherwise(F.lit(0))

    return _let(F.size(F.filter(heads, lambda b: b <= key)), fine)


def with_next(docs: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """Each row with next_<column> of the row that follows in ascending order of key and text; the first follows the last.

    Keys are ordered with null first. Rows are ordered run by run; those that begin a run also go to the run before it.
    """
    bounds, least = _runs(docs, key)
    at = _count_up_to(bounds, F.col(key))
    first = F.array(F.lit(None), *[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(None).cast(docs.schema[key].dataType))
    begins = F.coalesce(F.get(first, F.col("_run")) == F.col(key), F.lit(False))
    homes = F.array(
        F.struct(F.col("_run").alias("run"), F.lit(False).alias("guest")),
        F.when(begins, F.struct((F.col("_run") - 1).alias("run"), F.lit(True).alias("guest"))),
        F.when(F.col(key).eqNullSafe(F.lit(least)), F.struct(F.lit(len(bounds)).alias("run"), F.lit(True).alias("guest"))),
    )
    spread = docs.withColumn("_run", at).withColumn("_home", F.explode(F.filter(homes, lambda x: x.isNotNull())))
    order = Window.partitionBy("_home.run").orderBy("_home.guest", F.col(key).asc_nulls_first(), text)
    leads = spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return leads.filter(~F.col("_home.guest")).drop("_run", "_home")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    A document's edited text has its last ``n_chars // 2`` code points replaced by the first as many of the next document's.
    A single document is its own next. Rows with equal keys are ordered by text. Null texts are empty.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_print", fingerprint(F.col("_text")))
    rows = with_next(rows, key, "_text", ["_text", "_print"]).withColumn("n_chars", F.char_length("_text").cast("long"))
    half = (F.col("n_chars") / 2).cast("int")
    start = F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - half)
    rows = rows.withColumn("_edited", F.concat(start, F.substring(F.col("next__text"), F.lit(1), half)))
    rows = rows.select(key, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), F.col("_print").alias("fingerprint"), fingerprint(F.col("_edited")).alias("edited_fingerprint"), "next__print")
    near = [likeness(F.col("fingerprint"), F.col(c)).alias(n) for c, n in (("edited_fingerprint", "near_edited"), ("next__print", "near_next"))]
    return rows.select(key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
