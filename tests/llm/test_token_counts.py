"""Rollups: totals equal a recount after every batch, batches count once, odd input."""

from collections import Counter

from tokenizers import Tokenizer

from voxelloom.llm import queries, token_counts
from voxelloom.llm.common import words
from voxelloom.llm.tokens import word_bpe


def recount(rows):
    plain, total = Tokenizer.from_file(word_bpe()), Counter()
    for r in rows:
        text = r["text"] or ""
        for name, n in (("word_bpe_49k", len(plain.encode(text, add_special_tokens=False).ids)), ("words_1", len(words(text)))):
            total[(r["source"], r["lang"], name, "docs")] += 1
            total[(r["source"], r["lang"], name, "tokens")] += n
    return +total


def totals(store):
    found = Counter()
    for r in store.totals().collect():
        for c in ("docs", "tokens"):
            found[(r["source"], r["lang"], r["tokenizer"], c)] += r[c]
    return +found


def test_batches_add_up(spark, tmp_path, prose):
    import random

    rng = random.Random(2)
    make = lambda ids, source: spark.createDataFrame([(i, prose(rng, 9 + i), source, "en") for i in ids], "doc_id long, text string, source string, lang string")
    store = token_counts.CountStore(spark, str(tmp_path / "counts"))
    first, second = make(range(10), "a").cache(), make(range(5, 12), "b").cache()
    assert store.upsert("one", first) and not store.upsert("one", second)
    assert totals(store) == recount(first.collect())
    assert store.upsert("two", second)  # 5 to 9 are revised and move to another source
    now = [r for r in first.collect() if r["doc_id"] < 5] + second.collect()
    assert totals(store) == recount(now)
    gone = spark.createDataFrame([(3,), (11,), (99,)], "id long")
    assert store.delete("three", gone) and not store.delete("three", gone)
    assert totals(store) == recount([r for r in now if r["doc_id"] not in (3, 11)])
    assert store.batches() == ["one", "two", "three"]


def test_query_counts_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert token_counts.exact_copies(docs).count() > 0
    found = Counter()
    for r in queries.op1_token_counts(spark, small).collect():
        for c in ("docs", "tokens"):
            found[(r["source"], r["lang"], r["tokenizer"], c)] += r[c]
    assert +found == recount(docs.collect())


def test_broken_off_batch_is_written_anew(spark, tmp_path, prose):
    import random

    docs = spark.createDataFrame([(1, prose(random.Random(1), 5), "a", "en")], "doc_id long, text string, source string, lang string").cache()
    store = token_counts.CountStore(spark, str(tmp_path / "counts"))
    store.write(0, "ledger", spark.createDataFrame([(1, "a", "en", "words_1", 5, 500)], store.entry))  # never committed
    assert totals(store) == {}
    store.upsert("one", docs)
    assert totals(store) == recount(docs.collect())


def test_odd_rows(spark, odd, empty, tmp_path):
    store = token_counts.CountStore(spark, str(tmp_path / "counts"))
    store.upsert("none", empty)
    assert totals(store) == {}
    store.upsert("all", odd)
    assert totals(store) == recount(odd.collect())
    store.delete("null", spark.createDataFrame([(None,), (1,)], "id long"))
    assert totals(store) == recount([r for r in odd.collect() if r["doc_id"] not in (None, 1)])
    copies = sorted(r["doc"] for r in token_counts.exact_copies(odd).collect())
    assert copies == [2]
