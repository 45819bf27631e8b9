"""Phrases and proximity against brute force, blocks against one block, odd input."""

import random

import pytest
from pyspark.sql import functions as F

from voxelloom.llm import decontamination as dc
from voxelloom.llm.common import words


def brute(docs, items, size):
    phrases = {}
    for key, text in items:
        own = words(text)
        for at in range(max(1, len(own) - size + 1)) if own else ():
            phrases.setdefault(tuple(own[at : at + size]), set()).add("null" if key is None else str(key))
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for length in {len(p) for p in phrases}:
            for at in range(len(own) - length + 1):
                if names := phrases.get(tuple(own[at : at + length])):
                    hit |= set(range(at, at + length))
                    found |= names
        out.append((key, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


def corpus(prose, seed=4):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 25]))) for i in range(25)] + [(None, prose(rng, 12)), (3, prose(rng, 14)), (30, ""), (31, None)]
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            start = rng.randint(0, max(0, len(own) - 8))
            parts += [" ".join(own[start : start + rng.randint(5, 25)]).upper(), prose(rng, rng.randint(0, 5))]
        docs.append((i, ", ".join(parts)))
    return docs, items


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark, prose):
    docs, items = corpus(prose)
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("size", [4, 10])
def test_phrases(tables, size):
    docs, items, d, i = tables
    got = dc.contamination(d, i, size)
    assert found(got) == brute(docs, items, size)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got.collect())


def test_blocks_change_nothing(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(dc, "BLOCK_PAIRS", 40)
    monkeypatch.setattr(dc, "CANDIDATES", 16)
    assert len(dc.index_for(d, i, 4)[1]) > 2
    assert found(dc.contamination(d, i, 4)) == brute(docs, items, 4)


@pytest.mark.parametrize("distance", [2, 7])
def test_proximity(tables, distance):
    docs, items, d, i = tables
    index, pairs = dc.index_for(d, i, 4)
    got = {r["doc_id"]: r["items"] for r in dc.proximity_matches(index, pairs, distance).collect()}
    phrases = {}
    for key, text in items:
        own = words(text)
        for at in range(max(1, len(own) - 3)) if own else ():
            phrases.setdefault(tuple(own[at : at + 4]), set()).add("null" if key is None else str(key))
    for key, text in docs:
        own, want = words(text), set()
        # the documents are one shard here only if they come in one batch, so any rarest term may have been used
        for phrase, names in phrases.items():
            near = lambda at: all(term in own[max(0, at - distance) : at + distance + 1] for term in phrase)
            if any(own[at] in phrase and near(at) for at in range(len(own))):
                want |= names
        assert set(got[key]) <= want
        exact = {n for phrase, names in phrases.items() for n in names if any(tuple(own[a : a + len(phrase)]) == phrase for a in range(len(own)))}
        if distance >= 3:
            assert exact <= set(got[key])


def test_odd_rows(spark, odd, empty, tables):
    _, items, _, i = tables
    more = i.unionByName(spark.createDataFrame([(77, "null byte and odd"), (78, "日本語のテキスト")], "item_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(dc.contamination(odd, more.withColumn("items", F.lit(1)))) == brute(rows, [*items, (77, "null byte and odd"), (78, "日本語のテキスト")], 10)
    assert dc.contamination(empty, more).count() == 0
    assert all(r["n_hit"] == 0 for r in dc.contamination(odd, more.limit(0)).collect())
    kept = dc.decontaminate(odd, more)
    hit = {r[0] for r in found(dc.contamination(odd, more)) if r[2]}
    assert kept.columns == odd.columns and {12, 13} <= hit and {i for i, _ in rows} - {r["doc_id"] for r in kept.collect()} == hit
    with pytest.raises(ValueError):
        dc.index_for(odd, more, dc.GAP)
