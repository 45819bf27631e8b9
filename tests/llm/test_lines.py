"""Cuckoo filters, line dedup against brute force, insertion and deletion of documents, odd input."""

import random
from collections import Counter

import pytest

from voxelloom.llm import lines
from voxelloom.llm.cuckoo import CuckooFilter, build


def brute(rows, held=None, min_docs=3):
    """Texts without repeated lines; ``held`` are the documents of the store, if not the rows themselves."""
    key = lambda line: line.strip(" \t\n\v\f\r").encode().lower()
    long = lambda line: len(line.strip(" \t\n\v\f\r")) >= 20
    docs = {}
    for doc, text in rows if held is None else held:
        for line in (text or "").split("\n"):
            if long(line):
                docs.setdefault(key(line), set()).add(doc)
    order = lambda d: (d is not None, d or 0)
    last = {k: max(v, key=order) for k, v in docs.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if not long(x) or last.get(key(x), doc) == doc]
        out.append((doc, len(own), len(own) - len(left), text if len(own) == len(left) else "\n".join(left)))
    return Counter(out)


def found(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect())


def corpus(prose, n, seed):
    rng = random.Random(seed)
    common = [prose(rng, k) for k in (3, 6, 8, 9, 12)] + ["A Line With  Capitals and blanks"]
    spoil = lambda x: rng.choice([x, x.upper() if x.isascii() else x, f" \t{x}\r"])
    return [(i, "\n".join(spoil(rng.choice(common)) if rng.random() < 0.4 else prose(rng, rng.randint(0, 9)) for _ in range(rng.randint(0, 7)))) for i in range(n)]


def test_cuckoo_filter():
    rng = random.Random(1)
    keys = [rng.randbytes(16) for _ in range(5000)]
    filter_ = build(keys[:4000])
    assert filter_.contains(keys[:4000]).all() and filter_.contains(keys[4000:]).mean() < 0.01
    filter_ = CuckooFilter(filter_.buckets, filter_.tobytes())
    filter_.delete(keys[:2000])
    assert filter_.contains(keys[2000:4000]).all() and filter_.contains(keys[:2000]).mean() < 0.01
    assert not CuckooFilter(4).insert(keys[:50])
    assert not build([]).contains(keys[:3]).any()


def test_dedup_equals_brute_force(spark, prose, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK_ROWS", 7)  # shards are dealt out
    rows = corpus(prose, 80, 3)
    assert found(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_store_is_reversible(spark, prose, tmp_path):
    rows = corpus(prose, 60, 5)
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    store = lines.LineStore(spark, str(tmp_path / "lines"), 3)
    assert store.insert("a", frame(rows[:40])) and not store.insert("a", frame(rows))
    assert store.insert("b", frame(rows[30:]))  # ten of them are known
    assert found(store.rewrite(frame(rows))) == brute(rows)
    gone = {i for i, _ in rows if i % 3 == 0}
    assert store.delete("c", frame([(i, None) for i in gone]).select("doc_id"))
    held = [r for r in rows if r[0] not in gone]
    assert found(store.rewrite(frame(held))) == brute(held)
    repeated = {bytes(r["line"]) for r in store.counts().filter("n_docs >= 3").collect()}
    for r in store.filters().collect():
        own = [k for k in repeated if int.from_bytes(k[12:], "little") % 3 == r["shard"]]
        filter_ = CuckooFilter(r["buckets"], bytes(r["filter"]))
        assert filter_.contains(own).all() and (filter_.table > 0).sum() == len(own)  # deletions left nothing behind
    assert store.insert("d", frame([r for r in rows if r[0] in gone]))
    assert found(store.rewrite(frame(rows))) == brute(rows)


def test_odd_rows(odd, empty):
    got = lines.dedup_lines(odd)
    assert got.columns == [c for c in odd.columns if c not in ("n_lines", "_doc")] + ["n_lines", "n_dropped"]
    assert found(got) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert lines.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("line", ["x" * 20, " " + "é" * 20 + "\t"])
def test_length_is_in_code_points(line):
    assert lines.line_key(line) and not lines.line_key(line.strip()[1:])
