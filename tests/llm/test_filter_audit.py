"""Filter interaction audit: every count against going through the documents, odd input."""

import random
import re
from itertools import permutations

import numpy as np

from voxelloom.llm import filter_audit


def fails(text):
    own = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        "A": len(own) < 200,
        "B": 100 * len(set(own)) < 50 * len(own),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def brute(docs, labels):
    """Apply the filters one after the other to lists of documents."""
    good, bad = ({i for i, q, t in labels if i is not None and (q, t)[at] == 1} for at in (0, 1))
    parts = {}
    for i, text, source in docs:
        found = fails(text or "")
        found["E"] = i is not None and any(o is not None and o < i and (t or "") == (text or "") for o, t, _ in docs)
        parts.setdefault(source or "", []).append((i, found))
    out = []
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [row for row in left if row[1][f]]
                left = [row for row in left if not row[1][f]]
                alone = sum(1 for _, found in rows if found[f] and sum(found.values()) == 1)
                failing = sum(1 for _, found in rows if found[f])
                removed_by[f] += len(gone)
                steps.append(((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone, sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)), f))
        out += [(*row, removed_by[f]) for row, f in steps]
    return sorted(out)


def found(df):
    return sorted(tuple(row) for row in df.collect())


def test_audit_equals_brute_force(spark, prose):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([1, 50, 250])) for _ in range(40)]
    texts += [" ".join(["same"] * 300), "ABC " * 210, "x # y", "", " \x1c\u00a0 ", "É" * 10]
    docs = [(i, rng.choice(texts) + rng.choice(["", "", " |", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"]), rng.choice(["a", "b", "", None])) for i in range(150)]
    labels = [(rng.randrange(170), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found(got) == brute(docs, labels)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert found(filter_audit.audit(odd, labels)) == brute(rows, [tuple(r) for r in labels.collect()])
    assert len(found(filter_audit.audit(odd.drop("score"), labels.limit(0)))) == 600
    assert filter_audit.audit(empty, labels).count() == 0


def test_copies_over_parts_and_repeated_keys(spark):
    """A third of all rows with one text, over all parts; the least key repeats."""
    docs = [(i % 97, "one text", f"p{i % 3}") for i in range(300)] + [(i, f"text {i}", f"p{i % 5}") for i in range(100)] + [(None, "one text", "p0")] * 3
    labels = [(0, 1, 0), (5, 0, 1)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found(got) == brute(docs, labels)


def test_contraction_sums_cells():
    tensors = np.zeros((1, 2, 2, 2, 2, 2, 3), dtype=np.int64)
    tensors[0, 1, 0, 0, 0, 0] = 5, 1, 2  # fail A only
    tensors[0, 1, 1, 0, 0, 0] = 7, 0, 0  # fail A and B
    tensors[0, 0, 0, 0, 0, 0] = 100, 50, 0
    got = filter_audit.contracted(tensors)
    first = filter_audit.orders().index("ABCDE") * 5
    assert [got[m][0, first] for m in filter_audit.MEASURES] == [100, 12, 0, 5, 1, 2, 60 * 12 + 60 * 5]
    assert [got[m][0, first + 1] for m in filter_audit.MEASURES] == [100, 0, 7, 0, 0, 0, 60 * 7]
