"""Quality: accuracy on held-out rows, scores against the plain average of embeddings, odd input."""

import random
import zlib

import numpy as np
import pytest

from voxelloom.llm import quality


@pytest.fixture(scope="module")
def rated(spark, prose):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(450):
        text, good = prose(rng, rng.randint(20, 80)), i % 3 > 0
        if not good:
            text = " ".join(f"{w}%%" for w in text.split()) if i % 2 else " ".join(w for w in text.split()[:8] for _ in range(9))
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int").cache()


def test_held_out_rows(rated):
    _, labels, docs, known = rated
    found = {r["doc_id"]: r for r in quality.assess(docs, known).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in found.items())
    held = [(found[i]["predicted"], y) for i, y in labels if found[i]["held_out"]]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) >= 0.95


def test_held_out_labels_are_not_used(rated):
    _, _, docs, known = rated
    wrong = known.withColumn("quality", (quality.held_out().cast("int") + known["quality"]) % 2)
    pick = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    assert pick(quality.assess(docs, known)) == pick(quality.assess(docs, wrong))


def test_score_is_the_average_of_all_vectors(rated):
    texts, _, docs, _ = rated
    random_ = np.random.default_rng(1)
    model = quality.Quality(random_.normal(size=quality.BUCKETS), 0.3)
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, text in texts[:80]:
        features, shares = quality.text_features(text)
        assert found[i] == pytest.approx(1 / (1 + np.exp(-(shares @ model.odds[features] + 0.3))))
        assert shares.sum() == pytest.approx(1)


def test_subwords_carry_over_to_new_words(rated):
    whole, part = set(quality.chunk_features("straight")), set(quality.chunk_features("straighter"))
    assert len(whole & part) > len(whole) // 2


def test_odd_rows(spark, odd, empty, rated):
    _, _, docs, known = rated
    got = quality.assess(odd, known)
    assert got.count() == odd.count() and all(0 <= r["score"] <= 1 for r in got.collect())
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in quality.assess(odd, known.limit(0)).collect())
    assert quality.assess(empty, known).count() == 0
    clash = known.selectExpr("doc_id", "quality", "'x' as text", "1.0 as score")
    assert quality.assess(docs, clash).count() == 450
