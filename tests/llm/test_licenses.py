"""Licence scan: every matching block and phrase against brute force, odd input."""

import math
import random

import pytest

from voxelloom.llm import licenses
from voxelloom.llm.common import words


def brute(key, text, templates, phrases, threshold):
    own, starts, base, matches = words(text), [], set(), []
    for phrase, label in phrases.items():
        p = words(phrase)
        at = [i for i in range(len(own)) if own[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    for label, template in templates:
        t = words(template)
        needed = math.ceil(round(threshold * len(set(t)), 9))
        for first in range(0, max(len(own), 1), len(t)):
            shared = len(set(own[first : first + 2 * len(t)]) & set(t))
            if shared >= max(1, needed):
                matches.append((label, first, min(len(own), first + 2 * len(t)), shared / len(set(t))))
    score = max((m[3] for m in matches), default=0.0)
    ends = (min(starts), max(starts)) if starts else (None, None)
    labels = base | {m[0] for m in matches}
    return (key, len(own), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(matches))


def found(df):
    return [(r["doc_id"], *(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")), sorted(map(tuple, r["matches"]))) for r in df.collect()]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_scan_equals_brute_force(spark, prose, threshold):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        parts = prose(rng, rng.randint(0, 40)).split()
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice([t for _, t in licenses.TEMPLATES] + list(licenses.PHRASES)).split()
            notice = [w for w in notice if rng.random() < rng.choice([0.7, 0.9, 1.0])]
            rng.random() < 0.3 and rng.shuffle(notice)
            at = rng.randint(0, len(parts))
            parts[at:at] = notice
        rows.append((i, " ".join(parts)))
    got = found(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold))
    assert sorted(got) == [brute(i, t, licenses.TEMPLATES, licenses.PHRASES, threshold) for i, t in rows]


def test_repeated_words_of_a_template_count_once(spark):
    templates = (("a", "to be or not to be"), ("none", "!!"))
    rows = [(1, "be or to not"), (2, "to to to be be be"), (3, "x " * 5 + "or not to x be")]
    got = found(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates, {"or not": "q"}))
    assert sorted(got) == [brute(i, t, templates[:1], {"or not": "q"}, 0.8) for i, t in rows]


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = found(licenses.scan(odd))
    assert sorted(got, key=str) == sorted((brute(i, t, licenses.TEMPLATES, licenses.PHRASES, 0.8) for i, t in rows), key=str)
    assert licenses.scan(empty).count() == 0
