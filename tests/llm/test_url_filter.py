"""URL filter: rules, segmentation and naive Bayes against plain versions, odd input."""

import math
import random
import re
from collections import Counter
from functools import lru_cache

import pytest

from voxelloom.llm import url_filter as uf
from voxelloom.llm.common import words


def parts(url):
    start = (url or "").find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    end = min([at for c in "/?#" if (at := rest.find(c)) >= 0] or [len(rest)])
    host, path = rest[:end], re.split("[?#]", rest[end:])[0]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule_of(host, path, rules=uf.RULES):
    fitting = []
    for verdict, rule in rules:
        of, _, start = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + start):
            fitting.append((-len(rule), verdict != "block", rule, verdict))
    return (min(fitting)[2:]) if fitting else (None, None)


def counts_of(texts, extra=uf.UNWANTED):
    found = Counter(w.decode() for t in texts for w in words(t))
    total = sum(found.values())
    return {w: n for w, n in found.items() if re.fullmatch("[a-z]{1,24}", w)} | {w: found[w] + uf.SUPPOSED for w in set(extra)}, total


def best_score(run, counts, total):
    @lru_cache(None)
    def best(end):
        if end == 0:
            return 0.0
        options = []
        for at in range(end):
            word = run[at:end]
            if len(word) <= uf.LONGEST and counts.get(word):
                options.append(best(at) + math.log(counts[word] / max(total, 1)))
            options.append(best(at) + math.log(10 / max(total, 1)) - len(word) * math.log(10))
        return max(options)

    return best(len(run))


def score_of(split, counts, total):
    score = 0.0
    for word in split:
        known = math.log(counts[word] / max(total, 1)) if counts.get(word) and len(word) <= uf.LONGEST else -math.inf
        score += max(known, math.log(10 / max(total, 1)) - len(word) * math.log(10))
    return score


def model(rows):
    """Prior odds and weights by bucket, from (words of the host, path)."""
    urls, found = [0, 0], [Counter(), Counter()]
    for own, path in rows:
        kind = int(bool(set(own) & set(uf.UNWANTED)))
        urls[kind] += 1
        found[kind].update(uf.bucket(w) for w in uf.tokens(own, path))
    if not all(urls):
        return None
    used = len(found[0].keys() | found[1].keys())
    sums = [sum(f.values()) + used for f in found]
    return math.log(urls[1] / urls[0]), lambda b: math.log((found[1][b] + 1) / sums[1]) - math.log((found[0][b] + 1) / sums[0])


def check(spark, pages, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = uf.judge(spark.createDataFrame([(*p, "<p>", 1.0, "x") for p in pages], "page_id long, url string, html string, score double, words string"), docs).collect()
    assert sorted((r["page_id"], r["host"], r["path"]) for r in got) == sorted((i, *parts(u)) for i, u in pages)
    counts, total = counts_of(texts)
    split = {}
    for r in got:
        own = r["host_words"].split()
        assert "".join(own) == "".join(re.findall("[a-z]+", r["host"]))
        at = 0
        for run in re.findall("[a-z]+", r["host"]):
            mine = []
            while sum(map(len, mine)) < len(run):
                mine.append(own[at])
                at += 1
            assert math.isclose(score_of(mine, counts, total), best_score(run, counts, total), rel_tol=1e-9)
        split[r["host"]] = own
    fitted = model([(split[parts(u)[0]], parts(u)[1]) for _, u in pages])
    for r in got:
        rule, verdict = rule_of(r["host"], r["path"])
        if fitted:
            prior, weight = fitted
            odds = prior + sum(weight(uf.bucket(w)) for w in uf.tokens(split[r["host"]], r["path"]))
            assert math.isclose(r["score"], 1 / (1 + math.exp(-odds)), rel_tol=1e-6, abs_tol=1e-9)
        assert r["rule"] == rule
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0.5 else "allow"))
    return {r["page_id"]: r for r in got}


TEXTS = ["the garden of cheap red pills and the casino", "red garden win win win", "the news of the day of the garden", None, "Hotel News " * 5]


@pytest.mark.parametrize("few", [uf.FEW_KEYS, 0])
def test_judge_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(uf, "FEW_KEYS", few)  # tables broadcast, and dealt over tasks
    rng = random.Random(4)
    names = ["cheappills", "casinowin", "redgarden", "gardennews", "thenewsoftheday", "zzyzx", "hotelnews", "adsads", "roads"]
    pages = []
    for i in range(400):
        host = "gardennews.net" if i % 3 == 0 else ".".join([rng.choice(["www", "m", "a-b", "x1"]), rng.choice(names) + rng.choice(["", "4", "-" + rng.choice(names)]), rng.choice(["com", "net", "org", "example.org"])])
        pages.append((i, rng.choice(["http://", "HTTPS://"]) + rng.choice([host, host.upper()]) + rng.choice(["", "/de/12", "/fr/x.html", "/en/1", "/es/2?q=/", "/casino/Win#a"])))
    got = check(spark, pages, TEXTS)
    found = {r["host"]: r["host_words"] for r in got.values()}
    assert found["gardennews.net"] == "garden news net"
    assert any("cheap pills" in w for w in found.values()) and any("the news of the day" in w for w in found.values())


def test_words_that_go_with_unwanted_ones_are_learned(spark):
    pages = [(i, f"http://casino-win{i % 5}.net/bonus") for i in range(40)] + [(100 + i, f"http://garden-news{i % 7}.net/day") for i in range(60)]
    got = check(spark, [*pages, (200, "http://win.net/bonus"), (201, "http://garden.net/"), (202, "http://roads.net/day")], TEXTS)
    assert got[200]["verdict"] == "block" and got[201]["verdict"] == got[202]["verdict"] == "allow"


def test_rules_take_the_longest(spark):
    urls = ["http://a.example.org/es/1", "http://example.org/en/17", "http://example.org/en/2", "http://org", "http://notorg/", "http://x.com/de/", "http://com/fr/1", "u://A.ORG/#"]
    got = check(spark, list(enumerate(urls)), TEXTS)
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), (None, "allow"), ("com/de/", "block"), ("com/fr/", "allow"), ("org/", "allow"),
    ]


def test_odd_urls(spark, odd):
    urls = [
        (1, None), (1, ""), (2, "no scheme.org/"), (3, "://"), (4, "http:///path"), (5, "a://b://c/d"), (None, "http://x.org/"), (None, None), (6, "http://ÄÖ.日本.net/Ü/x?y#z"),
        (7, "http://" + "garden" * 3000 + ".net/" + "a/" * 5000), (7, "http://x\ny.net/\n?z"), (8, "http://u:p@h.com:80/de/"), (8, "http://u:p@h.com/de/"),
    ]
    got = uf.judge(spark.createDataFrame(urls, "page_id long, url string"), odd).collect()
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=key) == sorted(((i, *parts(u), rule_of(*parts(u))[0]) for i, u in urls), key=key)
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow"}
    rows = spark.createDataFrame(urls, "page_id long, url string")
    assert uf.judge(rows.limit(0), odd).count() == 0
    assert uf.judge(rows, odd.limit(0)).count() == len(urls)
