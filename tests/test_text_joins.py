"""Common substrings and longest prefixes against plain loops."""

import random

from pyspark.sql import functions as F

from sievework.operators.prefixes import explained_languages, longest_prefix, prefixes
from sievework.operators.substrings import common_substrings, longest_common, quoted_spans


def longest_by_hand(a, b):
    return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)


def test_longest_common():
    r = random.Random(3)
    text = lambda: "".join(r.choice("abcñ日") for _ in range(r.randrange(30)))
    for _ in range(400):
        a, b = text(), text()
        n, at = longest_common(a, b)
        assert n == longest_by_hand(a, b) and b[at : at + n] in a and len(b[at : at + n]) == n
    assert longest_common("ab" * 40000, "ba" * 30000)[0] == 60000


def test_common_substrings(spark):
    rows = spark.createDataFrame([(1, "the same words", "not the same word"), (2, None, "x"), (3, "", ""), (4, "😀bc", "a😀b")], "id long, a string, b string")
    assert sorted(map(tuple, common_substrings(rows, "id", "a", "b").collect())) == [(1, 13, "the same word"), (2, 0, ""), (3, 0, ""), (4, 2, "😀b")]


def test_quoted_spans(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abc ,") for _ in range(n))
    reasons, sources = [(k, text(60)) for k in range(20)] + [(90, None), (91, "ab")], [(k, text(80)) for k in range(30)] + [(90, None), (91, "")]
    only = lambda t: "".join(c for c in t or "" if c.isalnum())
    want = {(i, j, n) for i, a in reasons for j, b in sources if (n := longest_by_hand(only(a), only(b))) >= 9}
    got = quoted_spans(spark.createDataFrame(reasons, "reason_id long, text string"), spark.createDataFrame(sources, "source_id long, text string"), 9).collect()
    assert {(x.reason_id, x.source_id, x.n_common) for x in got} == want and len(want) > 10
    assert all(len(x.common) == x.n_common and x.common in only(dict(sources)[x.source_id]) for x in got)


def test_prefixes_of_any_depth(spark):
    r = random.Random(2)
    path = lambda most: "/" + "/".join(r.choice("ab") for _ in range(r.randrange(most)))
    known = [(r.choice("hi"), path(6), r.choice("xyz")) for _ in range(60)] + [("h", "", "x"), ("h", "/a/", "y"), (None, "/a", "z"), ("h", "/b", None)]
    asked = [(k, r.choice(["h", "h", "i", "j"]), path(8)) for k in range(300)] + [(900, "h", None), (901, None, "/a"), (902, "h", "//a//b/"), (903, "h", "/ab")]
    parts = lambda p: [s for s in (p or "").split("/") if s]

    def by_hand(host, p):
        own = parts(p)
        for n in range(len(own), -1, -1):
            names = {name for h, q, name in known if host and h == host and name and parts(q) == own[:n]}
            if names:
                return "".join(f"/{s}" for s in own[:n]), names.pop() if len(names) == 1 else None
        return None, None

    got = longest_prefix(spark.createDataFrame(asked, "id long, host string, path string"), spark.createDataFrame(known, "host string, prefix string, name string")).collect()
    assert {x.id: (x.prefix, x.name) for x in got} == {i: by_hand(h, p) for i, h, p in asked}
    assert spark.range(1).select(prefixes(F.lit("/a/b"))).first()[0] == ["", "/a", "/a/b"]


def test_language_rules(spark):
    rules = [
        ("r1", "h", ["/ru/"], ["/ru/old/"], "en", "ru", 5, 4, "verified"), ("r0", "h", ["/ru/"], [], "en", "ru", 5, 6, "verified"), ("r2", "h", ["/"], [], "en", "kk", 5, 4, "draft"),
        ("r3", "i", ["/a/b/"], [], "en-US", "ru", 5, 5, "verified"), ("r4", "h", ["/ru/"], [], "en", "ru", 99, 4, "verified"), ("r5", "h", [], [], "en", "ru", 5, 4, "verified"),
    ]
    pages = [
        (1, "h", "/ru/x", "en", "ru", 9), (2, "h", "/ru/old/x", "en", "ru", 9), (3, "h", "/ru/x", "en", "ru", 4), (4, "h", "/rus/x", "en", "ru", 9), (5, "i", "/a/b/c", "EN-us", "ru", 9),
        (6, "h", "/ru/x", "ru_KZ", "ru", 9), (7, "h", "/ru/x", None, "ru", 9), (8, "h", "/ru/x", "en", "en", 9), (9, "j", "/ru/x", "en", "ru", 9),
    ]
    got = explained_languages(
        spark.createDataFrame(pages, "id long, host string, path string, declared string, wanted string, at long"),
        spark.createDataFrame(rules, "rule string, host string, prefixes array<string>, excluded array<string>, declared string, content string, reviewed_at long, evidence_at long, status string"),
    ).collect()
    assert {x.id: tuple(x)[1:] for x in got} == {
        1: ("r1", None, False, False), 2: (None, "en", False, False), 3: (None, "en", False, False), 4: (None, "en", False, False), 5: ("r3", None, False, False),
        6: (None, "ru", True, True), 7: (None, None, False, None), 8: (None, "en", True, True), 9: (None, "en", False, False),
    }
