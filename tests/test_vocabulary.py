"""Keyword tables: both routes against `in`, rules and labels against loops."""

import random

import pytest

from sievework.operators.vocabulary import keyword_hits, relevance, scored, word_table


def some_rows(seed=2):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n)).strip()
    words = {word(r.randrange(1, 9)) for _ in range(400)} - {""} | {"aaaa", "aaaaa", "ABCD", "é", "a.b*", "日本", "日"}
    texts = [(k, word(r.randrange(0, 60))) for k in range(300)] + [(900, None), (901, ""), (902, "AAAAAAA"), (903, "x日本y a.b* abcd"), (904, "abcdé" * 3000)]
    return sorted(words), texts


@pytest.mark.parametrize("most", [10**6, 0])
def test_hits_equal_containment(spark, most):
    words, texts = some_rows()
    table = spark.createDataFrame([(w, 1) for w in words] + [("", 1), (None, 1), ("aaaa", 1)], "keyword string, n int")
    rows = spark.createDataFrame(texts, "id long, text string")
    got = sorted(map(tuple, keyword_hits(rows, table, most).collect()))
    assert got == sorted({(i, w.lower()) for i, t in texts for w in words if t and w.lower() in t.lower()}) and len(got) > 3000
    assert keyword_hits(rows, table.limit(0), most).count() == 0 == keyword_hits(rows.limit(0), table, most).count()


def test_plan_does_not_grow_with_the_table(spark):
    rows = spark.createDataFrame([(1, "w17 and w170")], "id long, text string")
    plans = []
    for n in (10, 5000):
        words = spark.range(n).selectExpr("concat('w', id) as keyword")
        for most in (10**6, 0):
            hits = keyword_hits(rows, words, most)
            assert hits.count() == (1 if n == 10 else 3)
            plans.append(len(hits._jdf.queryExecution().optimizedPlan().toString().split("\n")))
    assert plans[0] == plans[2] and plans[1] == plans[3]


def test_relevance_and_scores(spark):
    words = [("de", "push", "country", "berlin", 3), ("fr", "ingest", "country", "paris", 2), (None, "push", "region", "alps", 1), (None, "ingest", "foreign", "tokyo", 1), ("fr", "push", "country", "lyon", 1), ("fr", "push", "country", "lyon", 1)]
    r = random.Random(1)
    rows = [(k, r.choice(["de", "fr"]), r.choice([None, "de", "fr", "intl"]), " ".join(r.sample(["Berlin", "PARIS", "alps", "tokyo", "lyon", "x"], r.randrange(3)))) for k in range(200)]

    def by_hand(country, source, text):
        known = [w for w in words if w[3] in text.lower() and (source or w[1] == "push")]
        if any(w[2] == "country" and w[0] == country for w in known):
            return True, "own"
        for kind, rule, keep in (("region", "region", True), ("country", "other", False), ("foreign", "foreign", False)):
            if any(w[2] == kind for w in known):
                return keep, rule
        return (True, "push") if source is None else (source == country and source != "intl", "source")

    table = spark.createDataFrame(words, "country string, side string, kind string, keyword string, weight int")
    asked = spark.createDataFrame(rows, "id long, country string, source_country string, text string")
    hits = keyword_hits(asked.select("id", "text"), table)
    got = {x.id: (x.relevant, x.rule) for x in relevance(asked.drop("text"), hits, table).collect()}
    assert got == {i: by_hand(c, s, t) for i, c, s, t in rows} and len({x[1] for x in got.values()}) == 6
    want = {i: sum(w[4] for w in words if w[3] in t.lower()) for i, _, _, t in rows}
    assert {x.id: x.score for x in scored(hits, table).collect()} == {i: n for i, n in want.items() if n}


def test_learned_table(spark):
    rows = spark.createDataFrame([("de", "a", "haus haus garten"), ("de", "a", "Haus gemeinsam"), ("fr", "b", "maison gemeinsam"), ("fr", "b", "maison haus"), ("xx", "b", "gemeinsam fremdes"), ("xx", "c", "fremdes")], "country string, category string, content string")
    got = {r.keyword: (r.country, r.side, r.kind, r.category, r.weight) for r in word_table(rows, ["de", "fr"]).collect()}
    assert got == {"haus": ("de", "ingest", "country", "a", 1), "maison": ("fr", "ingest", "country", "b", 2), "gemeinsam": (None, "ingest", "region", "b", 3), "fremdes": (None, "ingest", "foreign", "c", 2)}
