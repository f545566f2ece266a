import random

from sievework.operators.similarity import components, first_seen, similar_between, similar_pairs


def test_only_kept_rows_own_their_keys(spark):
    rows = spark.createDataFrame([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u2", "t2"), (4, None, ""), (5, None, "")], "id long, u string, t string")
    assert {r.id: r.kept for r in first_seen(rows, ["u", "t"]).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}


def test_first_seen_equals_a_fold(spark):
    rng = random.Random(1)
    data = [(i, f"u{rng.randrange(25)}", f"t{rng.randrange(25)}") for i in range(80)]
    seen, want = set(), {}
    for i, u, t in data:
        want[i] = not ({("u", u), ("t", t)} & seen)
        if want[i]:
            seen |= {("u", u), ("t", t)}
    assert {r.id: r.kept for r in first_seen(spark.createDataFrame(data, "id long, u string, t string"), ["u", "t"]).collect()} == want


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {r.id: r.root for r in components(pairs).collect()} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_empty_tables(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert first_seen(spark.createDataFrame([], "id long, u string"), ["u"]).count() == 0
    assert similar_pairs(spark.createDataFrame([], "id long, block string, title string"), 0.9).count() == 0


def test_similar_pairs_gathers_no_title(spark):
    rows = [(3, "a", "One title of many"), (1, "a", "One title of many"), (2, "a", "one  title of many"), (2, "a", "One title of many"), (4, "b", "One title of many"), (5, "a", ""), (6, "a", " "), (7, "a", None), (8, None, "No block"), (9, None, "No block")]
    pairs = similar_pairs(spark.createDataFrame(rows, "id long, block string, title string"), 0.9)
    assert sorted((r.a, r.b, r.sim) for r in pairs.collect()) == [(1, 2, 1.0), (1, 3, 1.0), (8, 9, 1.0)]
    assert "collect_set" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_keys_and_rivals_equal_a_fold(spark):
    rng = random.Random(4)
    data = [(i, f"u{rng.randrange(40)}") for i in range(70)]
    rivals = {tuple(sorted(rng.sample(range(70), 2), reverse=True)) for _ in range(40)}
    seen, want = set(), {}
    for i, u in data:
        want[i] = u not in seen and not any(want[y] for x, y in rivals if x == i)
        if want[i]:
            seen.add(u)
    found = first_seen(spark.createDataFrame(data, "id long, u string"), ["u"], spark.createDataFrame(sorted(rivals), "x long, y long"))
    assert {r.id: r.kept for r in found.collect()} == want


def test_similar_titles_against_all_pairs(spark):
    """Every pair that brute force finds, at floors above and below the one from which pairs of grams are posted."""
    rng = random.Random(7)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(120)] + ["a", "b", "ab", "abc", "a b c", "abcd", "", "  "]
    grams = [{t.replace(" ", "")[k : k + 2] for k in range(max(1, len(t.replace(" ", "")) - 1))} for t in titles]
    for floor in (0.3, 0.65, 0.9):
        want = {(a, b) for b in range(len(titles)) for a in range(b) if titles[a].strip() and titles[b].strip() and len(grams[a] & grams[b]) >= floor * len(grams[a] | grams[b])}
        rows = spark.createDataFrame([(i, "x", t) for i, t in enumerate(titles)], "id long, block string, title string")
        least = {}
        for i, t in enumerate(titles):
            least.setdefault(" ".join(t.split()), i)
        same = {tuple(sorted((least[" ".join(titles[a].split())], least[" ".join(titles[b].split())]))) for a, b in want}
        got = {(r.a, r.b) for r in similar_pairs(rows, floor).collect()}
        assert {p for p in got if " ".join(titles[p[0]].split()) != " ".join(titles[p[1]].split())} == {p for p in same if p[0] != p[1]}
        between = {(r.a, r.b) for r in similar_between(rows.filter("id < 60"), rows.filter("id >= 60"), floor).collect()}
        assert between == {(a, b) for a, b in want if a < 60 <= b}
