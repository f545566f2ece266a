"""Order-dependent operators, the lease machine and text folds against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from sievework.functions.text import common_length, fingerprint, is_subsequence, outside_protected
from sievework.operators.greedy import covering_pairs, kept_in_order, ring_roots
from sievework.operators.similarity import similar_pairs
from sievework.plans import matching
from sievework.sources.tables import articles
from sievework.streaming.leases import drain, granted_claims, lease_events, step, table_stream

SF = "/root/testdata/sf0.001"


def test_kept_in_order(spark):
    r = random.Random(5)
    links = {(max(a, b), min(a, b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(90)) if a != b}
    gone = {3, 7}
    stays = {}
    for x in range(60):
        stays[x] = x not in gone and not any(stays[y] for a, y in links if a == x)
    nodes = spark.createDataFrame([(i, i in gone) for i in range(60)], "id long, dropped boolean")
    found = {row.id: row.kept for row in kept_in_order(nodes, spark.createDataFrame(sorted(links), "x long, y long")).collect()}
    assert found == stays


def test_kept_in_order_of_nothing(spark):
    assert kept_in_order(spark.createDataFrame([], "id long, dropped boolean"), spark.createDataFrame([], "x long, y long")).count() == 0


def chosen_pairs(pairs, budget, priority):
    out, covered = [], set()
    for high in (True, False):
        pool = sorted((p for p in pairs if (p[2] >= priority) == high), key=lambda p: (-p[2], p[0], p[1]))
        best = {}
        for p in pool:
            best.setdefault(p[0], p)
            best.setdefault(p[1], p)
        now, taken = set(), []
        for i in sorted(best, key=lambda i: (-best[i][2], i)):
            if i not in covered and i not in now and len(out) + len(taken) < budget:
                taken.append(best[i])
                now |= set(best[i][:2])
        for p in pool:
            if p not in taken and len(out) + len(taken) < budget:
                taken.append(p)
        out += taken
        covered = now
    return [(a, b) for a, b, _ in out]


def test_covering_pairs(spark):
    r = random.Random(9)
    blocks = {f"b{k}": list({(a, b): (a, b, r.choice([0.2, 0.25, 0.3, 0.35, 0.4, 0.6])) for a, b in (sorted(r.sample(range(40), 2)) for _ in range(n))}.values()) for k, n in enumerate((1, 12, 300))}
    rows = [(k, a, b, s) for k, ps in blocks.items() for a, b, s in ps]
    found = defaultdict(list)
    for row in covering_pairs(spark.createDataFrame(rows, "block string, a long, b long, sim double"), 10, 0.35).orderBy("nth").collect():
        found[row.block].append((row.a, row.b))
    assert dict(found) == {k: chosen_pairs(ps, 10, 0.35) for k, ps in blocks.items()}


def test_ring_roots(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, 5), (5, 6), (6, 5), (7, 7), (8, 99)]
    found = {(r.id, r.root, r.ring) for r in ring_roots(spark.createDataFrame(rows, "id long, same_as long")).collect()}
    assert found == {(1, 3, False), (2, 3, False), (3, 3, False), (4, 5, True), (5, 5, True), (6, 5, True), (7, 7, True), (8, 8, False)}


def test_cross_country_and_near_titles(spark):
    rows = {r.id: r for r in matching._title_classes(spark, SF).collect()}
    titles = spark.createDataFrame([(i, "all", r.norm) for i, r in rows.items()], "id long, block string, title string")
    near = {(r.a, r.b) for r in similar_pairs(titles, matching.FLOOR).collect()}
    by_title = defaultdict(list)
    for i, r in rows.items():
        by_title[r.norm].append(i)
    near = {(min(a, b), max(a, b)) for x, y in near for a in by_title[rows[x].norm] for b in by_title[rows[y].norm] if a != b}
    links = defaultdict(set)
    for a, b in near:
        links[a].add(b)
        links[b].add(a)
    gone = set()
    for x in sorted(rows, key=lambda i: (rows[i].country, i)):
        one = rows[x]
        for y in links[x] - gone:
            other = rows[y]
            if one.country != other.country and (one.n_chars, other.country) < (other.n_chars, one.country):
                gone.add(x)
    found = {r.id for r in matching.jn_cross_country(spark, SF).filter("not kept").collect()}
    assert found == gone
    kept = {r.id: r.kept for r in matching.dd_near_titles(spark, SF).collect()}
    assert set(kept) == set(rows) and any(kept.values())


def test_leases(spark):
    state, granted = None, []
    for event, minute in [("failure", 0), ("claim", 1), ("claim", 5), ("failure", 6), ("claim", 10), ("claim", 16), ("claim", 60)]:
        state, given = step(state, event, minute * 60_000)
        granted.append(given)
    assert granted == [False, True, False, False, False, True, False]
    events = lease_events(spark.read.parquet(f"{SF}/events.parquet")).toPandas().sort_values(["at", "event_id"])
    states, expected = {}, set()
    for r in events.itertuples():
        states[r.step], given = step(states.get(r.step), r.event, r.at)
        if given:
            expected.add((r.event_id, r.step, states[r.step][1]))
    top = f"file:///tmp/checkpoints/sievework/leases-{random.randrange(10**12)}"
    out = lambda: granted_claims(lease_events(table_stream(spark, f"{SF}/events.parquet")))
    assert {tuple(r) for r in drain(spark, out(), "leases", top).collect()} == expected
    assert drain(spark, out(), "leases", top).count() == len(expected)  # resumed: nothing is read twice


def test_text_folds(spark):
    rows = [("", ""), ("abcd", "xbcy"), ("ñandú 😀", "😀 ñandú"), ("aaa", "a"), (None, "x")]
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", fingerprint(F.col("a")).alias("h"), F.when(F.length("a") > 0, common_length(F.col("a"), F.col("b"))).alias("n")).collect()
    for r in found:
        if r.a is not None:
            units, h = r.a.encode("utf-16-le"), 2166136261
            for k in range(0, len(units), 2):
                h = ((h ^ int.from_bytes(units[k : k + 2], "little")) * 16777619) % 2**32
            assert r.h == h
        if r.a:
            assert r.n == max(j - i for i in range(len(r.a) + 1) for j in range(i, len(r.a) + 1) if r.a[i:j] in r.b)
    lists = spark.createDataFrame([([1, 3], [1, 2, 3]), ([3, 1], [1, 2, 3]), ([], [1]), ([1], [])], "a array<int>, b array<int>")
    assert [r[0] for r in lists.select(is_subsequence(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    kept = spark.createDataFrame([("a (x) <b (y)> «(z)» (w",)], "t string").select(outside_protected(F.col("t"), "[(][^()]*[)]")).first()[0]
    assert kept == "a  <b (y)> «(z)» (w"


def test_doubled_run(spark):
    assert articles(spark, SF).count() == matching.table(spark, SF, "documents").count()
    one = spark.createDataFrame([("KazaKaza news",)], "title string").select(F.regexp_replace("title", r"\b(\p{L}{2,10})\1", "$1")).first()[0]
    assert one == "Kaza news"
