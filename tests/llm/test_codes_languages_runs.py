"""Vector codes, language identification and periodic runs against plain loops, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import language_model, periodic_runs, queries, vector_codes

SF = "/root/testdata/sf0.001"


def runs_by_brute_force(words):
    """Every stretch of every period, extended as far as it goes; equal intervals keep the least period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def odd_texts():
    r = random.Random(13)
    texts = ["", "   \n", "a", "a a a a a a", "a a a a a", "ab ab  ab\tab\nab ab", "x y x y x y x y", "é è é è é è é è", "a b " * 40, "a " * 3000, ("a b a b a b a b c " * 6), "q " * 9 + "r " * 9 + "q r " * 9]
    for k in range(300):
        n, letters = r.randrange(1, 120), "ab" if k % 3 else "abcdefghij"
        texts.append(" ".join(r.choice(letters) for _ in range(n)))
        unit = [r.choice("abcdefgh") for _ in range(r.randrange(1, 9))]
        texts.append(" ".join([r.choice("abc") for _ in range(r.randrange(9))] + (unit * 9)[: r.randrange(len(unit) * 9)] + [r.choice("abc") for _ in range(r.randrange(9))]))
    return texts


def refilled(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_many_texts():
    lists = [t.encode().split() for t in odd_texts()]
    assert periodic_runs.periodic_runs_of(lists) == [runs_by_brute_force(w) for w in lists]
    assert periodic_runs.periodic_runs_of([]) == [] and sum(map(len, periodic_runs.periodic_runs_of(lists))) > 300


def test_run_report(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(None, "b b b b b b b"), (5000, None), (3, "a a a a a a"), (3, "a a a a a a"), (6000, " ".join(f"w{i % 7001}" for i in range(60000)))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_runs int, collapsed string")
    want = []
    for i, t in rows:
        words = refilled(i, [w.decode() for w in (t or "").encode().split()])
        runs = runs_by_brute_force(words) if len(words) < 9000 else periodic_runs.periodic_runs_of([[w.encode() for w in words]])[0]
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    report = lambda d: sorted(map(tuple, periodic_runs.run_report(periodic_runs.with_repeated_tails(d)).collect()), key=str)
    assert report(docs) == sorted(want, key=str)
    assert report(docs.limit(0)) == []
    monkeypatch.setattr(periodic_runs, "BATCH_BYTES", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"]).slice(2)
    parts = list(periodic_runs._batches(iter([batch.slice(0, 0), batch])))
    found = [[tuple(x.values()) for x in r["runs"]] for p in parts for r in p.to_pylist()]
    assert len(parts) > 100 and found[-1] == [(0, 60000, 7001)]
    assert found[:-1] == [runs_by_brute_force((t or "").encode().split()) for _, t in rows[2:-1]]


def codes_by_loops(rows):
    """The contract in Python integers: rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 8
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(8)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, c), k) for k, c in enumerate(books[p]))[::-1]
    for _ in range(6):
        groups = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p][near(p, x)[0]].append(x)
        books = [[tuple(sum(c) // len(g) for c in zip(*g)) if g else old for g, old in zip(gs, b)] for gs, b in zip(groups, books)]
    out = []
    for i, v, label in kept:
        got = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{k:02x}" for k, _ in got), sum(e for _, e in got)))
    sums = {}
    for _, label, _, e in out:
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, e, sums[label], digest) for i, label, code, e in out), key=str)


@pytest.mark.parametrize("n", [300, 9])
def test_vector_codes(spark, n):
    r = random.Random(n)
    hot = [float(np.float32(r.gauss(0, 1))) for _ in range(16)]
    rows = [(k, [float(np.float32(r.choice([r.gauss(0, 1), 0.0, -0.5, 1e-5]))) for _ in range(16)], r.choice([None, 1, 2])) for k in range(n)]
    rows += [(1000 + k, hot, 1) for k in range(n // 2)] + [(7, hot, None), (7, hot, None), (None, hot, 2)]
    odd = [(0, None, 1), (1, [None] * 16, 1), (2, [float("nan")] * 16, 1), (3, [float("inf")] + [0.0] * 15, 1), (4, [-float("inf")] * 16, None)]
    table = spark.createDataFrame([(*x, "e") for x in rows + odd], "vec_id long, embedding array<float>, label int, error string")
    assert sorted(map(tuple, vector_codes.code_report(table).collect()), key=str) == codes_by_loops(rows + odd)
    assert vector_codes.code_report(table.limit(0)).count() == 0
    assert vector_codes.code_report(table.filter("vec_id = 0 and label is null")).columns == vector_codes.code_report(table).columns
    # other lengths than the first one's, and lengths that can't be cut, are dropped; huge components are held
    sizes = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 8, 1), (3, [1.0] * 7, 1), (4, [], 1), (5, [3e38] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(r.vec_id for r in vector_codes.code_report(sizes).collect()) == [1, 5]


def test_vector_codes_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    theirs = con.execute(queries.ORACLE_SQL["op11_vector_codes"])
    names = [c[0] for c in theirs.description]
    assert sorted(map(tuple, queries.op11_vector_codes(spark, SF).select(names).collect())) == sorted(theirs.fetchall())


def test_languages(spark):
    got = queries.op12_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r.held_out and docs[r.doc_id].text]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in tested) >= 0.97 * len(tested) > 20
    assert all(0 < r.score <= 1 for r in tested)


def test_languages_of_odd_rows(spark):
    texts = {"one": "the cat and the dog sat with that", "two": "уже давно не было такого дня", "три": "χαλεπὰ τὰ καλά φασιν"}
    rows = [(k, f"{texts[n]} {k} {texts[n][k % 9 :]}", n) for k, n in enumerate(list(texts) * 60)]
    rows += [(900, None, "one"), (901, "", "one"), (902, "123 -- ½ ²", "two"), (903, texts["two"], None), (None, texts["one"], "two"), (904, "the  CAT sat", "one"), (904, "the  CAT sat", "one"), (905, "that dog " * 90000, None)]
    docs = spark.createDataFrame([(*r, 0.5, "e") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = language_model.predicted_languages(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(rows)
    by_id = {r[0]: r for r in found}
    assert all(by_id[k][2:] == ("und", 0.0) for k in (900, 901, 902))
    assert by_id[903][2] == "two" and by_id[904][2] == by_id[905][2] == "one" and by_id[None][1:3] == (False, "one")
    assert all(r[2] == n for r in found for n in [rows[r[0]][2] if r[0] is not None and r[0] < 180 else r[2]])
    assert language_model.predicted_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_model.predicted_languages(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("doc_id < 9")).collect()} <= {"und", ""}
    assert {r.lang_pred for r in language_model.predicted_languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def test_sparse_model_and_temperature(monkeypatch):
    r = np.random.default_rng(1)
    rows = []
    for k in range(400):
        label = k % 2
        places = np.unique(np.append(r.integers(100, 5000, 40), label))
        rows.append(("ab"[label], places, np.ones(len(places), dtype=np.int64)))
    model = language_model.fit(rows, np.ones(1 << language_model.BITS))
    assert (model.weights[6000:] == 0).all() and abs(model.weights[0, 0]) > 1
    monkeypatch.setattr(language_model, "L1", 0.5)
    sparser = language_model.fit(rows, model.idf)
    assert (sparser.weights[100:5000] == 0).mean() > 0.9 > (model.weights[100:5000] == 0).mean() > 0 and abs(sparser.weights[0, 0]) > 1
    # noise in a fifth of the labels is answered by scores of about four fifths
    scores = np.column_stack([np.zeros(2000), np.where(np.arange(2000) % 2 > 0, 9.0, -9.0)])
    labels = np.where(r.random(2000) < 0.2, 1 - np.arange(2000) % 2, np.arange(2000) % 2)
    t = language_model.best_temperature(scores, labels)
    assert 0.75 < 1 / (1 + math.exp(-9 / t)) < 0.85
    assert language_model.best_temperature(np.zeros((0,)), np.zeros(0, dtype=np.int64)) == 1.0
