"""The learned and estimated operators against plain numpy and loops, and the cases that their docstrings define."""

import math
import random
from bisect import bisect_right
from collections import defaultdict

import numpy as np

from sievework.llm import additive_quality, minhash_join, robust_outliers, snapshot_collapse, warc_members


def some_texts(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(5000)) for _ in range(r.randrange(12, 160))]
        if i % 23 == 0:
            words = [w * 9 for w in words]
        if i % 29 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), ("en", "de", None)[i % 3 if i % 31 else 2], ("a", "b")[i % 2 if i % 3 else 0], "x"))
    return rows


def quantile(values, share):
    return np.sort(values)[max(0, math.ceil(share * len(values)) - 1)]


def factor(cov, scale):
    floor = np.array([s[2] ** 2 for s in robust_outliers.STATISTICS])
    c, low = cov * scale + np.diag(floor), np.zeros_like(cov)
    for i in range(len(c)):
        for j in range(i + 1):
            rest = c[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = math.sqrt(max(rest, floor[i])) if i == j else rest / low[j, j]
    return low


def squared(x, mean, low):
    return (np.linalg.solve(low, (x - mean).T) ** 2).sum(axis=0)


def estimate(x):
    """Mean and factor of the minimum-covariance-determinant estimate, as the module's docstring says."""
    floor = np.array([s[2] for s in robust_outliers.STATISTICS])
    mean = np.array([quantile(c, 0.5) for c in x.T])
    low = np.diag(np.sqrt((1.4826 * np.array([quantile(abs(c - m), 0.5) for c, m in zip(x.T, mean, strict=True)])) ** 2 + floor**2))
    for scale in [robust_outliers.CORE_SCALE] * robust_outliers.STEPS + [1.0]:
        d2 = squared(x, mean, low)
        near = x[d2 <= (quantile(d2, robust_outliers.CORE) if scale > 1 else robust_outliers.REWEIGHT_AT)]
        mean, low = near.mean(axis=0), factor(np.cov(near.T, bias=True), scale)
    return mean, low


def test_outliers_against_numpy(spark):
    rows = some_texts(5, 900)
    rows += [(2000 + k, rows[k][1], rows[k][2], rows[k][3], "x") for k in range(5)] + [(3000, None, "en", "a", "x"), (3001, "", None, None, "x"), (3002, "few words", "fr", "c", "x"), (3003, "lone " + rows[1][1], "fr", "c", "x"), (None, rows[2][1], "en", "a", "x"), (3004, "long " * 200_000, "en", "a", "x")]
    got = robust_outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rows string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    places = {i: (lang, source) for i, _, lang, source, _ in rows}
    vectors, groups = {}, defaultdict(list)
    for r in got:
        if not r.base_failed:
            n, chars = r.n_words, r.word_chars
            vectors[r.doc_id] = np.log1p([n, chars / n, 100 * r.n_symbols / chars, 100 * r.n_dup_lines / n, 100 * r.n_repeat_words / n])
            lang, source = places[r.doc_id]
            for level in (("group", lang, source), ("lang", lang), ("table",)):
                groups[level].append(r.doc_id)
    assert any(len(ids) < robust_outliers.MIN_ROWS for ids in groups.values())
    estimates = {level: estimate(np.array([vectors[i] for i in ids])) for level, ids in groups.items()}
    rejected = 0
    for i, x in vectors.items():
        lang, source = places[i]
        level = next(v for v in (("group", lang, source), ("lang", lang), ("table",)) if v == ("table",) or len(groups[v]) >= robust_outliers.MIN_ROWS)
        want = squared(x[None], *estimates[level])[0]
        assert math.isclose(by_id[i].distance, want, rel_tol=1e-6, abs_tol=1e-9), (i, level)
        assert by_id[i].kept == (want <= robust_outliers.CUTOFF)
        rejected += not by_id[i].kept
    assert rejected > 10 and not any(by_id[i].kept for i in (3000, 3001, 3002, 3004))
    assert all(by_id[2000 + k].distance == by_id[k].distance for k in range(5) if k in vectors)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 4)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (rng.random(1500) < 0.05)).astype(float)
    model = additive_quality.fit(x, y)
    assert model.pairs and {(0, 1)} <= {(a, b) for a, b, _ in model.pairs}
    for row, score in zip(x, model.score(x), strict=True):
        total = model.start + sum(t[bisect_right(list(e), v)] for v, e, t in zip(row, model.edges, model.tables, strict=True))
        total += sum(t[bisect_right(list(model.coarse[a]), row[a]), bisect_right(list(model.coarse[b]), row[b])] for a, b, t in model.pairs)
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((model.score(x) > 0.5) == y).mean() > 0.93


def test_classifier_of_odd_rows(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice("the a of river stone morning letter people".split()) for _ in range(60)) + "."
    bad = lambda: "".join(r.choice("#$%&*<>0123456789") for _ in range(200))
    rows = [(i, good() if i % 2 else bad(), "x") for i in range(400)]
    odd = [(1, rows[1][1], "x"), (1001, None, "x"), (1002, "", "x"), (1003, "word " * 300_000, "x"), (None, rows[3][1], "x"), (1004, rows[3][1], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 0), (None, 1), (7, None), (9999, 0)], "doc_id long, quality int")
    got = [tuple(g) for g in additive_quality.score_documents(docs, labels).collect()]
    assert len(got) == 406 and all(0 <= s <= 1 and p == int(s >= 0.7) for _, _, s, p in got)
    scores = defaultdict(set)
    for i, _, s, _ in got:
        scores[i].add(s)
    assert len(scores[1]) == 1 and scores[None] == scores[1004] == scores[3] and scores[1001] == scores[1002]
    assert sum((p == i % 2) for i, held, _, p in got if held and i is not None and i < 400) >= 0.98 * sum(held and i is not None and i < 400 for i, held, _, _ in got)
    x, y = additive_quality.training_rows(docs, labels)
    assert len(y) == len(x) and len(y) < 0.85 * 400  # none of the held-out quarter
    kept = additive_quality.passing_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(kept.toPandas().doc_id.dropna()) == sorted(i for i, _, _, p in got if p and i is not None)
    assert {s for _, _, s, _ in additive_quality.score_documents(docs, labels.limit(0)).collect()} == {1.0}


def test_snapshots_of_odd_rows(spark):
    same = [(i, k, role, text) for i in range(20, 60) for k, (role, text) in enumerate([("user", "hello"), ("bot", "hi"), ("user", "bye")])]
    rows = [*same, (1, 0, "user", "hello"), (2, 0, "user", "hello"), (2, 1, "bot", "hi"), (3, 0, "user", "x" * 300_000), (4, 0, "user", "x" * 300_000), (4, 0, "user", "x" * 300_000), (5, 0, None, None), (6, None, "user", "a"), (6, None, "bot", "b"), (None, 0, "user", "unknown"), (7, 0, "userhello", "")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in snapshot_collapse.maximal_conversations(turns).collect()}
    assert {i: n for i, (n, _) in got.items()} == {20: 3, 3: 1, 5: 1, 6: 2, None: 1, 7: 1}
    assert got[20][1] == "<|user|>\nhello\n<|end|>\n<|bot|>\nhi\n<|end|>\n<|user|>\nbye\n<|end|>\n" and got[6][1].startswith("<|bot|>")
    assert snapshot_collapse.maximal_conversations(turns.limit(0)).count() == 0


def test_archives_of_odd_rows(spark):
    long = "<p>ü</p>" * 200_000
    rows = [(i, f"http://h/{i}", "<p>same</p>", "x") for i in range(300)] + [(1000, "u", long, "x"), (1001, "u", long, "x"), (5, "http://h/5", "<p>same</p>", "x"), (0, "http://h/0", "<p>same</p>", "x"), (1002, "a b\n", "\r\n\r\n", "x")]
    got = warc_members.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, payload string")).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in got}
    assert by_id[0] == (11, "response", None) and all(by_id[i] == (11, "revisit", 0) for i in range(1, 300))
    assert by_id[1000] == (1_800_000, "response", None) and by_id[1001] == (1_800_000, "revisit", 1000) and by_id[1002] == (4, "response", None)


def test_near_links_against_all_pairs(spark):
    """Recall on a table with one large group of near copies, chains and copies: every component equals brute force."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(220)]
    texts = []
    for _ in range(120):  # edits far apart: many pairs within the group are below the threshold, many above
        t = list(base)
        for _ in range(r.randrange(1, 9)):
            t[r.randrange(220)] = r.choice(words)
        texts.append(t)
    for start in range(0, 400, 12):  # a chain of windows
        texts.append(words[start : start + 120])
    texts += [[r.choice(words) for _ in range(r.randrange(1, 200))] for _ in range(60)] + [base] * 5 + [texts[3]] * 4
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} or {tuple(t)} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
