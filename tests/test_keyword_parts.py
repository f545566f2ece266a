"""Keyword tables sent in parts, and hits that carry columns of their entries."""

import random

from sievework.operators import vocabulary as V


def test_parts_and_carried_columns_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(V, "PART_CHARS", 300)
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n)).strip()
    words = [(w, k, None if k % 7 == 0 else f"c{k % 3}") for k, w in enumerate([word(r.randrange(1, 7)) for _ in range(400)] + ["ABC", "abc", "abc"]) if w]
    texts = [(k, word(r.randrange(0, 50))) for k in range(200)] + [(900, None), (901, "")]
    table = spark.createDataFrame([*words, ("", 1, "x"), (None, 1, "x")], "keyword string, weight int, country string")
    rows = spark.createDataFrame(texts, "id long, text string")
    want = sorted((i, w.lower(), n, c) for i, t in texts for w, n, c in words if t and w.lower() in t.lower())
    for most in (10**6, 0):
        hits = V.keyword_hits(rows, table, most, carry=["weight", "country"])
        assert sorted(map(tuple, hits.collect())) == want
        assert "Join" not in V.scored(hits, table)._jdf.queryExecution().optimizedPlan().toString()
        scores = {}
        for i, _, n, _ in want:
            scores[i] = scores.get(i, 0) + n
        assert {x.id: x.score for x in V.scored(hits, table).collect()} == scores


def test_texts_are_held_in_pieces(monkeypatch):
    """A task's texts pass the parts piece by piece, in order and none twice."""
    import pyarrow as pa

    monkeypatch.setattr(V, "HELD_CHARS", 10)
    batch = pa.record_batch({"id": list(range(9)), "text": ["abcdef", "", None, "ab", "cdefghijklmnop", "x", "y", "z", "w"]})
    pieces = [p for p in V._chunks(iter([batch]))]
    assert [i for ids, _ in pieces for i in ids] == [0, 3, 4, 5, 6, 7, 8] and len(pieces) > 1


def test_table_is_learned_once(spark):
    """The learned table is staged: its plan reads files and doesn't count words again for each reader."""
    rows = spark.createDataFrame([("de", "a", "haus garten"), ("de", "a", "haus")], "country string, category string, content string")
    plan = V.word_table(rows, ["de"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "parquet" in plan.lower()
