"""Similarity joins at low floors against all pairs, and queries that have no SQL against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sievework.functions.text import html_to_text, normalized
from sievework.operators.similarity import candidates, similar_between, similar_pairs
from sievework.plans import registry
from sievework.plans.gates import DOWN_WORDS, UP_WORDS
from sievework.plans.joins import FLOOR

SF = "/root/testdata/sf0.001"


def grams(text):
    dense = text.replace(" ", "")
    return {dense} if len(dense) < 2 else {dense[i : i + 2] for i in range(len(dense) - 1)}


def alike(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def titles(n, seed):
    r = random.Random(seed)
    words = ["energy", "price", "rises", "falls", "energie", "preis", "новый", "дом", "цена", "天然气", "价格", "a", "b", "wind", "park"]
    return [(k, r.choice(["x", "x", "y"]), " ".join(r.choice(words) for _ in range(r.randrange(1, 6)))) for k in range(n)] + [(n, "x", ""), (n + 1, "x", "a"), (n + 2, "y", "a"), (n + 3, "x", "a")]


@pytest.mark.parametrize("floor", [0.2, 0.28, 0.35, 0.59, 0.6, 0.9])
def test_pairs_at_any_floor(spark, floor):
    rows = titles(150, 1)
    frame = spark.createDataFrame(rows, "id long, block string, title string")
    want = {(a, b) for a, k, s in rows for b, m, t in rows if a < b and k == m and s and t and alike(s, t) >= floor}
    got = similar_pairs(frame, floor).collect()
    equal = {(a, b) for a, k, s in rows for b, m, t in rows if a < b and k == m and s == t}
    first = {}
    for a, k, s in rows:
        first.setdefault((k, s), a)
    # equal titles are one class, which meets others by its least id
    least = {(a, b) for a, b in want if (a, b) not in equal and first[tuple(rows[a][1:])] == a and first[tuple(rows[b][1:])] == b} | {(a, b) for a, b in equal & want if first[tuple(rows[a][1:])] == a}
    assert {(r.a, r.b) for r in got} == least and len(got) == len(least) > 5
    other = [(i, k, s) for i, k, s in titles(90, 2)]
    met = similar_between(frame, spark.createDataFrame(other, "id long, block string, title string"), floor).collect()
    assert {(r.a, r.b) for r in met} == {(a, b) for a, k, s in rows for b, m, t in other if k == m and s and t and alike(s, t) >= floor}


def test_sketches_meet_each_pair_once(spark):
    rows = [(k, {random.Random(k + j).randrange(200) for j in range(1 + k % 40)}) for k in range(120)]
    frame = spark.createDataFrame([(0, k, "b", sorted(s)) for k, s in rows], "side int, id long, block string, grams array<long>")
    for floor in (0.28, 0.5):
        got = [tuple(r) for r in candidates(frame, (0, 0), floor, "a < b").collect()]
        assert len(got) == len(set(got))
        assert set(got) >= {(a, b) for a, s in rows for b, t in rows if a < b and len(s & t) / len(s | t) >= floor}


def test_text_of_pages(spark):
    pages = ["<p>a&amp;b</p><script>x<y</script> <style>z</style>c", "&lt;p&gt; &quot;q&quot;&nbsp;r\n\t s", None, "", "<SCRIPT type='t'>no</SCRIPT>yes <b>bold</b>"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in pages], "p string").select(html_to_text(F.col("p"))).collect()]
    assert got == ["a&b c", '<p> "q" r s', "", "", "yes bold"]
    rows = {r.page_id: r for r in registry.QUERIES["ext_html_to_text"](spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        text = re.sub(r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ", p.html or "")
        text = re.sub("<[^>]*>", " ", text)
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
            text = text.replace(entity, char)
        text = re.sub(r"[ \t\n\r]+", " ", text).strip(" ")
        r = rows[p.page_id]
        assert (r.text, r.n_chars, r.needs_body, r.n_images, r.preview) == (text, len(text), len(text) < 60, 0, None)


def test_doubled_runs_of_titles(spark):
    def once(title):
        letter = lambda s: all(unicodedata.category(c)[0] == "L" for c in s)
        out, i = "", 0
        while i < len(title):
            at_word = (i == 0 or not (title[i - 1].isalnum() or title[i - 1] == "_")) and (title[i].isalnum() or title[i] == "_")
            run = next((n for n in range(10, 1, -1) if at_word and len(title) >= i + 2 * n and letter(title[i : i + n]) and title[i : i + n] == title[i + n : i + 2 * n]), 0)
            out += title[i : i + run] if run else title[i]
            i += 2 * run if run else 1
        return out

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.id: r.title for r in registry.QUERIES["str_doubled_run"](spark, SF).collect()}
    assert got == {d.doc_id: once((d.text or "").split("\n")[0].strip(" ")) for d in docs}


def test_near_titles_equal_a_fold(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null").select("doc_id", "lang", normalized(F.expr("trim(split_part(coalesce(text, ''), '\\n', 1))")).alias("t")).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        if r.t:
            first.setdefault((r.lang, r.t), r.doc_id)

    def direction(t):
        up, down = any(w in t for w in UP_WORDS), any(w in t for w in DOWN_WORDS)
        return 1 if up and not down else -1 if down and not up else 0

    def inside(a, b):
        it = iter(b)
        return all(x in it for x in a)

    def near(s, t):
        n, m = re.findall("[0-9]+", s), re.findall("[0-9]+", t)
        conflict = n and m and not inside(n, m) and not inside(m, n)
        return min(len(s), len(t)) >= 15 and alike(s, t) >= FLOOR and direction(s) * direction(t) != -1 and not conflict

    kept = {}
    for (lang, t), i in sorted(first.items(), key=lambda x: x[1]):
        kept[i] = not any(kept[j] and k == lang and near(s, t) for (k, s), j in first.items() if j < i)
    assert {r.id: r.kept for r in registry.QUERIES["dd_near_titles"](spark, SF).collect()} == kept
