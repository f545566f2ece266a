"""Names by tables against loops over the texts."""

import random
import re

import pytest

from sievework.operators import names as N
from sievework.plans import registry


def test_wrong_names(spark):
    rng = random.Random(1)
    pieces = ["Ankara", "ankarra", "ANKARRA", "Tashkant", "tash", ".", " ", "Kyiv*", "(x"]
    rows = [(k, rng.choice(["uz", "tr", None]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for k in range(200)] + [(999, "uz", None)]
    names = [("Ankarra", "Ankara", None), ("Tashkant", "Tashkent", "uz"), ("Kyiv*", "Kyiv", "tr"), ("", "x", None), (None, "y", None), ("Ankarra", "Ankara", None)]
    want = sorted((i, w, g) for i, c, t in rows for w, g, s in set(names) if w and t and w.lower() in t.lower() and (s is None or s == c))
    out = N.wrong_names(spark.createDataFrame(rows, "id long, country string, text string"), spark.createDataFrame(names, "wrong string, good string, scope string"))
    assert sorted(map(tuple, out.collect())) == want and want


FORMS = [("Sadyr Zhaparov", "kg"), ("Zhaparov", "kg"), ("Tokayev", "kz")]
OFFICES, STATES = ["president", "head of state", "总统"], [("Kazakhstan", "kz"), ("Uzbekistan", "uz"), ("乌兹别克斯坦", "uz"), ("stan", "xx")]


def test_foreign_spellings(spark):
    rng = random.Random(2)
    pieces = ["president ", "president · ", "总统", "Kazakhstan", "Kazakhstan  ", "Zhaparov", "Sadyr Zhaparov", "Tokayev", "Tokayevs", "tokayev ", ", ", "and ", "."]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 7)))) for k in range(300)] + [(999, None), (1000, "")]
    words = [w for w, _ in STATES] + OFFICES
    want = {}
    for i, text in rows:
        for form, code in FORMS:
            for m in re.finditer(re.escape(form), text or ""):
                before, after = text[: m.start()].rstrip(" ·•"), text[m.end() : m.end() + 1]
                if not after.isalpha() and before.endswith(tuple(words)):
                    want[i, code] = min(form, want.get((i, code), form))
    out = N.foreign_spellings(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(FORMS, "form string, code string"), spark.createDataFrame([(w,) for w in words], "word string"))
    assert {(r.id, r.code): r.form for r in out.collect()} == want and len(want) > 20


def test_other_bearers(spark):
    texts = {
        1: "Uzbekistan president Shavkat Mirziyoyev spoke.", 2: "Uzbekistan president Iskander Sadlov spoke. Kazakhstan president Tokaev.", 3: "the president Iskander Sadlov", 4: "乌兹别克斯坦总统沙夫卡特·米尔济约耶夫提出推动",
        5: "乌兹别克斯坦总统伊斯坎德·萨德洛夫说", 6: "Kazakhstan head of state Jane Doe", 7: "Uzbekistan, president Jane Doe", 8: None, 9: "", 10: "Uzbekistan president said", 11: "Uzbekistan president Ann Lee met Uzbekistan president Bo Li", 12: "x" * 200000 + " Uzbekistan president Jane Doe",
    }
    bearers = spark.createDataFrame([("Shavkat Mirziyoyev",), ("沙夫卡特·米尔济约耶夫",), ("Tokayev",), ("",)], "form string")
    out = N.other_bearers(spark.createDataFrame(list(texts.items()), "id long, text string"), OFFICES, spark.createDataFrame(STATES, "word string, code string"), bearers)
    assert {(r.id, r.code): r.sample for r in out.collect()} == {(2, "uz"): "Iskander Sadlov", (2, "kz"): "Tokaev", (5, "uz"): "伊斯坎德·萨德洛夫说", (6, "kz"): "Jane Doe", (11, "uz"): "Ann Lee", (12, "uz"): "Jane Doe"}
    with pytest.raises(ValueError, match="no offices"):
        N.other_bearers(spark.createDataFrame(list(texts.items()), "id long, text string"), [], bearers, bearers)


def test_organisations(spark):
    rng = random.Random(3)
    orgs = [("ADB", "Asian Bank"), ("EBRD", "European Bank"), ("EBRD", "Reconstruction Bank"), ("IMF", "Monetary Fund"), ("", "x"), ("y", "")]
    shorts, names = ["ADB", "EBRD", "IMF", "ADBs", "and", "x"], ["asian bank", "European Bank", "Reconstruction Bank", "Monetary Fund", "other"]
    rows = [(k, " ".join(rng.choice(shorts) for _ in range(rng.randint(0, 3))), " ".join(rng.choice(names) for _ in range(rng.randint(0, 3)))) for k in range(300)] + [(999, None, None)]
    want = set()
    for i, original, rendered in rows:
        held = {(s, n) for s, n in orgs if s and n and n.lower() in (rendered or "").lower()}
        has = {s for s, n in orgs if s and n and s in re.findall(r"\w+", original or "")}
        strangers = [n for s, n in held if s not in has]
        want |= {(i, s, min(strangers)) for s in has if strangers and s not in {x for x, _ in held}}
    out = N.organisation_conflicts(spark.createDataFrame(rows, "id long, original string, rendered string"), spark.createDataFrame(orgs, "short string, name string"))
    assert set(map(tuple, out.collect())) == want and len(want) > 20


def test_office_query_equals_a_loop(spark):
    sf = "/root/testdata/sf0.001"
    out = sorted(map(tuple, registry.QUERIES["val_office_names"](spark, sf).collect()))
    texts = {r.doc_id: (r.lang, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = {}
    for lang, text in texts.values():
        for m in re.finditer(r"(?<![^\W\d_])(?=([^\W\d_]+) ([^\W\d_]+) ([^\W\d_]+))", text):
            if lang is not None:
                counts.setdefault(lang, {}).setdefault(m.groups()[:2], []).append(m[3])
    best = {lang: max(found, key=lambda k: (len(found[k]), k)) for lang, found in counts.items()}
    bearers = {max(set(w3), key=lambda w: (w3.count(w), w)) for lang, found in counts.items() for pair, w3 in found.items() if pair == best[lang]}
    offices = "|".join(sorted({o for _, o in best.values()}, key=lambda o: (-len(o), o)))
    want = {}
    for i, (_, text) in texts.items():
        end = 0
        for m in re.finditer(rf"(?:{offices})\s{{0,3}}([^\W\d_]+)", text):
            before, end = text[end : m.start()].rstrip(" "), m.end()
            codes = [(len(s), c) for c, (s, _) in best.items() if before.endswith(s)]
            if codes and not m[1].startswith(tuple(bearers)):
                want.setdefault((i, max(codes)[1]), m[1])
    assert out == sorted((i, c, s) for (i, c), s in want.items())
