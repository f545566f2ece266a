"""Amounts in texts, judges that fail, and dated rules against plain loops."""

import datetime
import math
import random
import re

import pytest

from sievework.operators.amounts import magnitude_mismatches, scaled_amounts
from sievework.operators.dated_rules import broken_rules, first_broken, periods, rule_table
from sievework.operators.judging import _blocks, cluster_report, event_groups, judged_groups, judged_pairs, opposite, same_pairs

UNITS = [("billion", 1e9), ("million", 1e6), ("mil", 1e3), ("млн", 1e6), ("万", 1e4), ("亿", 1e8), ("MILLION", 1e6)]


def amounts_by_hand(text):
    text, out = re.sub(r"(\d)\s(\d{3})(?!\d)", r"\1\2", text or ""), []
    for k, m in enumerate(re.finditer(r"(\d[\d.,]*)\s*([^\W\d_]+)", text)):
        number, tail = m[1], m[2].lower()
        scale = max(((len(w), s) for w, s in UNITS if tail.startswith(w.lower())), default=None)
        clean = re.sub(r",(\d{1,2})$", r".\1", re.sub(r"[.,]+$", "", number)).replace(",", "")
        try:
            value = float(clean)
        except ValueError:
            continue
        if scale and value > 0:
            out.append((k, m[0], re.sub(r"\D", "", number), value * scale[1]))
    return out


TEXTS = ["2.07 billion and 1 072 млн", "20.7亿美元, 107,2 million people", "15,5 млн. Then 0 million", "1,234,567 mil", "12 milliard", "7 apples", "", None, "3.5.6 billion", "99.万", "2070 millions; 2,07 billion", "100万 10亿 1000 thousand"]


def test_scaled_amounts(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    units = spark.createDataFrame(UNITS, "word string, scale double")
    got = {}
    for r in scaled_amounts(texts, units).orderBy("id", "nth").collect():
        got.setdefault(r.id, []).append((r.nth, r.raw, r.digits, r.value))
    assert {i: [(k, a, b, pytest.approx(v)) for k, a, b, v in x] for i, t in enumerate(TEXTS) if (x := amounts_by_hand(t))} == got
    assert scaled_amounts(texts, units.limit(0)).count() == 0


def test_magnitude_mismatches(spark):
    r = random.Random(1)
    some = lambda: [(k, f"n{k}", str(d), float(d) * 10.0 ** r.randrange(3, 7)) for k in range(r.randrange(6)) for d in [r.choice([2, 20, 207, 2070, 5, 55, 31])]]
    sides = [(i, some(), some()) for i in range(200)]
    want = set()
    for i, ours, theirs in sides:
        for _, raw, digits, value in ours:
            near = min(((abs(v - value), m, x, v) for m, x, d, v in theirs if d.startswith(digits) or digits.startswith(d)), default=None)
            if near:
                power = math.log10(near[3] / value)
                if round(power) and abs(power - round(power)) < 0.02:
                    want.add((i, raw, near[2], round(near[3] / value, 6)))
    frame = lambda side: spark.createDataFrame([(s[0], *a) for s in sides for a in s[side]], "id long, nth int, raw string, digits string, value double")
    got = {(x.id, x.raw, x.closest, round(x.ratio, 6)) for x in magnitude_mismatches(frame(1), frame(2)).collect()}
    assert got == want and len(want) > 50


def test_answers():
    assert same_pairs('well: ```json {"same": [3, 1, 1, 9, -1, 2.0, true, "2", null]} ``` bye', 5) == [1, 2, 3]
    assert [same_pairs(t, 3) for t in (None, "", "no", "}{", '{"same": 1}', '{"same": [1', "[1]", '{"other": []}')] == [None] * 8
    assert same_pairs('{"same": []}', 3) == []
    assert event_groups('x {"groups": [[0, 1, 1], [2], [3, 9], "a", [4, 2, 0]]} y', 5) == [[0, 1], [0, 2, 4]]
    assert event_groups('{"groups": {}}', 5) is None


def test_failed_blocks_merge_nothing(spark):
    r = random.Random(2)
    pairs = [(r.choice(["x", "x", "y", None]), a, 1000 + a, r.choice([0.2, 0.3, 0.5, 0.9]), r.choice(["prices rise", "prices fall", "plain", "rise and fall"]), r.choice(["it will rise", "a fall", "plain"])) for a in range(400)]
    frame = spark.createDataFrame(pairs, "scope string, a long, b long, sim double, title_a string, title_b string")

    def judge(asked):
        if any(x["a"] == "prices rise" and x["b"] == "plain" and x["sim"] == 0.9 for x in asked):
            raise ConnectionError("down")
        if any(x["a"] == "prices fall" and x["b"] == "a fall" and x["sim"] == 0.9 for x in asked):
            return "I can't say."
        return str({"same": [x["n"] for x in asked if x["a"] != "plain"]}).replace("'", '"')

    veto = opposite(frame["title_a"], frame["title_b"], ["rise"], ["fall"])
    got = {(x.a, x.b): (x.verdict, x.error) for x in judged_pairs(frame, judge, veto, block=7).collect()}
    opposed = lambda p: {p[4], p[5]} & {"prices rise", "it will rise"} and {p[4], p[5]} & {"prices fall", "a fall"}
    asked = [p for p in pairs if not opposed(p)]
    want = {(p[1], p[2]): ("veto", None) for p in pairs if opposed(p)}
    groups = {}
    for x in _blocks(frame.join(spark.createDataFrame([(p[1],) for p in asked], "a long"), "a", "left_semi"), ["a", "b"], 7).collect():
        groups.setdefault((x.scope, x.part), []).append((-x.sim, x.a, x.b, x.title_a, x.title_b))
    for rows in groups.values():
        rows.sort()
        for k in range(0, len(rows), 7):
            block, error = rows[k : k + 7], None
            try:
                said = same_pairs(judge([{"n": n, "a": t, "b": u, "sim": -s} for n, (s, _, _, t, u) in enumerate(block)]), len(block))
                error = None if said is not None else "no readable answer"
            except ConnectionError as failure:
                said, error = None, f"ConnectionError: {failure}"
            for n, (s, a, b, _, _) in enumerate(block):
                want[(a, b)] = ("failed" if said is None else "different" if n not in said else "same" if -s >= 0.28 else "below_floor", error)
    assert got == want and {v for v, _ in got.values()} == {"veto", "failed", "different", "same", "below_floor"}
    assert max(map(len, groups.values())) < 40


def test_groups_and_clusters(spark):
    items = spark.createDataFrame([("s", k, f"{'abc'[k % 3]} title") for k in range(30)] + [("bad", 100, "a"), ("bad", 101, "a")], "scope string, id long, title string")

    def judge(asked):
        if asked[0]["scope"] == "bad":
            raise ValueError
        return str({"groups": [[x["n"] for x in asked if x["title"][0] == c] for c in "abc"]}).replace("'", '"')

    edges = {tuple(r) for r in judged_groups(items, judge, block=1000).collect()}
    assert edges == {(c, k) for c in range(3) for k in range(c + 3, 30, 3)}
    report = cluster_report(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"), spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)], "id long, root long"), spark.createDataFrame([(1, "e"), (2, "e"), (3, "f"), (7, "e")], "id long, event string"))
    assert {tuple(r) for r in report.collect()} == {(1, 3, 2, 2 / 3, 1, 1, 0), (7, 2, 1, 1.0, 0, 0, 1)}


def test_dated_rules(spark):
    d = datetime.date
    rules = [
        ("len", 1, "shorter", "t", "3", None, d(2024, 1, 1), 2), ("len", 2, "shorter", "t", "5", None, d(2024, 1, 10), 2), ("len", 3, "retired", "t", None, None, d(2024, 1, 20), 0),
        ("pat", 1, "matches", "t", "^x", "a", d(2024, 1, 1), 5), ("no", 1, "lacks", "t", "o", None, d(2024, 1, 15), 1), ("gone", 1, "missing", "t", None, None, d(2024, 1, 1), 9), ("same", 1, "differs", "t", "u", None, d(2024, 1, 18), 1),
        ("twice", 1, "longer", "t", "1", None, d(2024, 1, 3), 1), ("twice", 2, "longer", "t", "4", None, d(2024, 1, 3), 1), ("has", 1, "holds", "t", "BAD", None, d(2024, 1, 1), 3), ("has", 2, "holds", "u", "ugly", "b", d(2024, 1, 12), 3), ("must", 1, "wants", "u", "ok", "a", d(2024, 1, 5), 1),
    ]
    r = random.Random(3)
    rows = [(k, r.choice(["", "ab", "xbad", "good one", None, "x", "UGLY bad"]), r.choice(["ok", "ugly", None, "x"]), r.choice(["a", "b", None]), r.choice([None, *(d(2024, 1, n) for n in range(1, 28))])) for k in range(400)]

    def by_hand(t, u, scope, at):
        fields, out = {"t": t or "", "u": u or ""}, []
        for name in {x[0] for x in rules}:
            known = [x for x in rules if x[0] == name and at is not None and x[6] <= at]
            if not known:
                continue
            _, version, kind, field, value, of, _, severity = max(known, key=lambda x: (x[6], x[1]))
            text = fields[field]
            bad = {
                "retired": lambda: False, "shorter": lambda: len(text) < int(value), "longer": lambda: len(text) > int(value), "matches": lambda: re.search(value, text) is not None, "lacks": lambda: re.search(value, text) is None,
                "missing": lambda: not text.strip(), "differs": lambda: t is None or u is None or t != u, "holds": lambda: value.lower() in text.lower(), "wants": lambda: value.lower() not in text.lower(),
            }[kind]()
            if bad and of in (None, scope):
                out.append((name, version, severity))
        return out

    frame = spark.createDataFrame(rows, "id long, t string, u string, scope string, at date")
    broken = broken_rules(frame, rule_table(spark, rules), "id", "at", "scope")
    want = [(i, *b) for i, *x in rows for b in by_hand(*x)]
    assert sorted(map(tuple, broken.collect())) == sorted(want) and {w[1] for w in want} == {x[0] for x in rules}
    assert {(x.id, x.rule, x.broken) for x in first_broken(broken, "id").collect()} == {(i, min(bs, key=lambda b: (-b[2], b[0]))[0], len(bs)) for i, *x in rows if (bs := by_hand(*x))}
    assert broken_rules(frame, rule_table(spark, rules).limit(0), "id", "at", "scope").count() == 0
    many = spark.range(4000).selectExpr("concat('r', id) as rule", "1 as version", "'holds' as kind", "'t' as field", "concat('w', id) as value", "cast(null as string) as scope", "date'2024-01-01' as effective_from", "1 as severity")
    assert broken_rules(spark.createDataFrame([(1, "w17 w170", "u", "a", d(2024, 2, 1))], "id long, t string, u string, scope string, at date"), many, "id", "at", "scope").count() == 3
    assert periods(rule_table(spark, rules)).count() == 10
