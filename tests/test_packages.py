"""Drafts, packages, originals and ledgers against plain Python."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from sievework.operators import drafts as D
from sievework.operators import originals as O

SECTIONS = [("Uzbekistan", "uz"), ("Kazakhstan", "kz"), ("Kazakhstan North", "kn")]


def read_draft(lines):
    """The same draft read line by line: [(number, section, title, body, source, quote, published)], [(n, warning)]."""
    items, warnings, section, current = [], [], None, None
    for n, raw in enumerate(lines):
        line = (raw or "").strip(" ")
        bare = re.sub(r"[【】\[\]（）()]", "", re.sub(r"^[#>\s]+", "", line)).strip(" ")
        heads = sorted((-len(name), code) for name, code in SECTIONS if bare.startswith(name) and len(bare) <= len(name) + 6)
        if heads:
            section, current = heads[0][1], None
            continue
        if not line:
            continue
        fields = [re.match(D.label_pattern(labels), line) for labels in (D.SOURCE_LABELS, D.QUOTE_LABELS)]
        start = re.match(D.NUMBERED, line)
        title = re.sub(r"[*]{2,}", "", start[2]).strip(" ") if start else ""
        if any(fields):
            if current is None:
                warnings.append((n, "field_without_item"))
                continue
            for k, f in zip((4, 5), fields, strict=True):
                current[k] = f[1] if f else current[k]
        elif title and len(title) <= 120:
            current = [int(start[1]), section or "none", title, [], None, None, None]
            items.append(current)
            continue
        elif current is None:
            if len(line) > 60 or section is None:
                warnings.append((n, "prose_without_item"))
                continue
            current = [len(items) + 1, section, line, [], None, None, None]
            items.append(current)
            continue
        else:
            current[3].append(line)
        found = re.search(D.DATE, line)
        if found and current[6] is None:
            current[6] = f"{found[1]}-{found[2]:0>2}-{found[3]:0>2}"
    return [(*i[:3], "\n\n".join(i[3]), *i[4:]) for i in items], warnings


def test_drafts_equal_a_line_reader(spark):
    rng = random.Random(5)
    parts = ["", None, "  ", "Kazakhstan", "## [Uzbekistan] daily", "Kazakhstan North", "Kazakhstan and its neighbours", "1. First title", "**2、 Second** one", "3) " + "x" * 130, "Source: Agency, 2024-3-7", "source：B", "原文: quoted 2023/11/02",
             "A short line", "Prose of 2025年1月5日 that goes on. " * 3, "Seen 2024-13-45", "Source:", "20 people came", "来源: 乙"]
    drafts = {k: [rng.choice(parts) for _ in range(rng.randint(0, 25))] for k in range(150)}
    lines = spark.createDataFrame([(k, n, x, "kept out") for k, d in drafts.items() for n, x in enumerate(d)], "doc long, n int, line string, code string")
    placed = D.placed_lines(lines, spark.createDataFrame(SECTIONS, "name string, code string"))
    items, warnings = {}, {}
    for r in sorted(D.draft_items(placed, "none").collect(), key=lambda r: (r.doc, r.item)):
        items.setdefault(r.doc, []).append((r.number, r.section, r.title, r.body, r.source, r.quote, r.published))
    for r in sorted(D.draft_warnings(placed).collect(), key=lambda r: (r.doc, r.n)):
        warnings.setdefault(r.doc, []).append((r.n, r.warning))
    for k, d in drafts.items():
        assert (items.get(k, []), warnings.get(k, [])) == read_draft(d)
    assert len(items) > 50 and len(warnings) > 50


def test_drafts_without_lines_or_sections(spark):
    none = spark.createDataFrame([], "doc long, n int, line string")
    sections = spark.createDataFrame([], "name string, code string")
    assert D.draft_items(D.placed_lines(none, sections), "none").count() == 0
    one = spark.createDataFrame([(1, 0, "7. Title"), (1, 1, "Body")], "doc long, n int, line string")
    assert [tuple(r)[2:6] for r in D.draft_items(D.placed_lines(one, sections), "none").collect()] == [(7, "none", "Title", "Body")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_issue_windows(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-09 21:59:59' as t union all select timestamp_ntz'2024-01-09 22:00:00'").select(O.issue_of(F.col("t")).alias("i")).collect()
    assert sorted(r.i for r in rows) == ["2024-01-10", "2024-01-11"]
    days = spark.createDataFrame([("2024-01-10",), ("2024-1-10",), ("2024-02-30",), ("",), (None,)], "i string").select(O.issue_end(F.col("i")).alias("e")).collect()
    assert [r.e for r in days] == [datetime.datetime(2024, 1, 9, 22), None, None, None, None]


def test_handoffs(spark):
    texts = {"good": [(1, "a"), (2, None)], "hash": [(3, "c")], "twice": [(4, "d"), (4, "d")], "unnamed": [(None, "e")], "empty": [], "many": [(k, "m") for k in range(100, 121)], "window": [(5, "f")], "draft": [(6, "g")], "blank": [(7, "h")], "off": [(8, "i")], "full": [(k, "n") for k in range(200, 220)]}
    lines = lambda rows: sha("\n".join(f"{i}:{sha(t or '')}" for i, t in sorted(rows, key=lambda r: r[0] or 0)))
    end = datetime.datetime(2024, 1, 9, 22)
    day = datetime.timedelta(days=1)
    packages = []
    for name, rows in texts.items():
        stop = end + datetime.timedelta(minutes=name == "window")
        packages.append((name, "2024-1-10" if name == "off" else "2024-01-10", end - day, stop, None if name == "draft" else True, " " if name == "blank" else "w", sha("no") if name == "hash" else lines(rows), "extra"))
    given = spark.createDataFrame(packages, "package string, issue string, window_start timestamp_ntz, window_end timestamp_ntz, ready boolean, writer string, body_hash string, n string").drop("n")
    articles = spark.createDataFrame([(p, i, t) for p, rows in texts.items() for i, t in rows], "package string, id long, text string")
    found = {r.package: (r.n, r.error) for r in O.handoff_errors(given, articles).collect()}
    assert found == {"good": (2, None), "full": (20, None), "hash": (1, "hash"), "twice": (2, "ids"), "unnamed": (1, "ids"), "empty": (0, "count"), "many": (21, "count"), "window": (1, "window"), "off": (1, "window"), "draft": (1, "not_final"), "blank": (1, "not_final")}


def test_bound_originals(spark):
    entry = lambda i, **kw: tuple((dict(id=i, validated=True, fingerprint="f", path=f"p{i}", file_hash=sha(f"raw{i}"), text_hash=sha(f"text{i}")) | kw).values())
    ledger = spark.createDataFrame([entry(1), entry(2, validated=None), entry(3, fingerprint="g"), entry(4, path="gone"), entry(5, file_hash="x"), entry(6, text_hash="x"), entry(7), entry(8, path=None)], "id long, validated boolean, fingerprint string, path string, file_hash string, text_hash string")
    index = spark.createDataFrame([(k, "f") for k in range(1, 9)], "id long, fingerprint string")
    archive = spark.createDataFrame([(f"p{k}", f"raw{k}", " " if k == 7 else f"text{k}") for k in range(1, 9)], "path string, raw string, text string")
    asked = [("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6), ("c", 7), ("c", 8), ("c", 99), ("twice", 1), ("twice", 1), ("none", None)] + [("six", k) for k in range(1, 7)]
    out = {(r.request, r.id): r.error for r in O.bound_originals(spark.createDataFrame(asked, "request string, id long"), ledger, index, archive).collect()}
    assert out == {
        ("a", 1): None, ("a", 2): "not_validated", ("a", 3): "evidence_changed", ("b", 4): "archive_missing", ("b", 5): "file_changed", ("b", 6): "text_changed", ("c", 7): "text_changed", ("c", 8): "archive_missing", ("c", 99): "not_in_ledger",
        ("twice", 1): "request", ("none", None): "request",
    } | {("six", k): "request" for k in range(1, 7)}


def test_overlay_equals_a_fold(spark):
    rng = random.Random(8)
    ledger = [(k, rng.choice(["pending", None, "selected"]), rng.choice([None, "old"]), rng.choice([True, False, None])) for k in range(60)]
    events = [(rng.randrange(70), rng.randrange(4), n, rng.choice(["selected", "rejected", None]), rng.choice([None, "new"]), rng.choice([True, None])) for n in range(150)]
    adopted = {k for k in range(60) if rng.random() < 0.4}
    last = {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        last[e[0]] = e[3:]
    want = {}
    for k, *own in ledger:
        decision, reason, disclosed = (o if n is None else n for o, n in zip(own, last.get(k, (None,) * 3), strict=True))
        error = "selection_mismatch" if k in last and decision != ("selected" if k in adopted else "rejected") else "no_first_disclosure" if k in adopted and not (decision == "selected" and disclosed) else None
        want[k] = (decision, reason, k in adopted, error)
    fields = "decision string, reason string, disclosed boolean"
    out = O.overlaid(spark.createDataFrame(ledger, f"id long, {fields}"), spark.createDataFrame(events, f"event long, at int, seq int, {fields}"), spark.createDataFrame([(k,) for k in [*adopted, *adopted]], "id long"))
    assert {r.id: (r.decision, r.reason, r.adopted, r.error) for r in out.collect()} == want
    assert {v[3] for v in want.values()} == {None, "selection_mismatch", "no_first_disclosure"}


def test_ledger_rules(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    row = lambda i, url, **kw: tuple((dict(id=i, url=url, decision="selected", reason="r", discovered_at=t(2), start=t(1), stop=t(3), text_at=t(2)) | kw).values())
    schema = "id long, url string, decision string, reason string, discovered_at timestamp, start timestamp, stop timestamp, text_at timestamp"
    good = [row(1, "a"), row(2, "b", decision="rejected", text_at=None)]
    articles, records = [(1, "a")], [("a", t(2)), ("a", t(4))]

    def broken(ledger, adopted=articles, seen=records):
        found = O.ledger_errors(spark.createDataFrame(ledger, schema), spark.createDataFrame(adopted, "id long, url string"), spark.createDataFrame(seen, "url string, at timestamp"))
        return sorted(map(tuple, found.collect()))

    assert broken(good) == []
    assert broken([], [], []) == []
    assert broken([*good, row(2, "b", decision="rejected", text_at=None)]) == [("id_repeated", "2"), ("url_repeated", "b")]
    assert broken([*good, row(None, None, decision="pending")]) == [("id_repeated", ""), ("pending", ""), ("text_without_record", ""), ("url_repeated", "")]
    assert broken([row(1, "a", discovered_at=t(9), reason=" "), *good[1:]]) == [("discovered_outside", "1"), ("no_reason", "1")]
    assert broken([row(1, "a", text_at=None), *good[1:]]) == [("selected_without_text", "1")]
    assert broken([row(1, "a", text_at=t(3)), *good[1:]]) == [("text_without_record", "1")]
    assert broken([*good, row(3, "c", decision="maybe", text_at=None)]) == [("decision_unknown", "3")]
    assert broken(good, [(1, "a"), (1, "z")], [*records, ("y", t(1))]) == [("adopted_id_repeated", "1"), ("adopted_not_selected", "z"), ("text_not_in_ledger", "y")]
    assert broken(good, [(1, "b")]) == [("adopted_not_selected", "b"), ("selected_not_adopted", "a")]
