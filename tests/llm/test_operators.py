"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievework.llm import additive_quality, block_labeller, chunk_recipes, cutting_stock, minhash_join, piece_codec, robust_outliers, snapshot_collapse, suffix_dedup, warc_members

WORDS = [f"w{i}" for i in range(4000)]
LONG = " ".join(WORDS[:900])
PASSAGE = " ".join(WORDS[1000:1150])
ROWS = [
    (1, LONG), (2, LONG), (3, LONG.replace("w5 ", "x5 ")), (4, None), (5, ""), (6, "   "), (7, "one two"), (8, "one two"),
    (9, "Lead a. " + PASSAGE + " tail a"), (10, "Other lead. " + PASSAGE + " end b"), (11, "é" * 700), (12, "1234 $$$ ###\nline\nline\n" * 4), (12, "again the same id"), (None, "no id at all here"), (2, LONG),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", "x") for i, t in ROWS], "doc_id long, text string, lang string, source string, kept string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts():
    return [(i, t or "") for i, t in ROWS]


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t in texts():
        groups.setdefault(t, []).append(i)
    want = sorted(((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts()), key=str)
    got = chunk_recipes.dedupe_exact(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert chunk_recipes.dedupe_exact(empty).count() == 0
    assert chunk_recipes.without_copies(docs).count() == len(groups)
    # one byte as identifier: different chunks clash, and verification tells their texts apart
    clashing = docs.union(docs.sparkSession.range(400).selectExpr("1000 + id", "repeat(concat('text ', id), 40 + id)", "'en'", "'s'", "'x'"))
    fields = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    short, full = (sorted((tuple(r) for r in chunk_recipes.dedupe_exact(clashing, n).select(fields).collect()), key=str) for n in (1, 16))
    assert short == full and len(full) == len(ROWS) + 400
    assert clashing.select("text").distinct().count() > chunk_recipes.document_recipes(clashing, 1).select("recipe").distinct().count()


def repeats_by_brute_force(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row, by counting all strings of length bytes."""
    count = Counter(t.encode()[i : i + length] for _, t in rows for i in range(len(t.encode()) - length + 1))
    want = []
    for i, t in rows:
        data = t.encode()
        ranges = suffix_dedup.removed_ranges([{"first": k, "last": k} for k in range(len(data) - length + 1) if count[data[k : k + length]] > 1], length)
        left = suffix_dedup.kept_bytes(data, suffix_dedup.whole_characters(data, ranges)).decode()
        want.append((i, len(data), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(suffix_dedup.kept_bytes(data, ranges)).hexdigest(), left))
    return sorted(want, key=str)


def passages_of_all_kinds():
    """Texts with a common passage just below and above 400 bytes, periods, near copies, characters of two bytes, and one of 200,000 bytes."""
    r = random.Random(3)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    short, long = some(60)[:390], some(120)[:430]
    rows = [(k, f"{some(r.randrange(40))} {r.choice([short, long, short[20:]])} {some(r.randrange(80))}") for k in range(60)]
    rows += [(100, "one line again\n" * 300), (101, "one line again\n" * 31), (102, "xy" * 900), (103, "ñandú " * 200), (104, some(15000) + long), (105, LONG), (106, LONG[:2000] + "changed" + LONG[2000:])]
    return rows


def test_suffix_dedup(docs, empty):
    assert sorted(map(tuple, suffix_dedup.removal_report(docs).collect()), key=str) == repeats_by_brute_force(texts(), 400)
    assert suffix_dedup.removal_report(empty).count() == 0


@pytest.mark.parametrize(("length", "gram"), [(400, 160), (240, 64)])
def test_suffix_dedup_of_wide_groups(spark, length, gram):
    rows = passages_of_all_kinds()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.removal_report(docs, length, gram).collect()), key=str) == repeats_by_brute_force(rows, length)
    plain = suffix_dedup._plain(docs)
    spans = lambda most: {r.id: suffix_dedup.removed_ranges(r.spans, length) for r in suffix_dedup.repeated_spans(plain, length, gram, most).collect()}
    assert spans(2) == spans(1500)  # groups split level by level give what one block gives


def test_near_dedup(docs, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash_join.near_duplicates(docs).collect()}
    assert [got[(i, 896)] for i in (1, 2, 3)] == [1, 1, 1]
    assert got[(8, 1)] == 7 and got[(4, 0)] == 4 and got[(6, 0)] == 6
    assert minhash_join.near_duplicates(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tool = Tokenizer.from_file(path)
    rows = cutting_stock.pack(docs, path).collect()
    ids = {}
    for i, t in texts():
        ids.setdefault(i, []).append(tool.encode(t, add_special_tokens=False).ids + [2])
    for r in rows:
        pieces = [x[r.start : r.start + r.length] for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(b"".join(n.to_bytes(4, "little") for n in p)) for p in pieces}
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert cutting_stock.pack(empty, path).count() == 0


def test_pieces(docs, empty):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t in texts():
        ids = [lib.bos_id(), *lib.encode(t), lib.eos_id()]
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_codec.encode_documents(docs, path).collect()), key=str) == sorted(want, key=str)
    assert piece_codec.encode_documents(empty, path).count() == 0


def test_quality_rules(docs, empty):
    import re

    got = {(r.doc_id, r.n_words): r for r in robust_outliers.judge(docs).collect()}
    for i, t in texts():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[(i, len(words))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert robust_outliers.judge(empty).count() == 0


def test_classifier_held_out(spark, empty):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = additive_quality.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert additive_quality.score_documents(empty, labels).count() == 0


def test_archives(spark, empty):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/é", None), (4, "", ""), (None, "u", "<p>ü</p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc_members.archive_round_trip(pages).collect()}
    digest = warc_members.payload_digest
    assert got == {1: (8, "response", None, digest(b"<p>x</p>")), 2: (8, "revisit", 1, digest(b"<p>x</p>")), 3: (0, "response", None, digest(b"")), 4: (0, "revisit", 3, digest(b"")), None: (9, "response", None, digest("<p>ü</p>".encode()))}
    assert warc_members.archive_round_trip(pages.limit(0)).count() == 0


def test_snapshots(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (3, 0, "user", None), (4, 5, "user", "a"), (4, 6, "bot", "b"), (4, 7, "user", "c")]
    got = {r.conv_id: r.n_turns for r in snapshot_collapse.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {2: 3, 3: 1}


def test_labeller(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.text for r in block_labeller.extract_pages(pages).collect()}
    for i, page in html.items():
        blocks = block_labeller.leaf_blocks(page or "")
        assert got[i] == "\n".join(b.text for b, y in zip(blocks, block_labeller.marked_labels(blocks) or [], strict=True) if y)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.documents(spark, sf)
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        new = corpus_pipeline.stage(function(spark, docs, sf), "test")
        assert new.count() > 0 and (k == 4 or new.columns == docs.columns)
        if k == 1:
            assert new.select("text").distinct().count() == new.count()
        if k == 2:
            assert new.count() == minhash_join.near_duplicates(docs).filter("kept").count()
        docs = new


NOTICES_AFTER = {
    "en": "Copyright by the owner of this page, all rights reserved, subscribe to our newsletter.",
    "de": "Wir verwenden Cookies auf dieser Seite, alle Rechte vorbehalten, Datenschutz und Impressum.",
    "es": "Utilizamos cookies en esta página, todos los derechos reservados, suscríbase al boletín.",
    "fr": "Nous utilisons des cookies sur cette page, tous droits réservés, abonnez-vous, mentions légales.",
}


def test_labeller_reads_all_words_of_neutral_markup(spark):
    plain = ("html", "body", "div", "p")
    lead = " ".join(f"word{i}" for i in range(15))
    far, other = (block_labeller.block_vector(block_labeller.Block(plain, f"{lead} {w}.", 0.0)) for w in ("cookies", "gardens"))
    assert far != other
    html = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").collect()]
    network = block_labeller.fit_labeller(html)
    blocks = [b for page in html for blocks in [block_labeller.leaf_blocks(page)] for b, y in zip(blocks, block_labeller.marked_labels(blocks) or [], strict=True) if y and 20 < len(b.text.split()) < 60]
    right = total = 0
    for k, (lang, notice) in enumerate([*NOTICES_AFTER.items()] * 10):
        article = [b.text for b in blocks[4 * k : 4 * k + 4]]
        lead = " ".join(blocks[-1 - k].text.split()[:13])
        page = "<html><body>" + "".join(f"<div><p>{t}</p></div>" for t in [*article, f"{lead} {notice}"]) + "</body></html>"
        got = block_labeller.main_texts(network, [page])[0].split("\n")
        assert not any(notice in t for t in got), lang
        right, total = right + sum(t in got for t in article), total + len(article)
    assert right >= 0.95 * total


def test_unclosed_markup_keeps_the_text_after_it():
    texts = lambda page: [b.text for b in block_labeller.leaf_blocks(page)]
    head = "<html><head><meta charset=utf-8><title>Name</title><style>p{}</style>"
    for start in ("<body>", "", "<body><main>", "</head><body>", "<span>Lead</span>", "Lead"):
        assert texts(f"{head}{start}<p>One.<p>Two.</p></body></html>")[-2:] == ["One.", "Two."], start
        assert "Lead" not in start or texts(f"{head}{start}<p>One.<p>Two.")[0] == "Lead"
    assert texts("<head><title>Name</title><template><div>Inert</div></template><p>One.") == ["One."]
    for tag in ("button", "select", "svg", "object", "canvas", "template"):
        assert texts(f"<body><{tag}>Gone<p>One.</p><div>Two.</div>") == ["One.", "Two."], tag
        assert texts(f"<body><div><{tag}>Gone<b>x<p>One.</p></div><{tag}><div>In</div></{tag}><p>Two.</p>") == ["One.", "Two."], tag
        assert texts(f"<body><{tag}><{tag}>a</{tag}><div>In</div></{tag}><p>Two.") == ["Two."], tag
    assert texts("<select><option>a<option>b<p>One.") == ["One."]
    assert texts("<body><button>Go<!-- </button> --><p>One.</p>") == ["One."]


def test_near_dedup_links_rows_without_ids(spark):
    near = lambda *gone: " ".join(w for i, w in enumerate(WORDS[:400]) if i not in gone)
    chain = lambda lo: " ".join(WORDS[1000 + lo : 1400 + lo])
    other = lambda *gone: " ".join(w for i, w in enumerate(WORDS[2000:2400]) if i not in gone)
    rows = [(21, near()), (None, near(7)), (31, chain(0)), (None, chain(50)), (32, chain(100)), (None, other()), (None, other(9)), (None, "alone and without any id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda t: set(zip(*(t.split()[k:] for k in range(5)), strict=False))
    like = lambda a, b: len(plain(a) & plain(b)) / len(plain(a) | plain(b))
    assert like(chain(0), chain(50)) >= 0.75 > like(chain(0), chain(100))
    size = lambda t: len(plain(t))
    got = minhash_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.n_shingles not in (size(other()), size(other(9))) or r.component_id) == Counter(
        [(21, 396, 21, True), (None, size(near(7)), 21, False), (31, 396, 31, True), (None, 396, 31, False), (32, 396, 31, False), (None, 3, None, True)]
    )
    assert sum(r.kept for r in got if r.doc_id is None) == 2  # one of other and other(9), and the text alone
    left = Counter((r.doc_id, r.text) for r in minhash_join.without_near_copies(docs).collect())
    alone = (None, "alone and without any id at all")
    assert left in [Counter([(21, near()), (31, chain(0)), alone, (None, t)]) for t in (other(), other(9))]


WRAPS = {"container": ("<div id='content'>", "</div>"), "article": ("<article>", "</article>"), "post": ("<div class='post-body'>", "</div>"), "main": ("<main>", "</main>"), "plain": ("<div>", "</div>"), "unknown": ("<div class='xyz'>", "</div>")}


def written_page(r, wrap, paragraphs=7):
    """(html, the article's paragraphs as written here)."""
    say = lambda n: " ".join(f"wort{r.randrange(400)}" for _ in range(n)).capitalize() + "."
    article = [say(r.randrange(15, 60)) for _ in range(paragraphs)]
    before = f"<div class='nav'><ul><li><a href='/'>{say(2)}</a></li><li><a href='/b'>{say(2)}</a></li></ul></div><div class='ad'>{say(8)}</div>"
    after = f"<div class='sidebar'><p>{say(6)}</p></div><div class='comments'><p>{say(12)}</p></div><div class='footer'>Copyright {say(5)}</div>"
    first, last = WRAPS[wrap]
    return f"<html><head><title>{say(4)}</title></head><body>{before}{first}{''.join(f'<p>{a}</p>' for a in article)}{last}{after}</body></html>", article


@pytest.mark.parametrize("trained_on", ["container", "article", "plain"])
def test_labeller_against_what_was_written(trained_on):
    r = random.Random(4)
    network = block_labeller.fit_labeller([written_page(r, trained_on)[0] for _ in range(64)])
    for wrap in WRAPS:
        pages = [written_page(r, wrap) for _ in range(20)]
        got = [t.split("\n") for t in block_labeller.main_texts(network, [html for html, _ in pages])]
        found = sum(a in g for g, (_, article) in zip(got, pages, strict=True) for a in article)
        assert found == 140 if wrap == trained_on or wrap in ("container", "article", "main") else found >= 130, wrap
        assert sum(t not in article for g, (_, article) in zip(got, pages, strict=True) for t in g) == 0, wrap


def made_up(r):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(5, 9)))


def untold_pages(r, kind):
    """(html, article paragraphs, words that mark everything else): names are made up or those of no list."""
    say = lambda n: " ".join(f"wort{r.randrange(400)}" for _ in range(n)).capitalize() + "."
    article = [say(r.randrange(15, 60)) for _ in range(5)]
    body = f"<h1>{say(4)}</h1>" + "".join(f"<p>{a}</p>" for a in article)
    name = {"disqus": "disqus", "commentlist": "commentlist", "opinions": "user-opinions"}.get(kind) or made_up(r)
    outer, item = {"disqus": ("section", "div"), "commentlist": ("ol", "li"), "list": ("ul", "li"), "articles": ("section", "article")}.get(kind, ("div", "div"))
    said = "".join(f"<{item} class='{name}-x'><div>Junk{k}</div><div>{k + 2} May 2024, 10:0{k}</div><p>junk {say(r.randrange(4, 30))}</p></{item}>" for k in range(r.randrange(2, 6)))
    menu = "<ul>" + "".join(f"<li><a href='/{k}'>junk {k}</a></li>" for k in range(6)) + "</ul>"
    notice, foot = f"<div class='{made_up(r)}'><p>junk куки {made_up(r)}</p></div>", f"<div class='{made_up(r)}'>&copy; 2024 junk <a href='/i'>junk</a></div>"
    if kind == "table":
        return f"<body><table><tr><td>{menu}</td><td>{body}</td></tr></table>{foot}", article
    holder = {"role": "<div role=main>{}</div>", "article": "<article>{}</article>"}.get(kind, f"<div class='{made_up(r)}'>{{}}</div>").format(body)
    return f"<html><body>{notice if kind == 'notice' else ''}<div class='{made_up(r)}'>{menu}</div>{holder}<{outer} class='{name}'>{said}</{outer}>{foot}</body></html>", article


def test_labeller_by_structure(spark):
    html = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(64).collect()]
    network, r = block_labeller.fit_labeller(html), random.Random(9)
    for kind in ("disqus", "commentlist", "opinions", "list", "articles", "plain", "role", "article", "table", "notice"):
        pages = [untold_pages(r, kind) for _ in range(30)]
        got = [t.split("\n") for t in block_labeller.main_texts(network, [h for h, _ in pages])]
        kept = sum(any("junk" in t.lower() for t in g) for g in got)
        lost = sum(a not in g for g, (_, article) in zip(got, pages, strict=True) for a in article)
        assert kept <= 2 and lost <= 5, (kind, kept, lost)


def test_labeller_on_all_pages(spark):
    """Against the article element's own text, cut by another rule."""
    import html as entities
    import re

    def article(page):
        inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
        parts = (" ".join(entities.unescape(re.sub("<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        return "\n".join(x for x in parts if x)

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in block_labeller.extract_pages(pages).collect()}
    tight = lambda t: "\n".join("".join(x.split()) for x in t.split("\n"))
    assert [i for i in want if tight(want[i]) != tight(got[i])] == [] and len(got) == 2500


def test_random_pages_mark_the_article_alone():
    import numpy as np

    rng = np.random.default_rng(2)
    pages = [block_labeller.random_page(rng, ["some words of a line that are borrowed"]) for _ in range(200)]
    assert all(any(y for _, y in page) for page in pages) and 0.3 < np.mean([y for page in pages for _, y in page]) < 0.9
    never = frozenset(("nav", "footer", "form", "aside"))
    assert not any(y and not never.isdisjoint(b.path) for page in pages for b, y in page)
    assert not any(block_labeller.MARK in b.text for page in pages for b, _ in page)


def test_structure_of_a_page():
    page = "<body><ul><li><a>Menu</a><li><a>More</a></ul><div><p>" + "Long text here. " * 9 + "<p>" + "Other text here. " * 9 + "</div><ol><li><b>Ann</b><p>1 May 2024<p>Said so<li><b>Bob</b><p>2 May 2024<p>No</ol>"
    blocks = block_labeller.leaf_blocks(page)
    rows = block_labeller.structure(blocks)
    assert [b.text.split()[0] for b in blocks] == ["Menu", "More", "Long", "Other", "Ann", "1", "Said", "Bob", "2", "No"]
    assert [r[2] for r in rows] == [0, 0, 1, 1, 0, 0, 0, 0, 0, 0] and [r[3] for r in rows] == [1, 1] + [0] * 8 and [r[4] for r in rows] == [0] * 4 + [1] * 6
    assert [r[5] > 0 for r in rows] == [False] * 4 + [True] * 6 and [r[6] for r in rows] == [0] * 4 + [1] * 6 and rows[0][7] == 1
    assert block_labeller.structure([]) == []


def test_labeller_of_odd_pages(spark):
    r = random.Random(8)
    long, article = written_page(r, "article", 3000)
    usual = written_page(r, "article")[0]
    rows = [(1, "u", long, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "   \n", "x"), (5, "u", usual, "x"), (5, "u", usual, "x"), (None, "u", usual, "x"), (6, "u", "<p", "x"), (7, "u", "&amp;&nbsp;&lt;", "x")]
    pages = spark.createDataFrame([*rows, *((100 + k, "u", written_page(r, "article")[0], "x") for k in range(30))], "page_id long, url string, html string, text string")
    got = [(i.page_id, i.url, i.text, i.n_chars) for i in block_labeller.extract_pages(pages).collect()]
    by_id = {g[0]: g for g in got}
    assert len(got) == 39 and all(n == len(t) for _, _, t, n in got)
    assert by_id[1][2] == "\n".join(article) and [by_id[i][2] for i in (2, 3, 4, 6)] == [""] * 4 and by_id[2][1] is None
    assert [g[2] for g in got if g[0] in (5, None)] == [by_id[5][2]] * 3
    assert block_labeller.extract_pages(pages.limit(0)).count() == 0


CLASHES = ("row", "digest", "gone_id", "gone_text", "spans", "text_hash", "in_0", "kept", "node", "_id", "_hash", "_gone", "_text_hash", "_spans", "_kept", "score", "a.b")


def test_stages_keep_columns_that_clash_with_their_own(spark):
    """Each filtering stage of the pipeline returns the columns of its input unchanged, whatever their names."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd).withColumns({c: F.lit(f"user's {c}") for c in CLASHES})
    for name, function in corpus_pipeline.STAGES[:4]:
        out = function(spark, docs, sf)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        kept = out.select(*(F.col(f"`{c}`") for c in CLASHES)).distinct().collect()
        assert [tuple(r) for r in kept] == [tuple(f"user's {c}" for c in CLASHES)], name
        assert function(spark, docs.limit(0), sf).count() == 0, name
