"""HTML main-text extraction with a recurrent block labeller (operator 5).

A page is cut into its leaf blocks, in order. Each block becomes a sparse vector: hashed tags, classes, ids and roles of its path,
all of its words hashed and counted (as a vector of length one, so that a word that fills a block weighs no more than many do),
and a few numbers, some of which tell its place in the page's structure: how much of the
page's text its element holds, whether it stands inside the element with most of the text, before or after it, how many like
items stand beside the one it is in, whether these are dated, and the share of links around it. A bidirectional LSTM in numpy
reads the whole sequence and labels every block as article text or not, so that a block is judged by what stands around it.
Blocks labelled as text are joined.

The network is trained here, on pages laid out at random (menus, notices, adverts, sidebars, forms, reader comments, footers) that
borrow their words from a bounded sample of pages or invent them, and on those of the sample's pages whose own markup tells where
the text is. On half of the random pages names tell nothing: classes and ids are made up or missing, and comments show by their
repeated, dated items, menus by their links, the article by its text. The sample, the only thing that is bounded, has at most
SAMPLE_PAGES pages of at most SAMPLE_CHARS characters, those with the least hash of page_id; of them training takes SAMPLE_LINES
lines and, from each page, PAGE_PARTS parts of TRAIN_BLOCKS blocks. It runs on the driver in a fixed number of steps. Every page
is then read whole, whatever its length.

Defined cases: a null, empty or blank html has an empty text; markup that ends early or is never closed is read as far as it
goes; repeated rows are extracted alike; null ids and urls are kept; other columns are ignored, whatever their names; an empty
table gives no rows; if all page_ids are null, training has invented lines only.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Recent

SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_LINES, TRAIN_BLOCKS, PAGE_PARTS = 64, 1_000_000, 3000, 80, 5
STEPS, BATCH = 300, 24
PLAIN_SHARE = 0.25
PATH_SHARE, WORD_SHARE, HIDDEN, NUMBERS = 384, 1024, 20, 16
FEATURES = PATH_SHARE + WORD_SHARE
#: Blocks whose vectors are added up at once: at most FEATURES places each.
PROJECTED = 256
#: Fixed values of HTML: elements that break lines, that have no text, that have no end, and that hold raw text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED_TAGS = frozenset("script style noscript template svg textarea iframe object canvas head title button select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_MARKS = {"class": ".", "id": "#", "role": "@", "itemprop": "="}
HEAD_TAGS = frozenset("base basefont bgsound link meta title noscript noframes style script template html head".split())
_MAY_STAY_OPEN = re.compile(r"<(?:button|select|svg|object|canvas|template)\b", re.I)
_ENDS_P = BLOCK_TAGS - {"body", "html", "head"}
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}


@dataclass
class Block:
    """A leaf block: the names on its path (tags, then .class, #id, @role and =itemprop words), its text, the share of it within
    links, and the elements around it, each as a number of its own and its names."""

    path: tuple[str, ...]
    text: str
    linked: float
    chain: tuple[tuple[int, tuple[str, ...]], ...] = ()


def unclosed_starts(page: str) -> set[int]:
    """Where start tags end whose elements have no text of their own and never get an end tag."""
    if not _MAY_STAY_OPEN.search(page):
        return set()
    waiting: dict[str, list[int]] = {t: [] for t in DROPPED_TAGS - RAW_TAGS - {"head"}}
    at = 0
    while found := _TOKEN.search(page, at):
        at, tag = found.end(), (found[2] or "").lower()
        if tag in waiting:
            if not found[1] and not found[3].endswith("/"):
                waiting[tag].append(at)
            elif found[1] and waiting[tag]:
                waiting[tag].pop()
        elif tag in RAW_TAGS and not found[1] and not found[3].endswith("/"):
            raw = _RAW_END[tag].search(page, at)
            at = raw.end() if raw else len(page)
    return {x for places in waiting.values() for x in places}


def leaf_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; text outside block elements is a block of its own.

    What can't stand in a head ends an open head, and a block element ends an open button, select, svg, object, canvas or
    template that has no end tag."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # the last: dropped, but without an end tag
    around: tuple[tuple[int, tuple[str, ...]], ...] = ()
    made = 0
    unclosed = unclosed_starts(page)
    path: tuple[str, ...] = ()
    parts: list[str] = []
    linked = dropped = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(path, text, min(1.0, linked / max(1, len(text))), around))
            parts.clear()
            linked = 0

    def leave(k: int) -> None:
        nonlocal path, around, dropped, links
        for tag, _, _ in stack[k:]:
            dropped -= tag in DROPPED_TAGS
            links -= tag == "a"
        del stack[k:]
        path, around = tuple(n for _, names, _ in stack for n in names), around[:k]

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at and dropped and stack[-1][0] == "head" and page[at:end].strip():
            leave(len(stack) - 1)
        if end > at and not dropped:
            parts.append(page[at:end])
            linked += links and len(page[at:end].strip())
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in BLOCK_TAGS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                if tag not in BLOCK_TAGS and stack[k][0] in BLOCK_TAGS:
                    break  # an inline end tag doesn't close the block around it
            continue
        if unclosed and tag in BLOCK_TAGS and tag != "option":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][2]:
                    leave(k)
                elif stack[k][0] in DROPPED_TAGS:
                    break
        if tag not in HEAD_TAGS and stack and stack[-1][0] == "head":
            leave(len(stack) - 1)
        if tag in BLOCK_TAGS:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                open_tag = stack[k][0]
                if open_tag == "p" and tag in _ENDS_P:
                    leave(k)
                    continue
                if open_tag == tag and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                    leave(k)
                    break
                if open_tag in BLOCK_TAGS:
                    break
        elif tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS or found[3].endswith("/"):
            continue
        names = [tag]
        if found[3]:
            for name in _NAMES.finditer(found[3]):
                kind, value = name[1].lower(), name[2] or name[3] or name[4] or ""
                if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none", value):
                    names.append("!hidden")
                elif kind != "style":
                    names += [_MARKS[kind] + w for w in re.split(r"[^a-z]+", value.lower()) if w]
        if tag in RAW_TAGS:
            raw = _RAW_END[tag].search(page, at)
            at = raw.end() if raw else len(page)
            continue
        stack.append((tag, tuple(names), at in unclosed))
        dropped += tag in DROPPED_TAGS
        links += tag == "a"
        made += 1
        path, around = path + stack[-1][1], (*around, (made, stack[-1][1]))
    flush()
    return out


_HASHES: dict[str, int] = {}


def _bucket(name: str, low: int, high: int) -> int:
    found = _HASHES.get(name)
    if found is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        found = _HASHES[name] = low + zlib.crc32(name.encode()) % (high - low)
    return found


_DIGITS = re.compile(r"\d")
_EDGES = ".,:;!?¡¿()[]{}<>\"'“”„‘’«»…·|*-–—"


def _word_place(word: str) -> int:
    return PATH_SHARE + zlib.crc32((word.strip(_EDGES) or word).encode(errors="replace")) % WORD_SHARE


_WORDS = Recent(_word_place, 200_000)


_DATE = re.compile(r"\d{1,2}[:h.]\d{2}\b|\b\d{1,4}[-./]\d{1,2}[-./]\d{1,4}\b|\b(?:19|20)\d\d\b|\b\d{1,2}\.? \w{3,9}\b")
#: The share of a page's text from which an element holds the most of it.
MOST = 0.5


def structure(blocks: list[Block]) -> list[list[float]]:
    """Numbers of each block's place in its page: the text share of its element, inside, before and after the innermost element
    that holds most of the text, like items beside its own, whether those are dated, and the links of its list or element.

    An item is an element of two blocks or more, one of several with the same names in the same parent."""
    # of each element: plain text, linked text, blocks, dated, depth, parent, names; parents come before what they hold
    info: dict[int, list] = {0: [0.0, 0.0, 0, False, -1, 0, ()]}
    dates = [len(b.text) < 60 and _DATE.search(b.text) is not None for b in blocks]
    total = 0.0
    for block, dated in zip(blocks, dates, strict=True):
        size = len(block.text)
        linked = size * block.linked
        total += size - linked
        parent = 0
        for element, names in block.chain:
            held = info.get(element)
            if held is None:
                held = info[element] = [0.0, 0.0, 0, False, info[parent][4] + 1, parent, names]
            held[0] += size - linked
            held[1] += linked
            held[2] += 1
            held[3] = held[3] or dated
            parent = element
    total = total or 1.0
    items: dict[tuple, list[int]] = {}
    most, depth = -1, -1
    for element, held in info.items():
        if held[2] > 1:
            items.setdefault((held[5], held[6]), []).append(element)
        if held[2] > 1 and held[4] > depth and held[0] >= MOST * total:
            most, depth = element, held[4]
    #: (like items, whether they are dated, inside the element of most text) of the elements on the way to each
    seen: dict[int, tuple[int, bool, bool]] = {0: (1, False, False)}
    for element, held in info.items():
        if element:
            alike, stamped, inner = seen[held[5]]
            group = items.get((held[5], held[6]), ()) if held[2] > 1 else ()
            if len(group) > alike:
                alike, stamped = len(group), sum(info[e][3] for e in group) * 2 > len(group)
            seen[element] = (alike, stamped, inner or element == most)
    own = [b.chain[-1][0] if b.chain else 0 for b in blocks]
    inside = [seen[e][2] for e in own]
    first = inside.index(True) if True in inside else len(blocks)
    last = len(inside) - 1 - inside[::-1].index(True) if True in inside else -1
    out = []
    for i, (block, element) in enumerate(zip(blocks, own, strict=True)):
        alike, stamped, _ = seen[element]
        around = info[element][5] or element
        mass, links = info[around][:2]
        out.append([
            info[element][0] / total, mass / total, float(inside[i]), float(i < first), float(i > last), min(1.0, math.log(alike) / 2), float(stamped), links / max(1.0, links + mass),
            min(1.0, len(block.text) * (1 - block.linked) / total), float(dates[i]),
        ])
    return out


def page_vectors(blocks: list[Block]) -> list[tuple[list[int], list[float], list[float]]]:
    return [(spots, weights, numbers + more) for (spots, weights, numbers), more in zip(map(block_vector, blocks), structure(blocks), strict=True)]


def block_vector(block: Block) -> tuple[list[int], list[float], list[float]]:
    """(hashed path and word places, their weights, numbers of the block alone). Every word of the block counts; a word place weighs its count, and
    all of a block's have length one."""
    spots = {_bucket("/" + n, 0, PATH_SHARE) for n in block.path}
    if block.path:
        spots.add(_bucket(">" + "/".join(n for n in block.path[-3:]), 0, PATH_SHARE))
    words = block.text.lower().split()
    n = len(words)
    counts = Counter(map(_WORDS.__getitem__, words))
    root = math.sqrt(sum(c * c for c in counts.values())) or 1.0
    return [*spots, *counts], [1.0] * len(spots) + [c / root for c in counts.values()], [min(1.0, math.log1p(n) / 6), block.linked, min(1.0, 8 * len(_DIGITS.findall(block.text)) / max(1, len(block.text))), float(block.text[-1] in ".!?…\"”"), float(block.text[0].isupper()), 1.0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockNetwork:
    """A bidirectional LSTM over sparse block vectors; forward and backward passes in numpy."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"out": make(2 * HIDDEN), "bias": np.zeros(1, dtype=np.float32)}
        for d in "fb":
            self.p |= {f"{d}s": np.concatenate([make(PATH_SHARE, 4 * HIDDEN), np.zeros((WORD_SHARE, 4 * HIDDEN), np.float32)]), f"{d}n": make(NUMBERS, 4 * HIDDEN), f"{d}h": make(HIDDEN, 4 * HIDDEN)}

    def inputs(self, pages: list[list[tuple[list[int], list[float], list[float]]]]) -> tuple[np.ndarray, ...]:
        """Flat block inputs and each page's length."""
        blocks = [b for page in pages for b in page]
        sizes = np.array([len(s) for s, _, _ in blocks], dtype=np.int64)
        spots = np.fromiter(chain.from_iterable(s for s, _, _ in blocks), dtype=np.int64, count=int(sizes.sum()))
        weights = np.fromiter(chain.from_iterable(w for _, w, _ in blocks), dtype=np.float32, count=int(sizes.sum()))
        numbers = np.array([n for _, _, n in blocks], dtype=np.float32).reshape(-1, NUMBERS)
        return spots, weights, sizes, numbers, np.array([len(p) for p in pages], dtype=np.int64)

    def _projected(self, d: str, spots: np.ndarray, weights: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out = numbers @ self.p[d + "n"]
        full, ends = np.flatnonzero(sizes), np.cumsum(sizes)
        for at in range(0, len(full), PROJECTED):
            part = full[at : at + PROJECTED]
            low, high = ends[part[0]] - sizes[part[0]], ends[part[-1]]
            out[part] += np.add.reduceat(self.p[d + "s"][spots[low:high]] * weights[low:high, None], ends[part] - sizes[part] - low, axis=0)
        return out

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: pages, steps, gates (already turned for the backward direction)."""
        n, steps, _ = x.shape
        h, c, out, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps):
            z = x[:, t] + h @ self.p[d + "h"]
            i, f, o, g = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN] + 1), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            m = mask[:, t, None]
            if keep:
                kept.append((h, c, i, f, o, g, new, m))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[:, t] = h
        return out, kept

    def _grid(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each direction the block that stands at (page, step); and where there is one."""
        steps = int(lengths.max()) if len(lengths) else 0
        first, t = (np.cumsum(lengths) - lengths)[:, None], np.arange(steps)[None, :]
        mask = t < lengths[:, None]
        return np.where(mask, first + t, 0), np.where(mask, first + lengths[:, None] - 1 - t, 0), mask

    def logits(self, pages: list, keep: bool = False):
        spots, weights, sizes, numbers, lengths = self.inputs(pages)
        ahead, back, mask = self._grid(lengths)
        state = {}
        total = np.full(len(numbers), self.p["bias"][0], dtype=np.float32)
        for k, (d, grid) in enumerate((("f", ahead), ("b", back))):
            out, kept = self._run(d, self._projected(d, spots, weights, sizes, numbers)[grid], mask, keep)
            flat = np.zeros((len(numbers), HIDDEN), np.float32)
            flat[grid[mask]] = out[mask]
            total += flat @ self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            state[d] = (grid, kept, flat)
        return total, (spots, weights, sizes, numbers, mask, state)

    def gradients(self, pages: list, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        total, (spots, weights, sizes, numbers, mask, state) = self.logits(pages, keep=True)
        p = _sigmoid(total)
        loss = float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))
        up = ((p - labels) / len(labels)).astype(np.float32)
        grads = {"bias": np.array([up.sum()], np.float32), "out": np.concatenate([state["f"][2].T @ up, state["b"][2].T @ up])}
        order = np.argsort(spots, kind="stable")
        owner, scaled = np.repeat(np.arange(len(sizes)), sizes)[order], weights[order, None]
        used, begins = np.unique(spots[order], return_index=True)
        for k, d in enumerate("fb"):
            grid, kept, _ = state[d]
            weight, dh, dc = self.p[d + "h"], 0, 0
            d_in = np.zeros((len(numbers), 4 * HIDDEN), np.float32)
            d_w = np.zeros_like(weight)
            for t in range(len(kept) - 1, -1, -1):
                h, c, i, f, o, g, new, m = kept[t]
                dh = dh + np.where(m, up[grid[:, t], None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN], 0)
                th = np.tanh(new)
                d_new = np.where(m, dc + dh * o * (1 - th * th), 0)
                dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), np.where(m, dh * th, 0) * o * (1 - o), d_new * i * (1 - g * g)], axis=1)
                d_w += h.T @ dz
                d_in[grid[:, t][mask[:, t]]] = dz[mask[:, t]]
                dc = np.where(m, d_new * f, dc)
                dh = np.where(m, dz @ weight.T, dh)
            grads[d + "h"], grads[d + "n"] = d_w, numbers.T @ d_in
            grads[d + "s"] = np.zeros_like(self.p[d + "s"])
            if len(used):
                grads[d + "s"][used] = np.add.reduceat(d_in[owner] * scaled, begins, axis=0)
        return loss, grads

    def train(self, draw, steps: int, rate: float = 0.02) -> float:
        """draw(step) -> (pages of block vectors, labels); Adam."""
        first, second, loss = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0.0
        for step in range(1, steps + 1):
            loss, grads = self.gradients(*draw(step))
            scale = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= scale * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        return loss


_OUTSIDE = frozenset({"nav", "header", "footer", "aside", "form", "!hidden", "menu"} | {f"{s}{w}" for s in ".#" for w in "ad ads advert nav menu sidebar comment comments cookie notice banner footer header share related promo newsletter".split()})
_SEMANTIC = frozenset(("article", "main", "@main", "=articlebody"))
_CONTAINERS = frozenset(f"{s}{w}" for s in ".#" for w in "article content entry main post story".split())


def marked_labels(blocks: list[Block]) -> list[float] | None:
    """1 for each block inside the article and outside whatever never is article text, 0 for the others. Semantic tags tell, or,
    where no text is within one, classes and ids of containers; None if neither does."""
    for inside in (_SEMANTIC, _CONTAINERS):
        labels = [float(not inside.isdisjoint(b.path) and _OUTSIDE.isdisjoint(b.path)) for b in blocks]
        if any(labels):
            return labels
    return None


#: What notices, adverts, footers and prompts of random pages say; their words are learnt from these and from the sample.
NOTICES = (
    "We use cookies to improve this site|Accept all cookies|Copyright, all rights reserved|Subscribe to our newsletter|Advertisement|Sponsored content by our partners|Privacy policy and terms of use|Share this page|Log in to post a comment|Related articles|Contact us|Sign up today|Leave a reply",
    "Wir verwenden Cookies, um diese Seite zu verbessern|Alle Cookies akzeptieren|Copyright, alle Rechte vorbehalten|Abonnieren Sie unseren Newsletter|Anzeige|Werbung unserer Partner|Datenschutz, Impressum und Nutzungsbedingungen|Diese Seite teilen|Melden Sie sich an, um zu kommentieren|Verwandte Artikel|Kontakt|Jetzt registrieren|Kommentar schreiben",
    "Utilizamos cookies para mejorar este sitio|Aceptar todas las cookies|Copyright, todos los derechos reservados|Suscríbase a nuestro boletín|Publicidad|Contenido patrocinado por nuestros socios|Política de privacidad y aviso legal|Compartir esta página|Inicie sesión para comentar|Artículos relacionados|Contacto|Regístrese hoy|Deje un comentario",
    "Nous utilisons des cookies pour améliorer ce site|Accepter tous les cookies|Copyright, tous droits réservés|Abonnez-vous à notre lettre d'information|Publicité|Contenu sponsorisé par nos partenaires|Politique de confidentialité et mentions légales|Partager cette page|Connectez-vous pour commenter|Articles similaires|Nous contacter|Inscrivez-vous|Laisser un commentaire",
)


#: Stands at the end of article text of random pages until their blocks are read.
MARK = "\u2061"
#: Names that tell, by what they stand on.
TELLING = {
    "top": "header masthead top banner", "notice": "cookie notice banner alert consent", "menu": "nav menu navigation breadcrumb", "ad": "ad ads advert sponsored promo", "body": "content post entry story article",
    "comments": "comments discussion responses replies", "comment": "comment reply", "side": "sidebar related widget", "foot": "footer copyright",
}


class RandomPage:
    """One page laid out at random as HTML; article text ends with MARK."""

    def __init__(self, rng: np.random.Generator, lines: list[str]):
        self.rng, self.lines = rng, lines
        self.telling, self.invented, self.semantic = rng.random() < 0.6, rng.random() < 0.35, rng.random() < 0.55
        self.names: dict[str, str] = {}
        self.odd = 0.08 if self.semantic else 0.0

    def one(self, *values):
        return values[int(self.rng.integers(len(values)))]

    def some(self, low: int, high: int) -> range:
        return range(int(self.rng.integers(low, high)))

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def words(self, n: int) -> str:
        if self.chance(self.odd):
            word = self.one(*self.lines).split(" ")[0] or "x"
            return entities.escape(self.one(" ".join([word] * n), " ".join([word] * n * 4), "x", "1 2 3", "*** $$$", f"{self.one(*self.lines)} {word} {' '.join([word] * n * 2)}"))
        if self.invented:
            return " ".join(f"v{x}" for x in self.rng.integers(0, 10**6, n)).capitalize() + self.one(".", ".", "")
        found = self.lines[int(self.rng.integers(len(self.lines)))].split() or ["x"]
        at = int(self.rng.integers(max(1, len(found) - n + 1)))
        return entities.escape(" ".join(found[at : at + n]))

    def named(self, kind: str) -> str:
        """An attribute: a telling name, a made-up one that stays the page's own for its kind, or none."""
        if self.telling:
            name = self.one(*TELLING[kind].split())
        else:
            if kind not in self.names:
                self.names[kind] = self.one("", "".join(chr(97 + int(x)) for x in self.rng.integers(0, 26, 6)))
            name = self.names[kind]
        return f' {self.one("class", "class", "id")}="{name}"' if name else ""

    def link(self, n: int) -> str:
        return f'<a href="/{int(self.rng.integers(999))}">{self.words(n)}</a>'

    def menu(self) -> str:
        items = [self.link(int(self.rng.integers(1, 4))) for _ in self.some(2, 10)]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.6) else "".join(self.one("<div>{}</div>", "<p>{}</p>").format(x) for x in items) if self.chance(0.5) else self.one(" | ", " ").join(items)
        return f"<nav>{inner}</nav>" if self.semantic and self.chance(0.8) else f"<div{self.named('menu')}>{inner}</div>"

    def notice(self) -> str:
        said = ". ".join(self.one(*self.one(*NOTICES).split("|")) for _ in self.some(1, 3)) if self.chance(0.6) else self.words(int(self.rng.integers(3, 25)))
        return f"<div{self.named('notice')}>{self.one('<p>{}</p>', '{}').format(said)}</div>"

    def advert(self) -> str:
        return f"<div{self.named('ad')}>{self.words(int(self.rng.integers(3, 25)))}</div>"

    def stamp(self) -> str:
        n = lambda low, high: int(self.rng.integers(low, high))
        return self.one(f"{n(1, 29)}.{n(1, 13)}.{n(1999, 2030)}", f"{n(1999, 2030)}-{n(10, 13)}-{n(10, 29)} {n(10, 24)}:{n(10, 60)}", f"{n(1, 29)} {self.one('May', 'mai', 'июня', 'junio')} {n(2000, 2030)}, {n(10, 24)}:{n(10, 60)}", f"{n(2, 50)} {self.one('hours ago', 'min', 'Std.', 'часов назад')}")

    def comments(self) -> str:
        """Items of like shape: a name, a time, what was said; ways to answer."""
        outer, item = self.one(("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("div", "article"), ("section", "article"))
        shape, reply = int(self.rng.integers(4)), self.chance(0.5)
        names = self.named("comment")
        out = [f"<h3>{self.one(self.words(1), 'Comments', str(int(self.rng.integers(1, 99))))}</h3>"] if self.chance(0.5) else []
        for _ in self.some(2, 9):
            who, when, said = self.words(int(self.rng.integers(1, 3))), self.stamp(), self.words(int(self.rng.integers(2, 45)))
            head = [f"<div>{who}</div><div>{when}</div>", f"<p><b>{who}</b> {when}</p>", f"<header><a href='/u'>{who}</a> <time>{when}</time></header>", f"<div><span>{who}</span></div><time>{when}</time>"][shape]
            out.append(f"<{item}{names}>{head}{self.one('<p>{}</p>', '<div>{}</div>').format(said)}{'<div>' + self.link(1) + '</div>' if reply else ''}</{item}>")
        return f"<{outer}{self.named('comments')}>{''.join(out)}</{outer}>"

    def side(self) -> str:
        inner = "".join(f"<li>{self.link(int(self.rng.integers(2, 9)))}</li>" if self.chance(0.6) else f"<li>{self.words(int(self.rng.integers(2, 9)))}</li>" for _ in self.some(1, 7))
        inner = f"<h3>{self.words(2)}</h3><ul>{inner}</ul>" if self.chance(0.7) else f"<p>{self.words(int(self.rng.integers(3, 15)))}</p>"
        return f"<aside>{inner}</aside>" if self.semantic and self.chance(0.6) else f"<div{self.named('side')}>{inner}</div>"

    def form(self) -> str:
        return f"<form><label>{self.words(2)}</label><input><p>{self.words(4)}</p></form>"

    def footer(self) -> str:
        inner = "".join(self.one("<p>{}</p>", "<div>{}</div>", "{} ").format(self.one("© ", "Copyright ", "") + self.words(int(self.rng.integers(2, 12))) if self.chance(0.6) else self.link(2)) for _ in self.some(1, 4))
        return f"<footer>{inner}</footer>" if self.semantic and self.chance(0.8) else f"<div{self.named('foot')}>{inner}</div>"

    def article(self) -> str:
        kind = self.one("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<div><p>{}</p></div>")
        text = lambda n: self.words(n) + MARK
        out = [f"<{h}>{text(int(self.rng.integers(1, 12)))}</{h}>" for h in ["h1" if self.chance(0.7) else "h2"] if self.chance(0.85)]
        if self.chance(0.25):
            out.append(f"<p>{self.words(2)} {self.stamp()}{MARK}</p>")
        for _ in self.some(1, 14):
            roll = self.rng.random()
            if roll < 0.1:
                h = self.one("h2", "h3", "blockquote", "pre", "figcaption")
                out.append(f"<{h}>{text(int(self.rng.integers(2, 20)))}</{h}>")
            elif roll < 0.17:
                out.append(f"<{'ul' if roll < 0.14 else 'ol'}>" + "".join(f"<li>{text(int(self.rng.integers(1, 9)))}</li>" for _ in self.some(1, 6)) + f"</{'ul' if roll < 0.14 else 'ol'}>")
            elif roll < 0.19:
                out.append("<table>" + "".join(f"<tr><td>{text(1)}</td><td>{text(2)}</td></tr>" for _ in self.some(1, 5)) + "</table>")
            elif roll < 0.23 and (self.telling or self.semantic):
                out.append(self.advert() if self.telling else f"<aside><p>{self.words(12)}</p></aside>")
            elif roll < 0.26:
                out.append(self.one(self.menu, self.form)())
            elif roll < 0.3:
                out.append("<section>" + f"<h2>{text(3)}</h2>" + "".join(kind.format(text(int(self.rng.integers(5, 40)))) for _ in self.some(1, 4)) + "</section>")
            else:
                n = int(self.rng.integers(1, 5 if self.chance(0.1) else 80))
                body = f"<b>{text(n)}</b>" if self.chance(0.1) else f"<b>{self.words(2)}</b> " + text(n) if self.chance(0.1) else text(max(1, n // 2)).replace(MARK, " ") + self.link(2) + " " + text(max(1, n // 2)) if self.chance(0.1) else text(n)
                out.append(kind.format(body))
        inner = "".join(out)
        if self.semantic:
            return self.one("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div role=main>{}</div>", "<div itemprop=articleBody>{}</div>").format(inner)
        return self.one("<div{0}>{1}</div>", "<div{0}>{1}</div>", "<section{0}>{1}</section>", "<div><div{0}>{1}</div></div>").format(self.named("body"), inner)

    def html(self) -> str:
        top = (f"<header><p>{self.words(4)}</p></header>" if self.semantic else f"<div{self.named('top')}><p>{self.words(4)}</p></div>") if self.chance(0.4) else ""
        before = [f() for f, share in ((self.notice, 0.3), (self.menu, 0.75), (self.advert, 0.4)) if self.chance(share)]
        after = [f() for f, share in ((self.comments, 0.45), (self.side, 0.4), (self.form, 0.2), (self.advert, 0.2), (self.menu, 0.15), (self.notice, 0.15)) if self.chance(share)]
        foot = self.footer() if self.chance(0.8) else ""
        if self.chance(0.22):
            cells = [*before[:1], self.article(), *after[:1]]
            middle = "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>" + "".join(after[1:])
        else:
            middle = "".join(before) + self.article() + "".join(after)
        wrap = self.one("{}", "{}", "<div>{}</div>", "<div id=page><div>{}</div></div>")
        return "<html><body>" + wrap.format(top + middle + foot) + "</body></html>"


def plain_html(page: RandomPage) -> str:
    """A page whose tags and classes tell nothing: article text and, anywhere in its blocks' words, notices among it."""
    says = page.one(*NOTICES).split("|")
    kind = page.one("<p>{}</p>", "<div>{}</div>", "<div><p>{}</p></div>")
    out: list[str] = []

    def notice() -> None:
        said = ". ".join(page.one(*says) for _ in page.some(1, 4))
        parts = [page.words(int(page.rng.integers(1, 40))) if page.chance(0.5) else "", said, page.words(int(page.rng.integers(1, 20))) if page.chance(0.3) else ""]
        own = kind if page.chance(0.7) else page.one("<p>{}</p>", "<div>{}</div>")
        out.append(own.format(" ".join(x for x in parts if x) + page.one(".", "")))

    for _ in page.some(0, 3):
        notice()
    for _ in page.some(1, 12):
        if page.chance(0.15):
            notice()
        out.append(kind.format(page.words(int(page.rng.integers(2, 80))) + MARK))
    for _ in page.some(0, 4):
        notice()
    return page.one("<body>{}", "<body><div>{}</div>", "<body><div><div>{}</div></div>", "<body><section>{}</section>", "<body><table><tr><td>{}</td></tr></table>").format("".join(out))


def random_page(rng: np.random.Generator, lines: list[str]) -> list[tuple[Block, float]]:
    """A page laid out at random, as blocks with labels."""
    page = RandomPage(rng, lines)
    if rng.random() < PLAIN_SHARE:
        page.odd, html = 0.0, ""
        html = plain_html(page)
    else:
        html = page.html()
    out = []
    for block in leaf_blocks(html):
        block.text, label = block.text.replace(MARK, "").strip() or "x", float(MARK in block.text)
        out.append((block, label))
    return out


def fit_labeller(sample: list[str], steps: int = STEPS) -> BlockNetwork:
    """A network fitted on random layouts and the sample's own pages."""
    rng = np.random.default_rng(5)
    read = [leaf_blocks(page) for page in sample]
    labels = [marked_labels(blocks) for blocks in read]
    own = [list(zip(blocks, ys, strict=True)) for blocks, ys in zip(read, labels, strict=True) if ys]
    lines = ([b.text for page in own for b, y in page if y] or [b.text for page in read for b in page])[:SAMPLE_LINES] or ["Some words of a line.", "Another short line of words"]
    own = [page[at : at + TRAIN_BLOCKS] for page in own for at in range(0, min(len(page), PAGE_PARTS * TRAIN_BLOCKS), TRAIN_BLOCKS)]
    network = BlockNetwork()

    def draw(_: int):
        pages = [own[int(rng.integers(len(own)))] if own and rng.random() < 0.3 else random_page(rng, lines) for _ in range(BATCH)]
        pages = [p for p in pages if p] or [[(Block(("html", "body", "article", "p"), "Text.", 0.0), 1.0)]]
        return [page_vectors([b for b, _ in p]) for p in pages], np.array([y for p in pages for _, y in p], np.float32)

    network.train(draw, steps)
    return network


def main_texts(network: BlockNetwork, pages: list[str]) -> list[str]:
    """The labelled blocks of each page, joined by line feeds. Pages of like length share a pass."""
    blocks = [leaf_blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: len(blocks[i]))
    at = 0
    while at < len(order):
        group, cells = [], 0
        while at < len(order) and (not group or (len(group) + 1) * len(blocks[order[at]]) <= 20_000):
            group.append(order[at])
            at += 1
        logits, _ = network.logits([page_vectors(blocks[i]) for i in group])
        for i in group:
            out[i] = "\n".join(b.text for b, z in zip(blocks[i], logits[cells : cells + len(blocks[i])], strict=True) if z > 0)
            cells += len(blocks[i])
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    order = (F.xxhash64("page_id"), F.col("page_id"))
    ids = [r["page_id"] for r in rows.select("page_id").filter("page_id is not null").orderBy(*order).limit(SAMPLE_PAGES).collect()]
    picked = rows.filter(F.col("page_id").isin(ids) & (F.length("html") <= SAMPLE_CHARS))  # few ids: no task sends more than their pages
    network = fit_labeller([r["html"] for r in picked.orderBy(*order, F.xxhash64("html")).select("html").limit(SAMPLE_PAGES).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = main_texts(network, [v.as_py() or "" for v in part.column(2)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
