"""Quality classifier: a generalised additive model with pairwise interactions (operator 9).

Cyclic boosting fits one shallow tree a feature and round to the residuals; the trees of a feature add up to a lookup table
over its bins. The pairs of features that reduce the loss most get tables over coarser bins, boosted the same way. A score is
a sum of table entries, read for a whole Arrow batch at once.

The model is fitted on at most SAMPLE_ROWS labelled rows outside the held-out share, those with the least hash of doc_id;
what a document is scored by comes from its text alone. Every whole text is read and scored in one pass, and nothing is staged
but the sample's ids.

Defined cases: null and empty texts have the features of the empty text and get a score; a text of any length is read whole;
labels without a document, null labels and null doc_ids don't train; a doc_id labelled twice takes its highest label; repeated
rows are scored alike; without any usable label nothing can be told apart and every score is 1; an empty table gives no rows;
other columns are ignored, or kept as they are by passing_documents, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, quoted

SAMPLE_ROWS, HELD_OUT = 20_000, 2
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 50, 0.1
MIN_LEAF = 8.0
FEATURES = ("log_bytes", "log_words", "word_size", "upper", "digits", "marks", "bangs", "stops", "beyond_ascii", "log_lines", "line_words", "repeated_lines", "distinct_words", "top_word", "distinct_pairs", "entropy", "marked_words", "short_words", "long_words", "capitals")
_GROUPS = np.zeros((256, 6))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]=_~^\\@+/", b"!?", b".,;:", bytes(range(128, 256)))):
    _GROUPS[list(_chars), _k] = 1


def text_features(text: str) -> list[float]:
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = max(1, len(data))
    upper, digits, marks, bangs, stops, beyond = (counts @ _GROUPS / n).tolist()
    share = counts[counts > 0] / n
    words = data.split()
    m = max(1, len(words))
    tally = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    k = max(1, len(lines))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return [
        math.log1p(len(data)), math.log1p(len(words)), float(sizes.sum()) / m, upper, digits, marks, bangs, stops, beyond, math.log1p(len(lines)), math.log1p(m / k),
        1 - len(set(lines)) / k if lines else 0.0, len(tally) / m, max(tally.values(), default=0) / m, len(set(zip(words, words[1:]))) / max(1, m - 1), float(-(share * np.log2(share)).sum()),
        sum(not w[-1:].isalnum() for w in tally) / max(1, len(tally)), float((sizes <= 3).mean()) if len(words) else 0.0, float((sizes >= 14).mean()) if len(words) else 0.0, sum(w.istitle() for w in tally) / max(1, len(tally)),
    ]


def feature_rows(texts: pa.Array) -> np.ndarray:
    """Features of whole texts, a row each."""
    return np.array([text_features(v.as_py() or "") for v in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = feature_rows(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, i].copy()) for i in range(len(FEATURES)))], names=["doc_id", "quality", *FEATURES])


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best split; gain 0 if there is none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    if len(left_g) == 0:
        return 0.0, 0
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    gain[(left_h < MIN_LEAF * 0.1) | (all_h - left_h < MIN_LEAF * 0.1)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Steps over the bins of one feature: at most 2**depth leaves."""
    gain, at = _best_split(g, h)
    if not depth or gain <= 1e-9:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, table) of a tree over two features' bins: one split on the first, one on the second on either side; or turned."""
    best = (0.0, np.full(g.shape, _leaf(g, h)))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, a.shape[0]):
            total, parts = 0.0, []
            for rows in (slice(0, at), slice(at, None)):
                gs, hs = a[rows].sum(axis=0), b[rows].sum(axis=0)
                gain, cut = _best_split(gs, hs)
                total += gain + gs.sum() ** 2 / (hs.sum() + 1)
                parts.append(np.tile(shallow_tree(gs, hs, 1), (a[rows].shape[0], 1)))
            total -= a.sum() ** 2 / (b.sum() + 1)
            if total > best[0]:
                table = np.concatenate(parts)
                best = (total, table.T if turned else table)
    return best


@dataclass
class AdditiveModel:
    """Tables of a fitted model. edges: a feature's inner bin borders; coarse: those of its bins in pairs."""

    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    if len(y) == 0 or y.min() == y.max():
        return AdditiveModel(40.0 if len(y) == 0 or y.min() == 1 else -40.0)
    share = float(y.mean())
    model = AdditiveModel(math.log(share / (1 - share)))
    features = x.shape[1]
    for k in range(features):
        model.edges.append(np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)))
        model.coarse.append(np.unique(np.quantile(x[:, k], np.arange(1, PAIR_BINS) / PAIR_BINS)))
        model.tables.append(np.zeros(len(model.edges[k]) + 1))
    bins = [np.searchsorted(model.edges[k], x[:, k], side="right") for k in range(features)]
    total = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(features):
            g, h = slopes()
            n = len(model.tables[k])
            step = RATE * shallow_tree(np.bincount(bins[k], g, n), np.bincount(bins[k], h, n))
            model.tables[k] += step
            total += step[bins[k]]
    rough = [np.searchsorted(model.coarse[k], x[:, k], side="right") for k in range(features)]

    def square(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell

    g, h = slopes()
    gains = sorted(((pair_tree(*square(a, b, g, h)[:2])[0], a, b) for a, b in combinations(range(features), 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            gs, hs, cell = square(a, b, *slopes())
            step = RATE * pair_tree(gs, hs)[1]
            table += step
            total += step.ravel()[cell]
    return model


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most SAMPLE_ROWS rows of docs, none held out."""
    stages = Scratch(docs.sparkSession)
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(~is_held_out()).join(known, "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = stages(ids.orderBy(*order).limit(SAMPLE_ROWS).distinct(), "sample")
    # broadcast: the sample has SAMPLE_ROWS rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    features = texts.mapInArrow(_feature_batches, "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES))
    rows = features.orderBy(*order, *FEATURES).limit(SAMPLE_ROWS).toArrow()
    stages.drop()
    x = np.column_stack([rows.column(f).to_numpy() for f in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    return x, rows.column("quality").to_numpy().astype(float)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(*training_rows(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(feature_rows(batch.column(1))))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def passing_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least threshold, with the columns of docs; no text is shuffled."""
    model, fields = fit(*training_rows(docs, labels)), docs.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passes = pa.array(model.score(feature_rows(batch.column(0))) >= threshold)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(passes)

    carried = docs.select(F.col("text").cast("string"), *(F.col(quoted(f.name)).alias(f"in_{i}") for i, f in enumerate(fields)))
    out = carried.mapInArrow(run, ", ".join(f"in_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)))
    return out.select(*(F.col(f"in_{i}").alias(f.name) for i, f in enumerate(fields)))
