"""Language ID (operator 12): sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters and their marks becomes one space, and n-grams of ORDERS characters are hashed to
2**BITS places. A vector holds (1 + ln count) * idf, scaled to length one. Weights are learned by
follow-the-regularised-leader with elastic-net penalties (most stay exactly zero); a temperature fitted on rows that were set
aside turns scores into probabilities.

Document frequencies are counted over all whole texts that may be learned from. The weights are fitted on at most SAMPLE_ROWS of
them, an equal share for each of at most LANGUAGES languages (the most frequent ones), those with the least hash of doc_id. The
driver holds these vectors, 2**BITS frequencies and the weights of 2**BITS places by language. Prediction is one pass over whole
texts without a shuffle.

Defined cases: a null text and one without a letter give und with score 0; so does every text where nothing can be learned,
with one learned language all others give that one; a null doc_id isn't held out and isn't learned from, nor is a null lang;
of rows that repeat doc_id and lang the greatest text is learned from; ties go to the first language in order of names; a text
of any length is read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

ORDERS, BITS = (1, 2, 3), 16
SAMPLE_ROWS, LANGUAGES, SET_ASIDE = 6000, 200, 5
HELD_OUT = 1
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 0.02, 0.001
UNKNOWN = "und"
_HASHES = "pmod(xxhash64(doc_id), 1048576)"


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks, 0 for the rest."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), dtype=np.uint8, count=0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places in order, counts) of a whole text's n-grams; none for a text without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[codes]
    if not (kind == 2).any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    letters = np.full(len(codes) + 2, 32, dtype=np.uint32)
    letters[1:-1] = np.where(kind > 0, codes, 32)
    space = letters == 32
    letters = letters[~(space & np.concatenate([[False], space[:-1]]))]
    hashed, places = np.zeros(len(letters), dtype=np.uint32), []
    for order in range(1, max(ORDERS) + 1):
        if len(letters) < order:
            break
        hashed = hashed[: len(letters) - order + 1] * np.uint32(0x01000193) + letters[order - 1 :] + np.uint32(order)
        if order in ORDERS:
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x9E3779B1)
            places.append(mixed >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(places), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


@dataclass
class LanguageModel:
    """names[k] is the language of weights[:, k]; bias[k] and the temperature belong to the scores."""

    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[places]
        return v / max(1e-12, math.sqrt(float(v @ v)))

    def scores(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(places, counts) @ self.weights[places] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        places, counts = gram_counts(text)
        if not len(places) or not self.names:
            return UNKNOWN, 0.0
        p = softmax(self.scores(places, counts) / self.temperature)
        k = int(p.argmax())
        return self.names[k], float(p[k])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


class Leader:
    """Follow-the-regularised-leader for rows of sparse vectors, a column for each class; the last row is the bias."""

    def __init__(self, places: int, classes: int):
        self.z, self.n = np.zeros((places + 1, classes)), np.zeros((places + 1, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(places, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        slope = softmax(x @ w)
        slope[label] -= 1
        g = x[:, None] * slope
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss between 1/16 and 16, by golden section; 1 without rows or with one class. As rows are
    few, a right label counts as likely by the rule of succession and not as certain, which keeps scores below 1."""
    n, classes = scores.shape if len(labels) else (0, 0)
    if classes < 2:
        return 1.0
    sure = (n + 1) / (n + classes)
    target = np.full(scores.shape, (1 - sure) / (classes - 1))
    target[np.arange(n), labels] = sure

    def loss(t: float) -> float:
        s = scores / math.exp(t)
        top = s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(axis=1)) + top[:, 0] - (target * s).sum(axis=1)).mean())

    low, high, cut = -math.log(16), math.log(16), (math.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> LanguageModel:
    """A model of rows (language, places, counts). Each SET_ASIDE-th row is for the temperature, where there are enough."""
    names = sorted({r[0] for r in rows})
    number = {n: k for k, n in enumerate(names)}
    model = LanguageModel(names, idf, np.zeros((1 << BITS, len(names)), dtype=np.float32), np.zeros(len(names)))
    aside = [k for k in range(len(rows)) if k % SET_ASIDE == SET_ASIDE - 1] if len(rows) >= 10 * SET_ASIDE else []
    used = sorted(set(range(len(rows))) - set(aside))
    vectors = {k: model.vector(rows[k][1], rows[k][2]) for k in used}
    leader, random = Leader(1 << BITS, len(names)), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in random.permutation(used).tolist() if used else []:
            leader.learn(rows[k][1], vectors[k], number[rows[k][0]])
    weights = leader.weights(slice(None))
    model.weights, model.bias = weights[:-1].astype(np.float32), weights[-1]
    model.temperature = best_temperature(np.array([model.scores(rows[k][1], rows[k][2]) for k in aside]), np.array([number[rows[k][0]] for k in aside], dtype=np.int64))
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the task have each place; place -1 counts the texts."""
    seen, texts = np.zeros(1 << BITS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            places, _ = gram_counts(text.as_py())
            seen[places] += 1
            texts += len(places) > 0
    found = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(seen[found], texts))], names=["place", "texts"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [gram_counts(t.as_py()) for t in batch.column(2)]
        columns = [pa.array([r[i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "lang", "places", "counts"])


def trained(docs: DataFrame) -> LanguageModel:
    """The model of what docs may be learned from."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = plain.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    idf, texts = np.zeros(1 << BITS), 0
    for r in known.select("text").mapInArrow(_frequencies, "place long, texts long").groupBy("place").agg(F.sum("texts").alias("texts")).toArrow().to_pylist():
        if r["place"] >= 0:
            idf[r["place"]] = r["texts"]
        else:
            texts = r["texts"]
    idf = np.log((1 + texts) / (1 + idf)) + 1 if idf.any() else idf
    languages = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    if not languages or not idf.any():
        return LanguageModel([], idf, np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros(0))
    stages = Scratch(docs.sparkSession)
    share = max(1, SAMPLE_ROWS // len(languages))
    # about twice the share by hash, so that what is ranked by language is bounded; both tables broadcast are bounded as well
    quotas = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2 * share + 50) / r.rows)) for r in languages], "lang string, part double")
    ids = known.select("doc_id", "lang").join(F.broadcast(quotas), "lang").filter(f"{_HASHES} < 1048576 * part").select("doc_id", "lang").distinct()
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.expr(_HASHES), "doc_id"))).filter(F.col("rank") <= share)
    chosen = stages(ranked.select("doc_id", "lang"), "sample")
    texts_of = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.max("text").alias("text"))
    rows = texts_of.mapInArrow(_sampled, "doc_id long, lang string, places array<int>, counts array<int>").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    stages.drop()
    lists = [[np.asarray(v.values) for v in rows.column(c)] for c in ("places", "counts")]
    return fit([x for x in zip(rows.column("lang").to_pylist(), *lists, strict=True) if len(x[1])], idf)


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
