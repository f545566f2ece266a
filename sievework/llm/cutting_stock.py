"""Packing as a cutting-stock problem solved by column generation (operator 2).

Every document is tokenised once and cut into whole sequences and one remainder, whose pieces carry their checksums. The
pieces are the items: a histogram of their lengths (in units of UNIT tokens, so at most CAPACITY / UNIT bins whatever the
input) is the demand of a linear program over patterns, that is, over multisets of lengths that fit one sequence. A knapsack
dynamic program prices new patterns until none improves; the patterns' multiplicities are rounded down and the few items
left (bounded by bins, not by documents) are packed best-fit decreasing. Documents of a length are then ranked in parallel
and each rank's place in the patterns is looked up.

Only the histogram, the patterns and their offsets pass through the driver; all are bounded by the number of bins.

Defined cases: a null text is the empty text (a document of one token, the end id); every row is packed, so that repeated
rows are packed again and a null doc_id is kept; ties in length are ranked by doc_id, start and checksum; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Recent, stage

CAPACITY, END_ID, UNIT = 4096, 2, 16
MAX_ROUNDS = 6000
RANKS_PER_TASK = 200_000
#: Entries of a worker's memos, each held twice at most: about 250 bytes an entry, so 250 MB.
MEMO_PARTS, MEMO_WORDS = 300_000, 200_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = _PIECES + ", sequence_id long, slot long"
_PLAIN_PART = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]*")
#: The byte-level alphabet's rule: bytes without a visible character stand as the code points from 256 on.
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordTokens:
    """Token ids of whole texts from a word-wise vocabulary; a worker keeps a bounded memo of words.

    The vocabulary's words never hold white space, so the ids of a text are those of the parts between spaces and line
    feeds. A part of Latin letters, digits and signs, which normalisation only lower-cases, is cut on by the vocabulary's own
    word pattern and its words go straight to the library's model, other letters as the characters that stand for their
    bytes; any other part goes through the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.words = Recent(self._word, MEMO_WORDS)
        self.parts = Recent(self._part, MEMO_PARTS)

    def library(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _part(self, part: str) -> bytes:
        if "<|" in part or not _PLAIN_PART.fullmatch(part):
            return self.library(part)
        return b"".join(map(self.words.__getitem__, _WORD.findall(part.lower())))

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text and text.isascii():
            text = text.lower()
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end, width = word_tokens(tokenizer_path), END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                raw = tool.ids(value.as_py() or "") + end
                for at in range(0, len(raw), width):
                    piece = raw[at : at + width]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(raw) // 4)
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of sizes that fit room with the greatest value."""
    best = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    for space in range(1, room + 1):
        n = int(np.searchsorted(sizes, space, side="right"))
        best[space] = best[space - 1]
        if n:
            gains = value[:n] + best[space - sizes[:n]]
            k = int(gains.argmax())
            if gains[k] > best[space] + 1e-12:
                best[space], taken[space] = gains[k], k
    counts, space = np.zeros(len(sizes), dtype=np.int64), room
    while space > 0:
        if (k := taken[space]) < 0:
            space -= 1
        else:
            counts[k] += 1
            space -= int(sizes[k])
    return float(best[room]), counts


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan elimination with row pivots, elementwise: threaded routines were seen to hang beside a session."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        rows = np.flatnonzero(factors)
        work[rows] -= factors[rows, None] * work[k]
    return work[:, n:]


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, max_rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Column generation for the least number of sequences: (patterns as columns, their fractional multiplicities).

    A revised simplex over one row for each bin. It ends when no pattern is worth more than a sequence, or when Farley's bound
    shows that no more than half a sequence can be saved; stopped early (max_rounds) it still covers the demand. A pattern has
    few sizes, so products are summed over these; threaded matrix products would wait for cores that other tasks hold.
    """
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    x, bound = (inverse * demand).sum(axis=1), 0.0
    for rounds in range(max_rounds):
        price = inverse.sum(axis=0)
        value, counts = best_pattern(price, sizes, room)
        bound = max(bound, float((price * demand).sum()) / max(value, 1.0))
        if value <= 1 + 1e-7 or x.sum() - bound < 0.5:
            break
        used = np.flatnonzero(counts)
        direction = (inverse[:, used] * counts[used]).sum(axis=1)
        usable = direction > 1e-9
        ratio = np.where(usable, x / np.where(usable, direction, 1), np.inf)
        out = int(ratio.argmin())
        x -= ratio[out] * direction
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        patterns[:, out] = counts
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if rounds % 300 == 299:  # rounding errors don't pile up
            inverse = inverted(patterns)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
    assert patterns.shape == (m, m)
    return patterns.astype(np.int64), x


def plan_sequences(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole patterns (rows) and how often each is used; together they hold the demand exactly or with empty slots."""
    if not len(sizes):
        return np.zeros((0, 0), dtype=np.int64), np.zeros(0, dtype=np.int64)
    patterns, x = solve_patterns(sizes, demand.astype(float), room)
    times = np.floor(x + 1e-6).astype(np.int64)
    rows, uses = [patterns[:, p] for p in np.flatnonzero(times)], [int(t) for t in times[times > 0]]
    left = np.maximum(demand - (patterns * times).sum(axis=1), 0)
    while left.any():  # at most one fractional pattern for each bin is left: best fit decreasing, equal sequences at once
        space, one = room, np.zeros(len(sizes), dtype=np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            if left[k] and sizes[k] <= space:
                one[k] = min(left[k], space // sizes[k])
                space -= int(one[k] * sizes[k])
        again = int((left[one > 0] // one[one > 0]).min())
        rows.append(one)
        uses.append(again)
        left = left - again * one
    return np.array(rows), np.array(uses, dtype=np.int64)


def layout(sizes: np.ndarray, rows: np.ndarray, uses: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """For each bin size: (first rank, items in the pattern, first sequence, first slot) of every pattern that holds it."""
    first_sequence = np.concatenate([[0], np.cumsum(uses)[:-1]]).astype(np.int64) if len(uses) else uses
    slots = np.cumsum(rows, axis=1) - rows if len(rows) else rows
    found = {}
    for k, size in enumerate(sizes):
        used = np.flatnonzero(rows[:, k])
        held = rows[used, k] * uses[used]
        found[int(size)] = (np.cumsum(held) - held, rows[used, k], first_sequence[used], slots[used, k])
    return found


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of docs."""
    pieces = stage(tokenized_pieces(docs, tokenizer_path, capacity), "pieces").withColumn("size", F.expr(f"cast(ceil(length / {unit}) as int)"))
    histogram = pieces.groupBy("size").count().collect()  # at most capacity / unit rows
    histogram.sort(key=lambda r: r["size"])
    sizes = np.array([r["size"] for r in histogram], dtype=np.int64)
    demand = np.array([r["count"] for r in histogram], dtype=np.int64)
    places = layout(sizes, *plan_sequences(sizes, demand, capacity // unit))

    # ranks within a bin: each of many shares is ranked by itself and then moved past the shares before it
    shares = max(32, int(demand.sum() // RANKS_PER_TASK))
    shared = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shares)).cast("int"))
    by_share = Window.partitionBy("size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    before = shared.groupBy("size", "share").count().withColumn("before", F.coalesce(F.sum("count").over(by_share), F.lit(0))).drop("count")
    within = Window.partitionBy("size", "share").orderBy("doc_id", "start", "ids_crc32")
    ranked = shared.withColumn("rank", F.row_number().over(within) - 1).join(before, ["size", "share"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (5, 6))
            sequence, slot = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for one in np.unique(size):
                rows = size == one
                first, items, start, at = places[int(one)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                nth = rank[rows] - first[k]
                sequence[rows] = start[k] + nth // items[k]
                slot[rows] = at[k] + nth % items[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("rank") + F.col("before")).cast("long").alias("rank")).mapInArrow(place, _PLACED)
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("long")).drop("slot")
