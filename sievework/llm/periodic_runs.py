"""Periodic run detection (operator 13): Main-Lorentz divide and conquer over the interned word ids of whole texts.

A run is a stretch of consecutive words with smallest period q and at least max(MIN_WORDS, MIN_TIMES * q) words that no
neighbouring word extends. Every text is halved again and again; a run that crosses a midpoint repeats its period on one side
of it, so that the Z-function of the right half, or of the left half read backwards, shows it. The repetition is extended
across the midpoint; one that leaves its segment is left to the segment above, and of equal intervals the smallest period
stays. All midpoints of a level are tested at once for a word pair that the half repeats, without which it has no run, and
Z-functions are computed for the others alone.

A text of n words costs n log n at most, whatever it repeats. Texts are handled about BATCH_BYTES at a time, so a worker holds
that many bytes or the longest single text.

Defined cases: a null text has no words, no runs and an empty collapsed text; a text of any length is read whole; repeated rows
give equal rows; a null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_TIMES = 6, 4
BATCH_BYTES = 1 << 20
_RUNS = "array<struct<start: long, length: long, period: long>>"
_WORD = "[^ \\t\\n\\u000B\\f\\r]+"


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many items from i on equal those from the start on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


class _Search:
    """Runs of texts laid end to end. ids: their words; starts: where texts start, and the end of the last."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray):
        self.ids, self.words, self.starts = ids, ids.tolist(), starts
        self.found: dict[tuple[int, int], int] = {}

    def _keep(self, a: int, b: int, q: int) -> None:
        if b - a >= max(MIN_WORDS, MIN_TIMES * q):
            self.found[(a, b)] = min(q, self.found.get((a, b), q))

    def _right(self, low: int, mid: int, high: int, first: int, last: int) -> None:
        """Runs with two periods or more right of mid; low and high bound the segment, first and last the text."""
        s, reach = self.words, mid
        z = z_function(s[mid:high])
        for q in range(1, (high - mid) // 2 + 1):
            # within what a smaller period reached, a period is that one's multiple and its run the same
            if z[q] < q or mid + 2 * q <= reach:
                continue
            a, b = mid, mid + q + z[q]
            reach = max(reach, b)
            if b == high < last and s[b] == s[b - q]:
                continue
            while a > low and s[a - 1] == s[a - 1 + q]:
                a -= 1
            if not (a == low > first and s[a - 1] == s[a - 1 + q]):
                self._keep(a, b, q)

    def _left(self, low: int, mid: int, high: int, first: int, last: int) -> None:
        """The same for two periods or more left of mid."""
        s, reach = self.words, mid
        z = z_function(s[low:mid][::-1])
        for q in range(1, (mid - low) // 2 + 1):
            if z[q] < q or mid - 2 * q >= reach:
                continue
            a, b = mid - q - z[q], mid
            reach = min(reach, a)
            if a == low > first and s[a - 1] == s[a - 1 + q]:
                continue
            while b < high and s[b] == s[b - q]:
                b += 1
            if not (b == high < last and s[b] == s[b - q]):
                self._keep(a, b, q)

    def runs(self) -> dict[tuple[int, int], int]:
        """(start, end) -> smallest period."""
        total = len(self.ids)
        if total < MIN_WORDS:
            return {}
        pairs = self.ids[:-1] * (int(self.ids.max()) + 1) + self.ids[1:]
        order = np.argsort(pairs, kind="stable")
        same = pairs[order[1:]] == pairs[order[:-1]]
        following, preceding = np.full(total + 2, total + 2), np.full(total + 2, -1)
        following[order[:-1][same]] = order[1:][same]
        preceding[order[1:][same]] = order[:-1][same]
        low, high = self.starts[:-1], self.starts[1:]
        first, last = low, high
        while True:
            wide = high - low >= MIN_WORDS
            low, high, first, last = low[wide], high[wide], first[wide], last[wide]
            if not len(low):
                return self.found
            mid = (low + high) // 2
            for test, look in ((following[mid] + 2 <= high, self._right), (preceding[mid - 2] >= low, self._left)):
                for k in np.flatnonzero(test).tolist():
                    look(int(low[k]), int(mid[k]), int(high[k]), int(first[k]), int(last[k]))
            low, high, first, last = np.concatenate([low, mid]), np.concatenate([mid, high]), np.concatenate([first, first]), np.concatenate([last, last])


def periodic_runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=int(starts[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = _Search(ids, starts).runs()
    if found:
        owners = np.searchsorted(starts, np.fromiter((a for a, _ in found), dtype=np.int64, count=len(found)), side="right") - 1
        for k, ((a, b), q) in zip(owners.tolist(), found.items(), strict=True):
            out[k].append((a - int(starts[k]), b - a, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words left when each run keeps its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_BYTES each."""
    sizes = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    begin = 0
    for i in range(len(texts)):
        if sizes[i + 1] - sizes[begin] >= BATCH_BYTES or i + 1 == len(texts):
            yield begin, i + 1
            begin = i + 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(1).cast(pa.binary())
        for begin, end in _slices(texts):
            # bytes are split at exactly the six characters that no word holds
            words = [(t or b"").split() for t in texts.slice(begin, end - begin).to_pylist()]
            found = periodic_runs_of(words)
            left = pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
            rows = [[{"start": a, "length": b, "period": q} for a, b, q in runs] for runs in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(rows, kind), left], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and the collapsed text of every row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_batches, f"doc_id long, runs {_RUNS}, collapsed string")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, by the checksum h of their ids, repeat the words from one on: with
    n words and g = h / 10, the p = 1 + (n - a) / (3 + g % 8) words from a = g % n on fill the text's rest again and again."""

    def refilled(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        words = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.when(F.size(w) > 0, F.array_join(words, " ")).otherwise("")

    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_WORD), F.lit(0))
    refill = F.get(F.transform(F.array(words), refilled), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(chosen, refill).otherwise(F.col("text").cast("string")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """periodic_runs as digests: doc_id, n_runs, the longest run (ties: least start, then period), the two checksums."""
    found = periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.q")).alias("period"), F.expr("1000 * best.length div -best.q").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
