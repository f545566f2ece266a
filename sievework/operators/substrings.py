"""Longest common substrings by suffix automata, a pair of texts at a time in Arrow batches, linear in both texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SuffixAutomaton:
    """All substrings of a text. next: a state's ways by character, link: the state of its longest other suffix class."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            now = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def longest_in(self, text: str) -> tuple[int, int]:
        """(length, start in text) of the longest substring that both have; the first one of equals."""
        state = size = 0
        best = (0, 0)
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            if size > best[0]:
                best = (size, i + 1 - size)
        return best


def longest_common(a: str, b: str) -> tuple[int, int]:
    """(length, start in b): the automaton is made of the shorter text."""
    if len(a) <= len(b):
        return SuffixAutomaton(a).longest_in(b)
    size, at = SuffixAutomaton(b).longest_in(a)
    return size, b.find(a[at : at + size])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [longest_common(a or "", b or "") for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array([at for _, at in found], pa.int64())], names=["key", "b", "n", "at"])


def common_substrings(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, n_common and common of each row: the longest substring that the texts a and b share. Null texts share nothing."""
    kind = pairs.schema[key].dataType.simpleString()
    found = pairs.select(F.col(key).alias("key"), F.col(a), F.col(b)).mapInArrow(_batches, f"key {kind}, b string, n long, at long")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_common"), F.expr("substr(coalesce(b, ''), cast(at + 1 as int), cast(n as int))").alias("common"))


def quotable(text: Column) -> Column:
    """Letters and digits alone, in which a quotation's spaces and signs make no difference."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")


def quoted_spans(reasons: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """reasons (reason_id, text), sources (source_id, text) -> reason_id, source_id, n_common, common: what of a reason is quoted
    from which sources, from least letters and digits on. Texts meet by their strings of that length alone."""
    ours, theirs = reasons.select("reason_id", quotable(F.col("text")).alias("a")), sources.select("source_id", quotable(F.col("text")).alias("b"))
    grams = lambda rows, key, text: rows.filter(F.length(text) >= least).select(key, F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length({text}) - {least - 1}), i -> xxhash64(substr({text}, i, {least})))"))).alias("gram"))
    met = grams(ours, "reason_id", "a").join(grams(theirs, "source_id", "b"), "gram").select("reason_id", "source_id").distinct()
    pairs = met.join(ours, "reason_id").join(theirs, "source_id").select(F.struct("reason_id", "source_id").alias("pair"), "a", "b")
    kind = pairs.schema["pair"].dataType.simpleString()
    found = pairs.select("pair", "a", "b").mapInArrow(_batches, f"key {kind}, b string, n long, at long").filter(f"n >= {least}")
    return found.select("key.*", F.col("n").alias("n_common"), F.expr("substr(b, cast(at + 1 as int), cast(n as int))").alias("common"))
