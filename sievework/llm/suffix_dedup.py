"""Removal of repeated passages with suffix arrays sorted in two stages (operator 8).

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus. Sorting every suffix of a
corpus in one place doesn't scale, so the work is dealt out first and then sorted exactly:

1. Every window of LENGTH bytes names an anchor, the least-hashed gram of GRAM bytes in it (the leftmost, if several). Equal
   windows name equal grams at the same place. The windows of a text fall into runs with one anchor; a run's segment is the
   bytes its windows cover, and each window start belongs to exactly one segment. Segments that a text holds twice or more
   repeat by that alone: they are noted where the text is read, and one of them stands for all.
2. Segments are grouped by their anchor's hash. A gram that occurs once covers no repeated window. Equal segments of a group
   repeat as a whole and are represented by one of them.
3. The different segments of a group are joined to a block, and the block's suffixes are sorted in two stages: those that are
   smaller than their successor directly, by ranks of the strings between them, doubled until LENGTH bytes are ordered; the
   others are induced by one scan over the buckets. Neighbours in the order with a common prefix of LENGTH bytes repeat.
4. A group with more than GROUP_SEGMENTS different segments is too wide for a block and is split: a run's windows are dealt to
   2, 4, 8 ... intervals of the anchor's place in the window, and the bytes that all windows of an interval have in common
   are the new key. Equal windows keep equal keys. What is still wide is split further; at the last level a key stands for
   a window's every byte.

Texts are bytes, matches never cross documents, strings are judged on the input. Defined cases: a null text is the empty text;
texts below LENGTH bytes keep everything; a row that repeats both doc_id and text is a further place, so all its windows
repeat; null doc_ids are kept and told apart by their text; other columns are ignored, or kept as they are by without_repeats,
whatever their names; an empty table gives no rows; a text of any length is read whole, PIECE bytes at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fresh, quoted, stage

LENGTH, GRAM = 400, 160
GROUP_SEGMENTS, BLOCK_BYTES, TASK_BYTES = 1500, 400_000, 2 << 20
PIECE = 1 << 22
SEPARATOR = 0xFF  # no byte of UTF-8
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: One row for each different segment of a text; copies: how often the text holds it. Rows without a key are runs of windows
#: that are known to repeat.
_RUNS = "id long, text_hash long, lo int, n int, key long, segment binary, copies int"
_SPANS = "id long, text_hash long, first int, last int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 2**64)
        _POWERS[size] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))]) for b in (_BASE, inverse))
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of width values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[: len(values)] = values
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(first window start, number of windows, hash of their anchor gram, its place) for the runs of windows with one anchor."""
    out = []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        part = np.frombuffer(data, dtype=np.uint8, offset=begin, count=min(len(data) - begin, PIECE + length - 1))
        up, down = _powers(len(part))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[part] * up)])
        n = len(part) - gram + 1
        h = (total[gram:] - total[:-gram]) * down[:n]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        least = _least((h & ~np.uint64(PIECE * 2 - 1)) | np.arange(n, dtype=np.uint64), length - gram + 1)
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        counts = np.diff(np.append(starts, len(least)))
        at = (least[starts] & np.uint64(PIECE * 2 - 1)).astype(np.int64)
        out += zip((starts + begin).tolist(), counts.tolist(), h[at].view(np.int64).tolist(), (at + begin).tolist(), strict=True)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, last) that touch or overlap, joined."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def text_runs(data: bytes, length: int, gram: int) -> list[tuple]:
    """(lo, n, key, segment, copies) as in _RUNS."""
    places: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for lo, n, key, _ in anchor_runs(data, length, gram):
        places.setdefault((key, xxhash.xxh3_128_digest(data[lo : lo + n + length - 1])), []).append((lo, n))
    again = _merged([(lo, lo + n - 1) for found in places.values() if len(found) > 1 for lo, n in found])
    return [(first, last - first + 1, None, None, 0) for first, last in again] + [(*found[0], key, segment, len(found)) for (key, segment), found in places.items()]


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


_RUN_KINDS = {"id": pa.int64(), "text_hash": pa.int64(), "lo": pa.int32(), "n": pa.int32(), "key": pa.int64(), "segment": pa.binary(), "copies": pa.int32()}


def _run_batches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [(i, *r) for i, value in enumerate(part.column(2)) for r in text_runs((value.as_py() or "").encode(), length, gram)]
                found = _table(rows, {"row": pa.int64(), **dict(list(_RUN_KINDS.items())[2:])})
                yield pa.RecordBatch.from_arrays([part.column(0).take(found.column(0)), part.column(1).take(found.column(0)), *found.columns[1:]], names=list(_RUN_KINDS))

    return run


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of the key tuples (the last key counts most), equal tuples alike."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def two_stage_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes of text in the order of their first depth bytes. text: bytes, the last one a SEPARATOR."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    following = np.searchsorted(differs, np.arange(n))  # the next place where a byte and its successor differ
    known = following < len(differs)
    at = differs[np.minimum(following, len(differs) - 1)] if len(differs) else np.zeros(n, dtype=np.int64)
    smaller = known & (text[at] < text[np.minimum(at + 1, n - 1)])  # than its successor

    # stage one: sort the suffixes that are smaller than their successors
    place = np.flatnonzero(smaller)
    m = len(place)
    ordered = np.zeros(0, dtype=np.int64)
    if m:
        # the string from each such place up to the next; past its end stands 0xFF, as a longer string ranks lower
        width = np.minimum(np.append(place[1:], n - 1) - place + 1, depth)
        padded = np.concatenate([text, np.full(depth + 16, SEPARATOR, dtype=np.uint8)])
        rank = None
        for offset in range(0, int(width.max()), 8):
            word = np.zeros(m, dtype=np.uint64)
            for k in range(offset, offset + 8):
                word = (word << np.uint64(8)) | np.where(k < width, padded[np.minimum(place + k, n + depth)], SEPARATOR).astype(np.uint64)
            rank = _dense(word) if rank is None else _dense(word, rank)
        step = 1
        while True:
            far = np.append(place, np.full(step, n + depth))[step:]
            if (far - place >= depth).all() or int(rank.max()) == m - 1:
                break
            after = np.append(rank, np.full(step, -1))[step:]
            rank = _dense(rank * (m + 1) + after + 1)
            step *= 2
        ordered = place[np.argsort(rank, kind="stable")]

    # stage two: buckets by first byte, in order; each suffix puts its larger predecessor at the end of its bucket's front
    firsts = text[ordered]
    bounds = np.searchsorted(firsts, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1], dtype=np.int64))  # its successor is the empty suffix
    out = []
    for c in range(256):
        front, wave = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        waiting[c] = []
        while len(wave):
            front.append(wave)
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == c) & ~smaller[wave]]
        bucket = np.concatenate([*front, ordered[bounds[c] : bounds[c + 1]]])
        if len(bucket):
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[~smaller[before] & (text[before] > c)]
            heads = text[before]
            by_head = np.argsort(heads, kind="stable")
            before, heads = before[by_head], heads[by_head]
            edges = np.flatnonzero(np.append(True, heads[1:] != heads[:-1])) if len(heads) else []
            for i, group in zip(edges, np.split(before, edges[1:]) if len(edges) else [], strict=True):
                waiting[heads[i]].append(group)
    return np.concatenate(out)


def repeated_starts(text: np.ndarray, valid: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Which of the valid places start depth bytes that start at another valid place too: adjacent common prefixes."""
    order = two_stage_order(text, depth)
    order = order[valid[order]]
    one, two = order[:-1], order[1:]
    padded = np.concatenate([text, np.full(depth + 8, SEPARATOR, dtype=np.uint8)])
    for k in (depth - 1, depth // 2, 0):  # neighbours that differ leave the comparison at once
        alike = padded[one + k] == padded[two + k]
        one, two = one[alike], two[alike]
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for k in range(0, depth - 7, 8):
        alike = (words[one + k] == words[two + k]).all(axis=1)
        one, two = one[alike], two[alike]
    for k in range(depth - depth % 8, depth):
        alike = padded[one + k] == padded[two + k]
        one, two = one[alike], two[alike]
    out = np.zeros(len(text), dtype=bool)
    out[one] = out[two] = True
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Flagged window starts as runs (first, last)."""
    if not flags.any():
        return []
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


_SPAN_KINDS = {"id": pa.int64(), "text_hash": pa.int64(), "first": pa.int32(), "last": pa.int32()}


def _block_rows(block: list[tuple], length: int) -> pa.RecordBatch:
    """block: (id, text_hash, lo, alone, data) of segments -> the repeated windows of those that stand alone."""
    text = np.frombuffer(b"\xff".join(data for *_, data in block) + b"\xff", dtype=np.uint8)
    valid, at, begins = np.zeros(len(text), dtype=bool), 0, []
    for *_, data in block:
        begins.append(at)
        valid[at : at + len(data) - length + 1] = True
        at += len(data) + 1
    again = repeated_starts(text, valid, length)
    rows = [(i, h, lo + first, lo + last) for begin, (i, h, lo, alone, data) in zip(begins, block, strict=True) if alone for first, last in _spans(again[begin : begin + len(data) - length + 1])]
    return _table(rows, _SPAN_KINDS)


def _sorted_blocks(length: int):
    """Input in the order of key: whole groups are joined to blocks of about BLOCK_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, None
        for batch in batches:
            for key, i, h, lo, alone, data in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if block and size >= BLOCK_BYTES and key != last:
                    yield _block_rows(block, length)
                    block, size = [], 0
                block.append((i, h, lo, alone, data.as_py()))
                size, last = size + len(block[-1][4]), key
        if block:
            yield _block_rows(block, length)

    return run


#: A segment with its bytes; anchor: the place of its anchor gram, found for wide groups only.
_SEGMENT_KINDS = {"key": pa.int64(), "id": pa.int64(), "text_hash": pa.int64(), "lo": pa.int32(), "n": pa.int32(), "copies": pa.int32(), "wide": pa.bool_(), "anchor": pa.int32(), "data": pa.binary()}
_SEGMENTS = "key long, id long, text_hash long, lo int, n int, copies int, wide boolean, anchor int, data binary"


def _segment_bytes(length: int, gram: int):
    """(id, text_hash, text, wanted: array of key, lo, n, copies, wide) -> rows as in _SEGMENTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, rows = batch.slice(at, 200), []
                for i, h, text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                    data = (text.as_py() or "").encode()
                    anchors = {r[0]: r[3] for r in anchor_runs(data, length, gram)} if any(w["wide"] for w in wanted) else {}
                    rows += [(w["key"], i, h, w["lo"], w["n"], w["copies"], w["wide"], anchors.get(w["lo"]), data[w["lo"] : w["lo"] + w["n"] + length - 1]) for w in wanted]
                yield _table(rows, _SEGMENT_KINDS)

    return run


def split_segment(data: bytes, lo: int, n: int, anchor: int, level: int, length: int, gram: int) -> list[tuple]:
    """A segment's windows dealt to 2**level intervals of the anchor's place in the window: (key, lo, n, bytes) of each."""
    rest, parts, out = length - gram, 1 << level, []
    for i in range(parts):
        low, high = -(-i * (rest + 1) // parts), -(-(i + 1) * (rest + 1) // parts) - 1  # bytes before the anchor
        first, last = max(lo, anchor - high), min(lo + n - 1, anchor - low)
        if first <= last:
            shared = data[anchor - low - lo : anchor + gram + rest - high - lo]
            out.append((xxhash.xxh3_64_intdigest(shared, seed=level << 16 | i) - 2**63, first, last - first + 1, data[first - lo : last + length - lo]))
    return out


_SPLIT_KINDS = _RUN_KINDS | {"anchor": pa.int32(), "data": pa.binary()}


def _split_batches(level: int, length: int, gram: int):
    """Segments of wide groups -> rows as in _RUNS with anchor and data; copies is 2 for windows that are known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for i, h, lo, n, copies, anchor, data in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    rows += [(i, h, first, m, key, xxhash.xxh3_128_digest(part), min(copies, 2), anchor, part) for key, first, m, part in split_segment(data, lo, n, anchor, level, length, gram)]
                yield _table(rows, _SPLIT_KINDS)

    return run


def _plain(docs: DataFrame) -> DataFrame:
    """id and text_hash tell rows apart; doc_id is the id as it came."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def repeated_spans(plain: DataFrame, length: int = LENGTH, gram: int = GRAM, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """(id, text_hash, spans: array of (first window start, last window start)) of the texts with repeated windows."""
    stages = Scratch(plain.sparkSession)
    read = stages(plain.select("id", "text_hash", "text").mapInArrow(_run_batches(length, gram), _RUNS), "runs")
    found = read.filter("key is null").selectExpr("id", "text_hash", "lo as first", "lo + n - 1 as last")
    runs, more = read.filter("key is not null"), []
    levels = [*range(1, (length - gram).bit_length(), 2), (length - gram).bit_length()]
    while True:
        # the aggregated sides are staged, so that both sides of each join come straight from a shuffle and a hot key is split
        met = stages(runs.groupBy("key").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("key"), "keys")
        runs = stages(runs.join(met, "key"), "met")
        segments = runs.groupBy("key", "segment").agg(F.sum("copies").cast("int").alias("copies"), F.min(F.struct("id", "text_hash", "lo", "n", *more)).alias("at"))
        segments = stages(segments.select("key", "segment", "copies", "at.*"), "segments")
        again = segments.filter("copies > 1").select("key", "segment")
        found = found.union(runs.filter("copies = 1").select("id", "text_hash", "lo", "n", "key", "segment").join(again, ["key", "segment"], "left_semi").selectExpr("id", "text_hash", "lo as first", "lo + n - 1 as last"))
        groups = segments.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.min("copies").alias("least"), F.sum(F.col("n") + length - 1).alias("n_bytes")).filter("different > 1 and least = 1")
        groups = stages(groups.select("key", "n_bytes", (F.col("different") > (group_segments if levels else 2**62)).alias("wide")), "groups")
        wanted = segments.join(groups.drop("n_bytes"), "key")
        if not more:  # the texts move once
            wanted = wanted.groupBy("id", "text_hash").agg(F.collect_list(F.struct("key", "lo", "n", "copies", "wide")).alias("wanted"))
            wanted = plain.select("id", "text_hash", "text").join(wanted, ["id", "text_hash"]).mapInArrow(_segment_bytes(length, gram), _SEGMENTS)
        wanted, more = stages(wanted.select("key", "id", "text_hash", "lo", "n", "copies", "wide", "anchor", "data"), "wanted"), ["anchor", "data"]
        narrow, n_wide = groups.agg(F.sum(F.expr("if(wide, 0, n_bytes)")), F.count_if("wide")).first()
        tasks = max(plain.sparkSession.sparkContext.defaultParallelism, (narrow or 0) // TASK_BYTES)
        blocks = wanted.filter("not wide").select("key", "id", "text_hash", "lo", (F.col("copies") == 1).alias("alone"), "data").repartition(tasks, "key").sortWithinPartitions("key", "id", "lo")
        found = found.union(blocks.mapInArrow(_sorted_blocks(length), _SPANS))
        if not n_wide:
            break
        split = wanted.filter("wide").select("id", "text_hash", "lo", "n", "copies", "anchor", "data").mapInArrow(_split_batches(levels.pop(0), length, gram), f"{_RUNS}, anchor int, data binary")
        runs = stages(split, "split")
    spans = stage(found.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    stages.drop()
    return spans


def removed_ranges(spans: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed byte ranges [a, b) of runs of window starts."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"] + length) for s in spans or []):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def kept_bytes(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in ranges:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def whole_characters(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges shrunk so that no character is cut: a partly covered character stays."""
    out = []
    for a, b in ranges:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, kept, left = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                value = text.as_py() or ""
                data, ranges = value.encode(), removed_ranges(spans.as_py(), length)
                size.append(len(data))
                gone.append(sum(b - a for a, b in ranges))
                runs.append(len(ranges))
                kept.append(hashlib.sha256(kept_bytes(data, ranges)).hexdigest())
                left.append(kept_bytes(data, whole_characters(data, ranges)).decode() if ranges else value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.string()), pa.array(left, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return run


def _kept_texts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column(0), batch.column(1), strict=True):
                ranges, value = removed_ranges(spans.as_py(), length), text.as_py()
                if ranges:
                    data = value.encode()
                    value = kept_bytes(data, whole_characters(data, ranges)).decode()
                kept.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(kept, pa.string())], names=[*batch.schema.names[2:], "kept"])

    return run


def removal_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs, and text: what is left of it, in whole
    characters (a character that is removed in part stays)."""
    plain = _plain(docs)
    joined = plain.join(repeated_spans(plain, length, gram), ["id", "text_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_digests(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated passages taken out of text (whole characters only); n_chars follows if there is one."""
    fields = docs.schema.fields
    row, text_hash, spans = fresh(docs, "row", "text_hash", "spans")
    found = repeated_spans(_plain(docs), length, gram).toDF(row, text_hash, spans)
    keyed = docs.withColumns({row: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), text_hash: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    joined = keyed.join(found, [row, text_hash], "left").select(F.col("text").cast("string"), spans, *(F.col(quoted(f.name)).alias(f"in_{i}") for i, f in enumerate(fields)))
    out = joined.mapInArrow(_kept_texts(length), ", ".join(f"in_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", kept string")
    columns = {"text": F.col("kept"), "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept"))}
    return out.select(*(columns.get(f.name, F.col(f"in_{i}")).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))
