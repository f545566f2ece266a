"""Exact dedup by content-defined chunk recipes (operator 6).

A text becomes UTF-8 bytes; a gear rolling hash cuts them where the content says so, so equal texts are cut alike and the
chunks of long texts that share passages recur. The chunks are deduplicated by identifier and bytes, an aggregation that moves
each different chunk of a task once: an identifier that stands for one byte string is verified, and one that stands for several
gets a number for each of them. Documents are then compared by their ordered lists of verified identifiers, and no text moves
again.

Defined cases: a null text is the empty text; empty texts form one group (the empty recipe); a text of any length is cut whole;
a repeated row (same doc_id and text) counts in group_size and every such row gets the same result; the row with the largest
doc_id stays and a null doc_id ranks below all others (if a group has only null ids, all its rows stay); other columns of the
input are ignored, or kept as they are by without_copies, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, fresh, quoted, stage

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 11, 8192
ID_BYTES = 16
_GEAR = np.random.default_rng(20240501).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: bytes, min_chunk: int = MIN_CHUNK, mask_bits: int = MASK_BITS, max_chunk: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of data. The hash of a position covers the 32 bytes before it, so cuts follow content only."""
    n = len(data)
    if n <= min_chunk:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # a sum over 32 bytes by doubling
        h[shift:] += h[:-shift].copy() << np.uint32(shift)
    candidates = np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1
    ends, start, i = [], 0, 0
    while n - start > min_chunk:
        i = int(np.searchsorted(candidates, start + min_chunk))
        end = min(int(candidates[i]) if i < len(candidates) else n, start + max_chunk, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes, id_bytes: int = ID_BYTES) -> Iterator[tuple[bytes, bytes]]:
    """(identifier, bytes) of a text's chunks in order."""
    start = 0
    for end in cut_points(data):
        yield hashlib.sha256(data[start:end]).digest()[:id_bytes], data[start:end]
        start = end


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def document_recipes(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """doc_id, text_sha256, recipe: the ordered chunk identifiers of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "text_sha256": pa.string(), "recipe": pa.binary()}
        for batch in batches:
            texts = ((text.as_py() or "").encode() for text in batch.column(1))
            yield _rows([(i, hashlib.sha256(data).hexdigest(), b"".join(c for c, _ in chunks_of(data, id_bytes))) for i, data in zip(batch.column(0).to_pylist(), texts, strict=True)], kinds)

    return _plain(docs).mapInArrow(run, "doc_id long, text_sha256 string, recipe binary")


def chunk_table(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """chunk_id, chunk: every different chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"chunk_id": pa.binary(), "chunk": pa.binary()}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                texts = ((text.as_py() or "").encode() for text in batch.column(0).slice(at, 1000))
                yield _rows(sorted({c for data in texts for c in chunks_of(data, id_bytes)}), kinds)

    return _plain(docs).select("text").mapInArrow(run, "chunk_id binary, chunk binary").distinct()


def chunk_places(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """doc_id, text_sha256, place, chunk_id, chunk of every chunk of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "text_sha256": pa.string(), "place": pa.int32(), "chunk_id": pa.binary(), "chunk": pa.binary()}
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                digest = hashlib.sha256(data).hexdigest()
                yield _rows([(i, digest, k, *c) for k, c in enumerate(chunks_of(data, id_bytes))], kinds)

    return _plain(docs).mapInArrow(run, "doc_id long, text_sha256 string, place int, chunk_id binary, chunk binary")


def verified_recipes(docs: DataFrame, id_bytes: int, stages: Scratch) -> DataFrame:
    """doc_id, text_sha256, recipe, marks. marks: (place, number) of the chunks whose identifiers stand for several byte strings,
    so that recipe and marks together are equal just for equal texts."""
    recipes = stages(document_recipes(docs, id_bytes), "recipes")
    shared = stages(chunk_table(docs, id_bytes).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_id"), "contested")
    if shared.isEmpty():
        return recipes.withColumn("marks", F.lit(""))
    numbered = chunk_table(docs, id_bytes).join(shared, "chunk_id").withColumn("number", F.row_number().over(Window.partitionBy("chunk_id").orderBy("chunk")))
    marked = chunk_places(docs, id_bytes).join(numbered, ["chunk_id", "chunk"]).groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    marks = marked.agg(F.sort_array(F.collect_set(F.struct("place", "number"))).cast("string").alias("marks"))
    met = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("digest"))
    return stages(recipes.join(marks, met, "left").select("doc_id", "text_sha256", "recipe", F.coalesce("marks", F.lit("")).alias("marks")), "marked")


def dedupe_exact(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    stages = Scratch(docs.sparkSession)
    recipes = verified_recipes(docs, id_bytes, stages)
    # staged, so that both sides of the join come straight from a shuffle and a group of very many copies is split
    groups = stages(recipes.groupBy("recipe", "marks").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    out = stage(recipes.join(groups, ["recipe", "marks"]).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"), "exact")
    stages.drop()
    return out


def without_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that dedupe_exact drops; of rows that repeat doc_id and text one stays, and all rows with a null
    doc_id stay if their group has no other."""
    report = dedupe_exact(docs)
    row, digest = fresh(docs, "row", "digest")
    text_hash = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    gone = report.filter("not kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias(row), F.col("text_sha256").alias(digest)).distinct()
    keyed = docs.withColumns({row: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), digest: text_hash})
    left = keyed.join(gone, [row, digest], "left_anti")
    if not report.filter("kept and doc_id is not null").groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        nulls = left.filter("doc_id is null")
        left = left.filter("doc_id is not null").dropDuplicates([row, digest]).unionByName(nulls)
    return left.select(*map(quoted, docs.columns))
