"""Vector code compression (operator 11): product codes of integer vectors, learned by Lloyd's rounds on distinct parts.

Every component x becomes floor(SCALE * x) and a vector is cut into PARTS equal parts. Equal parts of a position are one row
with a weight, counted map-side first, so a vector that a third of all rows repeat is one row of each position. A round sends
the codebooks (PARTS * ENTRIES rows) to the tasks, which return weighted sums per entry; sums are added up by Spark and the
driver sees PARTS * ENTRIES of them. At the end codes and errors of distinct parts are joined back to the vectors; the distinct
side of that join has a row a key, so the vectors of a hot part can be split.

Defined cases: rows without a vector, or with a null or non-finite component, are dropped, and so are rows whose length is not
a multiple of PARTS or differs from that of the least remaining vec_id; ids of the first codebooks are ordered with nulls
last, ties by the vector; repeated rows are all returned and all weigh; with fewer than ENTRIES rows there are as many
entries; components are held to +-2**27, which keeps sums exact; null labels are one label; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, stage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LARGEST = 1 << 27
#: Differences that a task holds at once.
CELLS = 1 << 21


@dataclass
class Codebooks:
    """books[position, entry]: the integer components of an entry."""

    books: np.ndarray

    def nearest(self, position: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part; ties go to the lower entry."""
        entry, error = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        step = max(1, CELLS // max(1, self.books[0].size))
        for p in np.unique(position).tolist():
            at = np.flatnonzero(position == p)
            for k in range(0, len(at), step):
                rows = at[k : k + step]
                far = ((parts[rows, None, :] - self.books[p][None]) ** 2).sum(axis=2)
                entry[rows] = far.argmin(axis=1)
                error[rows] = far.min(axis=1)
        return entry, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and the integer components of usable rows, of any length that PARTS divides."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform("embedding", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * SCALE))).cast("long"))
    return embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable).select("vec_id", "label", ints.alias("ints"))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """position and part of rows of distinct parts, as arrays."""
    part = batch.column(1)
    return batch.column(0).to_numpy(), part.flatten().to_numpy().reshape(len(part), -1)


def _entry_sums(distinct: DataFrame, codes: Codebooks) -> np.ndarray:
    """Weighted sums of the parts nearest to each entry, and their weight at the end: [position, entry, component]."""
    positions, entries, width = codes.books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((positions * entries, width + 1), dtype=np.int64)
        for batch in batches:
            position, part = _columns(batch)
            if not len(part):
                continue
            cell = position * entries + codes.nearest(position, part)[0]
            weight = batch.column(2).to_numpy()
            order = np.argsort(cell, kind="stable")
            heads = np.flatnonzero(np.diff(cell[order], prepend=-1))
            sums[cell[order][heads]] += np.add.reduceat(np.column_stack([part * weight[:, None], weight])[order], heads)
        used = np.flatnonzero(sums[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cell", "sums"])

    rows = distinct.mapInArrow(run, "cell long, sums array<long>").select("cell", F.posexplode("sums").alias("k", "x")).groupBy("cell", "k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((positions * entries, width + 1), dtype=np.int64)
    for r in rows:
        out[r.cell, r.k] = r.x
    return out.reshape(positions, entries, width + 1)


def learned(distinct: DataFrame, start: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after rounds of weighted Lloyd over distinct parts (position, part, weight); unused entries stay."""
    codes = start
    for _ in range(rounds):
        sums = _entry_sums(distinct, codes)
        weight = sums[..., -1:]
        codes = Codebooks(np.where(weight > 0, sums[..., :-1] // np.maximum(weight, 1), codes.books))
    return codes


def compressed(embeddings: DataFrame) -> tuple[DataFrame, Codebooks] | None:
    """(vec_id, label, code, error of every usable row; the codebooks), or None where no row is usable."""
    stages = Scratch(embeddings.sparkSession)
    usable = integer_vectors(embeddings)
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    least = usable.orderBy(*order).limit(1).collect()
    if not least:
        return None
    size = len(least[0].ints)
    width = size // PARTS
    cut = F.array(*(F.slice("ints", p * width + 1, width) for p in range(PARTS)))
    # written once, so that row numbers hold
    vectors = stages(usable.filter(F.size("ints") == size).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", cut.alias("parts")), "vectors")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(ENTRIES).collect()
    start = Codebooks(np.array([[r.parts[p] for r in first] for p in range(PARTS)], dtype=np.int64))
    distinct = stages(vectors.select(F.posexplode("parts").alias("position", "part")).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "parts")
    codes = learned(distinct, start)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = codes.nearest(*_columns(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entry), pa.array(error)], names=["position", "part", "entry", "error"])

    coded = stages(distinct.mapInArrow(assign, "position int, part array<long>, entry long, error long"), "coded")
    met = vectors.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part")).join(coded, ["position", "part"])
    whole = met.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.sum("error").alias("error"), *(F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"c{p}") for p in range(PARTS)))
    code = F.concat(*(F.lpad(F.lower(F.hex(f"c{p}")), 2, "0") for p in range(PARTS)))
    out = stage(whole.select("vec_id", "label", code.alias("code"), "error"), "codes")
    stages.drop()
    return out, codes


def code_report(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors of rows with the same label) and the codebooks' checksum."""
    made = compressed(embeddings)
    if made is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows, codes = made
    labels = rows.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return rows.join(labels, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
