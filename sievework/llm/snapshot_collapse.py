"""Chat formatting after collapsing cumulative snapshots (operator 7).

Logs often hold a conversation again each time it grows. A rolling hash over the turns gives a conversation one hash for each
of its prefixes; a conversation whose full hash is a proper prefix hash of another one is a snapshot of it and goes by an
anti-join. Of equal conversations the one with the least conv_id stays. What remains is rendered.

The hash rolls over (role, text) in the order of turn, so turn numbers themselves don't matter. Hashes are 128 bits wide.

Defined cases: a null role or text is the empty string; a null conv_id is one conversation of its own; turns that share a
number are ordered by role and text, null numbers first, and rows repeated as a whole count once; every conversation has at
least one turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

_HASHED = "conv_id long, n_turns long, hashes array<binary>, rendered string"


def rolling_hashes(turns: list[tuple[str, str]]) -> list[bytes]:
    """The hash of each prefix, by its number of turns."""
    out, state = [], hashlib.sha256()
    for role, text in turns:
        for part in (role.encode(), text.encode()):
            state.update(len(part).to_bytes(8, "little") + part)
        out.append(state.digest()[:16])
    return out


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            turns = [[(t["role"], t["text"]) for t in value.as_py()] for value in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, turns), pa.int64()), pa.array([rolling_hashes(t) for t in turns], pa.list_(pa.binary())), pa.array([render(t) for t in turns], pa.string())], names=["conv_id", "n_turns", "hashes", "rendered"])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered of the conversations that are no prefix of another one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    hashed = stage(gathered.mapInArrow(_hash_batches, _HASHED), "prefixes")
    # texts are met by conv_id, which is one row each, so that many equal conversations don't gather their texts in a task
    first = hashed.select("conv_id", F.element_at("hashes", -1).alias("whole")).groupBy("whole").agg(F.min("conv_id").alias("first_id"))
    proper = hashed.select(F.explode(F.expr("slice(hashes, 1, size(hashes) - 1)")).alias("whole")).distinct()
    maximal = first.join(proper, "whole", "left_anti").select("first_id")
    return hashed.join(maximal, F.col("conv_id").eqNullSafe(F.col("first_id"))).select("conv_id", "n_turns", "rendered")
