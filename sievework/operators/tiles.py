"""All pairs of sets above a similarity, counted by matrix products over tiles of the sets in the order of their sizes.

Sets that take their members from a small stock, such as the bigrams of prose, all share some of the rarest, so that posting rare
members makes nearly all pairs and shuffles them. Here no candidate leaves its task: a task counts what the sets of two groups
have in common and returns the pairs that reach the floor. The work is quadratic in the sets whose sizes allow a pair, the
shuffle is the sets times the groups that they meet, and a task holds two groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Sets of a group at least, and groups of a block at most; a block of more sets has larger groups. Below PLENTY most pairs may
#: reach the floor, and a quarter of that makes tiles that end together.
GROUP, GROUPS, PLENTY = 16384, 32, 0.6
#: Rows and columns that are counted at once, and members that have a column of the matrix; rarer ones are met in lists.
ROWS, COLUMNS, DENSE = 512, 4096, 1024
#: Pairs whose rarer members are met at once, and rows of a batch.
LISTED, BATCH = 1 << 16, 1 << 16
#: Partitions of the tiles at most.
PARTITIONS = 4096


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """rows (side, id, block, grams) with n, the number of grams, and part, the group: groups of a block are about even and follow
    each other by n; sets of one n are dealt by their ids."""
    sized = rows.filter("block is not null").withColumn("n", F.size("grams")).filter("n > 0")
    before = Window.partitionBy("side", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.groupBy("side", "block", "n").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumns({"before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "all": F.sum("rows").over(Window.partitionBy("side", "block"))})
    counts = counts.withColumn("most", F.greatest(F.lit(least), F.ceil(F.col("all") / GROUPS))).select("side", "block", "n", "rows", "before", "most")
    return sized.join(counts, ["side", "block", "n"]).withColumn("part", F.expr("cast((before + pmod(xxhash64(id), rows)) div most as int)")).drop("rows", "before", "most")


def _tiles(parts: DataFrame, sides: tuple[int, int], floor: float) -> DataFrame:
    """parts (side, block, part, low, high) -> (block, one, two): groups that may hold a pair, by their least and greatest sizes."""
    one = parts.filter(f"side = {sides[0]}").select("block", F.col("part").alias("one"), F.col("low").alias("low_1"), F.col("high").alias("high_1"))
    two = parts.filter(f"side = {sides[1]}").select("block", F.col("part").alias("two"), F.col("low").alias("low_2"), F.col("high").alias("high_2"))
    near = f"high_1 >= {floor} * low_2 and high_2 >= {floor} * low_1"
    return one.join(two, "block").filter(f"{near} and one <= two" if sides[0] == sides[1] else near).select("block", "one", "two")


class _Side:
    """The sets of one side of a tile by rising size: ids, sizes, a matrix of the frequent members and lists of the others."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, members: np.ndarray, column: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row, at = place[np.repeat(np.arange(len(sizes)), sizes)], column[members]
        self.ids, self.n = ids.take(pa.array(order)), sizes[order].astype(np.int64)
        self.dense = np.zeros((len(order), int(column.max(initial=0)) + 1), np.uint8)
        self.dense[row[at >= 0], at[at >= 0]] = 1
        kept = at < 0
        by_row = np.lexsort((members[kept], row[kept]))
        self.row, self.rare = row[kept][by_row], members[kept][by_row]
        self.n_rare = np.bincount(self.row, minlength=len(order))
        self.start = np.cumsum(self.n_rare) - self.n_rare


def _rare_common(one: _Side, two: _Side, i: np.ndarray, j: np.ndarray, stock: int) -> np.ndarray:
    """How many of the rarer members the sets i and j have in common."""
    times = one.n_rare[i]
    total = int(times.sum())
    pair = np.repeat(np.arange(len(i)), times)
    at = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(one.start[i], times)
    asked, held = j[pair] * stock + one.rare[at], two.row * stock + two.rare
    found = np.searchsorted(held, asked)
    met = (found < len(held)) & (held[np.minimum(found, max(len(held) - 1, 0))] == asked) if len(held) else np.zeros(total, bool)
    return np.bincount(pair[met], minlength=len(i))


def _met(one: _Side, two: _Side, floor: float, stock: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sim) of the pairs that reach floor, piece by piece; same: both are one group, and i < j."""
    for top in range(0, len(one.n), ROWS):
        a, n_a, r_a = one.dense[top : top + ROWS].astype(np.float32), one.n[top : top + ROWS], one.n_rare[top : top + ROWS]
        first = top if same else int(np.searchsorted(two.n, int(n_a[0] * floor), "left"))
        last = int(np.searchsorted(two.n, int(n_a[-1] / floor) + 1, "right"))
        for left in range(first, last, COLUMNS):
            right = min(left + COLUMNS, last)
            n_b, r_b = two.n[left:right], two.n_rare[left:right]
            common = a @ two.dense[left:right].astype(np.float32).T
            if r_a.any() and r_b.any():
                common += np.minimum(r_a[:, None], r_b[None, :])
            share = floor / (1 + floor)
            i, j = np.nonzero(common >= (n_a * (share - 1e-6) - 0.01).astype(np.float32)[:, None] + (n_b * (share - 1e-6)).astype(np.float32)[None, :])
            for k in range(0, len(i), LISTED):
                x, y = i[k : k + LISTED], j[k : k + LISTED]
                both = common[x, y].astype(np.int64)
                x, y = x + top, y + left
                listed = np.minimum(one.n_rare[x], two.n_rare[y])
                open_ = np.flatnonzero(listed)
                if len(open_):
                    both[open_] += _rare_common(one, two, x[open_], y[open_], stock) - listed[open_]
                sim = both / (one.n[x] + two.n[y] - both)
                kept = sim >= floor
                if same:
                    kept &= x < y
                yield x[kept], y[kept], sim[kept]


def _compared(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Batches of one tile (tile, first, same, id, grams) -> (x, y, sim)."""
    table = pa.Table.from_batches([b for b in batches if len(b)])
    grams = table["grams"].combine_chunks()
    sizes, ids = np.diff(grams.offsets.to_numpy()).astype(np.int64), table["id"].combine_chunks()
    stock, members, held = np.unique(grams.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    column = np.full(len(stock), -1, np.int64)
    frequent = np.argsort(-held, kind="stable")[:DENSE]
    frequent = frequent[held[frequent] * 1000 >= len(ids)] if len(stock) > DENSE // 4 else frequent
    column[frequent] = np.arange(len(frequent))
    first, same, ends = table["first"].to_numpy(), table["same"][0].as_py(), np.concatenate([[0], np.cumsum(sizes)])
    row_of = np.repeat(first, sizes)
    side = lambda mask, of: _Side(ids.filter(pa.array(mask)), sizes[mask], members[of], column)
    one = side(first, row_of)
    two = one if same else side(~first, ~row_of)
    if ends[-1] and len(one.n) and len(two.n):
        for i, j, sim in _met(one, two, floor, len(stock), same):
            for k in range(0, len(i), BATCH):
                yield pa.RecordBatch.from_arrays([one.ids.take(pa.array(i[k : k + BATCH])), two.ids.take(pa.array(j[k : k + BATCH])), pa.array(sim[k : k + BATCH])], names=["x", "y", "sim"])


def tiled_pairs(rows: DataFrame, sides: tuple[int, int], floor: float, stages: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """rows (side, id, block, grams: distinct whole numbers) -> (x, y, sim): x of the first side and y of the second in one block,
    sim their Jaccard similarity, at least floor. Where both are one side, a pair comes once, in either order. floor is above 0.

    rows are read several times, so they should be staged; stages keeps the list of tiles, which the result reads."""
    grouped = _grouped(rows, GROUP if floor >= PLENTY else max(1, GROUP // 4))
    parts = grouped.groupBy("side", "block", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    tiles = stages(_tiles(parts, sides, floor), "tiles")
    same = F.lit(sides[0] == sides[1]) & (F.col("one") == F.col("two"))
    end = lambda side, part: grouped.filter(f"side = {side}").select("block", F.col("part").alias(part), "id", "grams")
    met = tiles.join(end(sides[0], "one"), ["block", "one"]).select("block", "one", "two", F.lit(True).alias("first"), same.alias("same"), "id", "grams")
    met = met.union(tiles.filter(~same).join(end(sides[1], "two"), ["block", "two"]).select("block", "one", "two", F.lit(False), F.lit(False), "id", "grams"))
    # dealt by number, as a few small tiles are much work and must not be put together
    dealt = met.repartition(max(1, min(PARTITIONS, 4 * tiles.count())), "block", "one", "two")
    kind = rows.schema["id"].dataType

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compared(batches, floor)

    return dealt.groupBy("block", "one", "two").applyInArrow(compared, StructType([StructField("x", kind), StructField("y", kind), StructField("sim", DoubleType())]))
