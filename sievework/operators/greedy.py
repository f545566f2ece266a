"""Order-dependent choices as rounds of joins and aggregations, or over a proven bound of rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch, stage


def kept_in_order(nodes: DataFrame, rivals: DataFrame) -> DataFrame:
    """nodes (id, dropped), rivals (x, y) -> (id, kept): x goes iff dropped or one of its y stays.

    The rivals must not form rings among nodes that aren't dropped, as is so if y always comes before x. A round settles
    every node whose rivals are settled; a hot node's rivals are combined before they are shuffled.
    """
    stages = Scratch(nodes.sparkSession)
    state = stages(nodes.select("id", F.when(F.col("dropped"), F.lit(False)).alias("kept")), "nodes")
    links = stages(rivals.select("x", "y").distinct(), "rivals")
    while not state.filter("kept is null").isEmpty():
        seen = links.join(state.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.bool_or("kept").alias("beaten"), F.count_if(F.col("kept").isNull()).alias("waiting"))
        settled = F.when(F.coalesce("beaten", F.lit(False)), False).when(F.coalesce("waiting", F.lit(0)) == 0, True)
        state = stages(state.join(seen.withColumnRenamed("x", "id"), "id", "left").select("id", F.coalesce("kept", settled).alias("kept")), "nodes")
    out = stage(state, "kept")
    stages.drop()
    return out


def _pick(items: list[tuple], pairs: list[tuple], budget: int, covered_before: set) -> tuple[list[tuple], set]:
    """items (sim, item, pair) by falling sim; pairs (sim, a, b) by falling sim."""
    chosen: list[tuple] = []
    covered: set = set()
    for _, item, pair in items:
        if len(chosen) >= budget:
            break
        if item not in covered and item not in covered_before:
            chosen.append(pair)
            covered.update(pair[1:])
    taken = set(chosen)
    for pair in pairs:
        if len(chosen) >= budget:
            break
        if pair not in taken:
            chosen.append(pair)
    return chosen, covered


def covering_pairs(pairs: DataFrame, budget: int, priority: float) -> DataFrame:
    """pairs (block, a, b, sim) -> (block, a, b, tier, nth): at most budget pairs of a block.

    Pairs of at least priority come first; in either tier every item gets its best pair before other pairs fill up. One pick
    covers two items, so that budget picks pass over at most 4 * budget covered items: the first 5 * budget items and the
    first 2 * budget pairs of a tier decide, and no more of a block is gathered.
    """
    tiers = pairs.select("block", "a", "b", "sim", F.when(F.col("sim") >= priority, 1).otherwise(2).alias("tier"))
    best = F.max(F.struct("sim", (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))
    items = tiers.select("*", F.explode(F.array("a", "b")).alias("item")).groupBy("block", "tier", "item").agg(best.alias("p"))
    items = items.select("block", "tier", "item", F.col("p.sim").alias("sim"), (-F.col("p.a")).alias("a"), (-F.col("p.b")).alias("b"))
    items = items.withColumn("nth", F.row_number().over(Window.partitionBy("block", "tier").orderBy(F.desc("sim"), "item"))).filter(F.col("nth") <= 5 * budget)
    fill = tiers.withColumn("nth", F.row_number().over(Window.partitionBy("block", "tier").orderBy(F.desc("sim"), "a", "b"))).filter(F.col("nth") <= 2 * budget)
    bounded = items.unionByName(fill.withColumn("item", F.lit(None).cast("long")))

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        out, covered, left = [], set(), budget
        for tier in (1, 2):
            part = frame[frame.tier == tier].sort_values("nth")
            by_item = [(r.sim, int(r.item), (r.sim, r.a, r.b)) for r in part[part.item.notna()].itertuples()]
            chosen, covered = _pick(by_item, [(r.sim, r.a, r.b) for r in part[part.item.isna()].itertuples()], left, covered)
            out += [(frame.block.iloc[0], a, b, tier) for _, a, b in chosen]
            left -= len(chosen)
        return pd.DataFrame([(*r, n + 1) for n, r in enumerate(out)], columns=["block", "a", "b", "tier", "nth"])

    return bounded.groupBy("block").applyInPandas(pick, "block string, a long, b long, tier int, nth int")


def ring_roots(pointers: DataFrame) -> DataFrame:
    """pointers (id, same_as: null at an end) -> (id, root, ring): the end of the chain, or the least id of its ring.

    Every round doubles the length of the jumps, so that log2(rows) rounds do. A pointer to an unknown id is an end.
    """
    known = pointers.select(F.col("id").alias("same_as"))
    state = pointers.join(known, "same_as", "left_semi").select("id", F.col("same_as").alias("jump"), F.least("id", "same_as").alias("low"))
    ends = pointers.join(state.select("id"), "id", "left_anti").select("id", F.col("id").alias("jump"), F.col("id").alias("low"))
    stages = Scratch(pointers.sparkSession)
    state = stages(state.unionByName(ends), "pointers")
    ends = stages(ends.select("id"), "ends")
    for _ in range(max(1, state.count().bit_length())):
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.col("low").alias("below"))
        state = stages(state.join(ahead, "jump").select("id", F.col("further").alias("jump"), F.least("low", "below").alias("low")), "pointers")
    landed = state.select(F.col("id").alias("jump"), F.col("low").alias("ring_low")).join(ends.select(F.col("id").alias("jump"), F.lit(True).alias("end")), "jump", "left")
    out = stage(state.join(landed, "jump").select("id", F.when(F.col("end"), F.col("jump")).otherwise(F.col("ring_low")).alias("root"), F.coalesce(~F.col("end"), F.lit(True)).alias("ring")), "rings")
    stages.drop()
    return out
