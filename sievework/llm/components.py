"""Connected components over an edge table, in rounds of staged DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, stage

#: Rounds grow with the logarithm of a component's size; a graph that needs more is an error, not a result.
MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any ordered type -> (node, comp), comp being the least node reachable. Alternates large-star and
    small-star steps: each is one aggregation and one join, so a node of very many links is never gathered in a task.
    Null ends and loops are ignored; nodes without edges don't appear.
    """
    stages = Scratch(edges.sparkSession)
    now = edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = stages(now, "cc"), None
    for _ in range(MAX_ROUNDS):
        was, seen = seen, _state(now)
        if was == seen:
            out = stage(now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select("v", "v").distinct()), "components")
            stages.drop()
            return out
        # the aggregated sides are staged, so that AQE can split a node of very many links
        both = now.union(now.select("v", "u"))
        low = stages(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = stages(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "cc-large")
        least = stages(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = stages(small, "cc")
    raise RuntimeError(f"components haven't settled after {MAX_ROUNDS} rounds")
