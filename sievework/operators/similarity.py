"""Similarity joins on character bigrams, and first-seen-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigrams, normalized
from ..sources.shared import Scratch, stage
from .tiles import tiled_pairs


def coded(text: Column) -> Column:
    """A normalised text's bigrams as numbers in order, one for each, which move and compare faster than strings."""
    return F.array_sort(F.transform(bigrams(text), lambda g: F.ascii(g).cast("long") * (1 << 21) + F.ascii(F.substr(g, F.lit(2)))))


def _similar(rows: DataFrame, sides: tuple[int, int], floor: float, stages: Scratch) -> DataFrame:
    """rows (side, id, block, grams) -> (a, b, sim) of a block's pairs that reach floor; of one side, a is the lesser id."""
    met = tiled_pairs(rows, sides, floor, stages)
    if sides[0] == sides[1]:
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim").filter("a < b")
    return met.toDF("a", "b", "sim")


def candidates(rows: DataFrame, sides: tuple[int, int], floor: float, more: str) -> DataFrame:
    """rows (side, id, block, grams) -> (a, b): pairs of a block that reach floor, each once."""
    return _similar(rows, sides, floor, Scratch(rows.sparkSession)).filter(more).select("a", "b")


def similar_pairs(rows: DataFrame, floor: float, staged: bool = True) -> DataFrame:
    """rows (id, block, title) -> (a, b, sim) with a < b in one block and sim at least floor.

    Titles that are equal once normalised are one class: they are joined to its least id. At a low floor most pairs of a block
    may reach it; not staged, they go to the reader from the tasks that find them, and only tables in proportion to rows are kept.
    """
    titled = rows.select("id", "block", normalized(F.col("title")).alias("norm")).filter("norm != ''")
    stages = Scratch(rows.sparkSession)
    classes = stages(titled.groupBy("block", "norm").agg(F.min("id").alias("a")), "classes")
    grams = stages(classes.select(F.lit(0).alias("side"), F.col("a").alias("id"), "block", coded(F.col("norm")).alias("grams")), "grams")
    near = _similar(grams, (0, 0), floor, stages)
    least = classes.select(F.col("block").alias("block_a"), F.col("norm").alias("norm_a"), "a")
    same = titled.join(least, F.col("block").eqNullSafe(F.col("block_a")) & (F.col("norm") == F.col("norm_a"))).filter("a < id").select("a", F.col("id").alias("b")).distinct().withColumn("sim", F.lit(1.0))
    if not staged:
        return near.unionByName(same)
    out = stage(near.unionByName(same), "pairs")
    stages.drop()
    return out


def similar_between(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """left, right (id, block, title) -> (a, b, sim) of a row of either side, in one block, with sim at least floor."""
    grams = lambda rows, side: rows.select(F.lit(side).alias("side"), "id", "block", normalized(F.col("title")).alias("norm")).filter("norm != ''").select("side", "id", "block", coded(F.col("norm")).alias("grams"))
    stages = Scratch(left.sparkSession)
    ours, theirs = stages(grams(left, 0), "ours"), stages(grams(right, 1), "theirs")
    out = stage(_similar(ours.union(theirs), (0, 1), floor, stages), "pairs")
    stages.drop()
    return out


def first_seen(rows: DataFrame, keys: list[str], rivals: DataFrame | None = None) -> DataFrame:
    """rows (id, keys...) -> (id, kept): in the order of id, a row goes iff it has a key of an earlier kept row, or one of its
    rivals (x, y: a row and an earlier one) is kept.

    Only kept rows own their keys. Each round keeps the rows that are first on all their keys and have no open rival, and drops
    those that share a key with one kept before or have a kept rival; all are aggregations and semi joins, so that a key held by
    very many rows is never gathered. Empty and null keys match nothing.
    """
    stages = Scratch(rows.sparkSession)
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys))
    posted = lambda df: df.select("id", F.explode(pairs).alias("p")).select("id", "p.*").filter("key is not null and key != ''")
    open_rows, decided = stages(rows.select("id", *keys), "open"), rows.select("id", F.lit(True).alias("kept")).limit(0)
    links = None if rivals is None else stages(rivals.select("x", "y").distinct(), "rivals")
    while True:
        posts = posted(open_rows)
        first = stages(posts.groupBy("kind", "key").agg(F.min("id").alias("first")), "first")
        blocked = posts.join(first, ["kind", "key"]).filter("id > first").select("id")
        if links is not None:
            blocked = blocked.union(links.select(F.col("x").alias("id")))
        kept = stages(open_rows.join(blocked.distinct(), "id", "left_anti"), "kept")
        if kept.isEmpty():
            break
        gone = posts.join(posted(kept).drop("id").distinct(), ["kind", "key"], "left_semi").select("id")
        if links is not None:
            gone = gone.union(links.join(kept.select(F.col("id").alias("y")), "y", "left_semi").select("x"))
        gone = gone.join(kept.select("id"), "id", "left_anti").distinct()
        now = stages(kept.select("id", F.lit(True).alias("kept")).union(gone.select("id", F.lit(False))), "decided")
        decided = decided.union(now)
        open_rows = stages(open_rows.join(now.select("id"), "id", "left_anti"), "open")
        if links is not None:
            links = stages(links.join(now.select(F.col("id").alias("x")), "x", "left_anti").join(now.select(F.col("id").alias("y")), "y", "left_anti"), "rivals")
    out = stage(decided, "first-seen")
    stages.drop()
    return out


def components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> (id, root): the least id that can be reached. Labels spread by aggregation until none changes."""
    stages = Scratch(pairs.sparkSession)
    edges = stages(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "edges")
    labels = stages(edges.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.id).groupBy("a").agg(F.min("root").alias("low")).withColumnRenamed("a", "id")
        lower = labels.join(near, "id").select("id", F.least("root", "low").alias("root"))
        jump = lower.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = stages(lower.join(jump, "root", "left").select("id", F.least("root", "further").alias("root")), "labels")
        if new.join(labels.withColumnRenamed("root", "was"), "id").filter("root != was").isEmpty():
            out = stage(new, "components")
            stages.drop()
            return out
        labels = new
