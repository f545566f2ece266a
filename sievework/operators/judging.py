"""A judge of pairs or groups behind an interface: blocks of a bounded size, answers in prose, failures that merge nothing.

A judge is a function from a block of items to a text, a call to a model or a rule. What it says counts only as far as the JSON
in it can be read; a block that raises or can't be read leaves its items apart and says why.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a question, and the similarity below which a pair isn't merged whatever the judge says.
BLOCK, FLOOR = 60, 0.28
Judge = Callable[[list[dict]], str]


def _answer(text: str | None) -> dict | None:
    """The object from the first { to the last } of a text."""
    start, end = (text or "").find("{"), (text or "").rfind("}")
    if start < 0 or end <= start:
        return None
    try:
        found = json.loads(text[start : end + 1])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _numbers(values: list, total: int) -> list[int]:
    return sorted({int(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer() and 0 <= v < total})


def same_pairs(text: str | None, total: int) -> list[int] | None:
    """{"same": [..]}: distinct numbers in range and in order, or None for what is no such answer."""
    found = _answer(text)
    return _numbers(found["same"], total) if found and isinstance(found.get("same"), list) else None


def event_groups(text: str | None, total: int) -> list[list[int]] | None:
    """{"groups": [[..], ..]}: groups of two or more distinct numbers in range, or None."""
    found = _answer(text)
    if not found or not isinstance(found.get("groups"), list):
        return None
    return [g for g in (_numbers(x, total) for x in found["groups"] if isinstance(x, list)) if len(g) > 1]


def _blocks(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """rows with part: about block rows of one scope share it, and a scope of any size has as many parts as it needs."""
    sizes = rows.groupBy(F.col("scope").alias("sized")).agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    return rows.join(sizes, F.col("scope").eqNullSafe(F.col("sized"))).withColumn("part", F.expr(f"pmod(xxhash64({', '.join(keys)}), parts)")).drop("sized", "parts")


def judged_pairs(pairs: DataFrame, judge: Judge, veto: Column | None = None, block: int = BLOCK, floor: float = FLOOR) -> DataFrame:
    """pairs (scope, a, b, sim, title_a, title_b) -> a, b, sim, verdict, error.

    verdict: veto where veto holds, and the judge isn't asked; same or different as it says; below_floor for what it takes for
    the same at too small a similarity; failed where its block has no readable answer."""
    marked = pairs.withColumn("vetoed", F.coalesce(F.lit(False) if veto is None else veto, F.lit(False)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = frame.sort_values(["sim", "a", "b"], ascending=[False, True, True]).to_dict("records")
        for k in range(0, len(rows), block):
            asked = rows[k : k + block]
            error, said = None, None
            try:
                said = same_pairs(judge([{"n": n, "scope": r["scope"], "a": r["title_a"], "b": r["title_b"], "sim": r["sim"]} for n, r in enumerate(asked)]), len(asked))
                error = "no readable answer" if said is None else None
            except Exception as failure:  # a judge may fail in any way; its block alone is lost
                error = f"{type(failure).__name__}: {failure}"
            for n, r in enumerate(asked):
                verdict = "failed" if said is None else "different" if n not in set(said) else "same" if r["sim"] >= floor else "below_floor"
                out.append((r["a"], r["b"], r["sim"], verdict, error))
        return pd.DataFrame(out, columns=["a", "b", "sim", "verdict", "error"])

    told = _blocks(marked.filter("not vetoed").drop("vetoed"), ["a", "b"], block).groupBy("scope", "part").applyInPandas(run, "a long, b long, sim double, verdict string, error string")
    return told.union(marked.filter("vetoed").select("a", "b", "sim", F.lit("veto"), F.lit(None).cast("string")))


def judged_groups(items: DataFrame, judge: Judge, block: int = BLOCK) -> DataFrame:
    """items (scope, id, title) -> a, b: each member of a group that the judge sees in a block, with the group's least one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = frame.sort_values("id").to_dict("records")
        for k in range(0, len(rows), block):
            asked = rows[k : k + block]
            try:
                groups = event_groups(judge([{"n": n, "scope": r["scope"], "title": r["title"]} for n, r in enumerate(asked)]), len(asked))
            except Exception:
                groups = None
            out += [(asked[g[0]]["id"], asked[n]["id"]) for g in groups or [] for n in g[1:]]
        return pd.DataFrame(out, columns=["a", "b"])

    return _blocks(items, ["id"], block).groupBy("scope", "part").applyInPandas(run, "a long, b long")


def opposite(a: Column, b: Column, up: list[str], down: list[str]) -> Column:
    """Whether two titles tell opposite directions; one that tells both tells none."""
    has = lambda t, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(t, F.lit(""))), w))
    way = lambda t: F.when(has(t, up) & ~has(t, down), 1).when(has(t, down) & ~has(t, up), -1).otherwise(0)
    return way(a) * way(b) == -1


def cluster_report(pairs: DataFrame, roots: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (a, b), roots (id, root), labels (id, event) -> root, size, edges, density, real, false, unknown.

    density: edges among all pairs of the cluster; an edge is a real merge if both ends have one event, a false one if they
    have two, and unknown if an end has none."""
    told = pairs.join(labels.select(F.col("id").alias("a"), F.col("event").alias("event_a")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("event").alias("event_b")), "b", "left").join(roots.select(F.col("id").alias("a"), "root"), "a")
    same = F.col("event_a") == F.col("event_b")
    edges = told.groupBy("root").agg(F.count(F.lit(1)).alias("edges"), F.count_if(same).alias("real"), F.count_if(~same).alias("false"), F.count_if(same.isNull()).alias("unknown"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(edges, "root").select("root", "size", "edges", (F.col("edges") * 2 / (F.col("size") * (F.col("size") - 1))).alias("density"), "real", "false", "unknown")
