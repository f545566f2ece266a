"""Pairs of sets by tiles against all pairs: many groups, rare members, one side and two."""

import random

import pyarrow as pa
import pytest

from sievework.operators import tiles
from sievework.sources.shared import Scratch


def sets(n, seed, stock=60):
    """Sets from a small stock and a few members that hardly another one has; some sets are near copies of the one before."""
    r, out = random.Random(seed), []
    for _ in range(n):
        if out and r.random() < 0.3:
            s = set(out[-1])
            s.discard(r.choice(sorted(s)))
            s.add(r.randrange(stock))
        else:
            s = {r.randrange(stock) for _ in range(r.randrange(1, 45))} | {r.randrange(10_000, 60_000) for _ in range(r.randrange(3))}
        out.append(s)
    return out


def alike(s, t):
    return len(s & t) / len(s | t)


@pytest.mark.parametrize("floor", [0.28, 0.6, 0.85, 1.0])
def test_many_groups_equal_all_pairs(spark, monkeypatch, floor):
    monkeypatch.setattr(tiles, "GROUP", 16)
    left, right = sets(150, 1), sets(70, 2)
    rows = [(0, k, "xy"[k % 5 == 0], sorted(s)) for k, s in enumerate(left)] + [(1, k, "xy"[k % 3 == 0], sorted(s)) for k, s in enumerate(right)] + [(0, 900, None, [1, 2]), (0, 901, None, [1, 2]), (0, 902, "x", [])]
    frame, stages = spark.createDataFrame(rows, "side int, id long, block string, grams array<long>"), Scratch(spark)
    got = sorted((*sorted((r.x, r.y)), r.sim) for r in tiles.tiled_pairs(frame, (0, 0), floor, stages).collect())
    assert got == sorted((a, b, alike(s, t)) for b, t in enumerate(left) for a, s in enumerate(left[:b]) if (a % 5 == 0) == (b % 5 == 0) and alike(s, t) >= floor)
    got = sorted(tuple(r) for r in tiles.tiled_pairs(frame, (0, 1), floor, stages).collect())
    assert got == sorted((a, b, alike(s, t)) for a, s in enumerate(left) for b, t in enumerate(right) if (a % 5 == 0) == (b % 3 == 0) and alike(s, t) >= floor)
    stages.drop()


@pytest.mark.parametrize("dense", [0, 5, 40])
def test_rare_members_count(monkeypatch, dense):
    monkeypatch.setattr(tiles, "DENSE", dense)
    monkeypatch.setattr(tiles, "ROWS", 7)
    monkeypatch.setattr(tiles, "COLUMNS", 11)
    monkeypatch.setattr(tiles, "LISTED", 13)
    found = sets(90, 3)
    for first, same in (([True] * 90, True), ([k % 3 == 0 for k in range(90)], False)):
        batch = pa.record_batch({"first": first, "same": [same] * 90, "id": list(range(90)), "grams": pa.array([sorted(s) for s in found], pa.list_(pa.int64()))})
        got = sorted((*sorted((x, y)), sim) for out in tiles._compared(iter([batch.slice(0, 50), batch.slice(50)]), 0.5) for x, y, sim in zip(*(c.to_pylist() for c in out.columns), strict=True))
        assert got == sorted((a, b, alike(s, t)) for b, t in enumerate(found) for a, s in enumerate(found[:b]) if (same or first[a] != first[b]) and alike(s, t) >= 0.5)


def test_no_candidate_is_shuffled(spark):
    """The pairs come out of the tiles' tasks; before, keys of pairs of grams were joined and made distinct."""
    frame = spark.createDataFrame([(0, k, "x", [k, k + 1]) for k in range(9)], "side int, id long, block string, grams array<long>")
    plan = tiles.tiled_pairs(frame, (0, 0), 0.3, Scratch(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Join") and "Aggregate" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_low_floor_is_not_staged(spark):
    """Most pairs of a block may reach a low floor; they go from their tasks to the reader, not to a table first."""
    from sievework.operators.similarity import similar_pairs

    frame = spark.createDataFrame([(k, "x", f"title {k % 7} of many") for k in range(20)], "id long, block string, title string")
    kept, passed = similar_pairs(frame, 0.28), similar_pairs(frame, 0.28, staged=False)
    assert "FlatMapGroupsInArrow" in passed._jdf.queryExecution().optimizedPlan().toString() and sorted(kept.collect()) == sorted(passed.collect())
