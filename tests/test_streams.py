"""Streams that are fed slot by slot, against folds over the same events."""

import datetime
import random

from pyspark.sql import functions as F

from sievework.streaming.leases import LAPSED, drained_timeline, lapse, step
from sievework.streaming.slots import split_late
from sievework.streaming.windows import frozen

START = 1_704_067_200_000


def timeline_by_fold(slots, delay_ms):
    """Every step's events in order of time; what lapses without an event does so if the last watermark has passed it."""
    events = sorted((at, i, s, e) for slot in slots for i, s, e, at in slot)
    mark, states, out = max(at for at, *_ in events) - delay_ms, {}, []
    for at, i, s, e in events:
        state, over = lapse(states.get(s), at)
        out += [(s, *over, None)] if over else []
        state, given = step(state, e, at)
        out += [(s, "granted", state[1], at, i)] if given else []
        states[s] = state
    for s, state in states.items():
        over = lapse(state, mark)[1]
        out += [(s, *over, None)] if over else []
    return sorted(out, key=str)


def test_lease_timers_across_restarts(spark):
    r, slots, at = random.Random(4), [], START
    for k in range(4):
        slot = []
        for i in range(150):
            at += r.randrange(1, 180_000)
            slot.append((1000 * k + i, f"s{r.randrange(30)}", r.choice(["claim", "claim", "failure", "success"]), at))
        at += 20 * 60_000
        slots.append(slot)
    frames = [spark.createDataFrame(s, "event_id long, step string, event string, at long").repartition(3) for s in slots]
    got = sorted((tuple(r) for r in drained_timeline(spark, frames, "10 minutes").collect()), key=str)
    want = timeline_by_fold(slots, 10 * 60_000)
    assert got == want
    assert {r[1] for r in got} == {"granted", *LAPSED.values()} and sum(r[1] == "expired" for r in got) > 20


def test_late_rows_are_kept(spark):
    day = lambda d, i: (i, datetime.datetime(2024, 1, d, 12))
    slots = [[day(1, 1), day(5, 2)], [day(2, 3), day(1, 4), day(9, 5)], [day(6, 6), day(5, 7), (8, None), day(3, 9)]]
    frames = [spark.createDataFrame(s, "id long, ts timestamp").repartition(2) for s in slots]
    got = {r.id: r.late for r in split_late(spark, frames, "ts", 3 * 86400).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True, 8: False, 9: True}


def test_states_are_frozen_in_any_number_of_files(spark):
    states = [spark.range(100).repartition(5).select("id", F.lit(k).alias("v")) for k in range(3)]
    assert [sorted(r.v for r in s.collect()) for s in frozen(spark, states)] == [[k] * 100 for k in range(3)]
