"""Recurrences in batch and in streams, delivery with timers, latches, and what the attitude filter learns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources_and_streams import streamed
from tidewater.operators import attitude, guidance, runs
from tidewater.streaming import stateful


def walk_by_hand(rows, rule):
    """rows: (by, order, *values) -> {(by, order): output}"""
    out, state = {}, {}
    for by, at, *values in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        state[by], given = rule.step(state.get(by, rule.start), *values)
        if given is not None:
            out[by, at] = given
    return out


def held_still(rule, rates, accels, steps):
    state = rule.start
    for _ in range(steps):
        state, out = rule.step(state, *rates, *accels)
    return out


def test_constant_rate_turns_the_heading():
    """Gravity says nothing of the heading: a turn about the vertical is what the gyro says."""
    out = held_still(attitude.bias_fusion(1, 0.01), (0.0, 0.0, 0.3), (0.0, 0.0, 9.81), 500)
    assert 2 * math.atan2(out[3], out[0]) == pytest.approx(0.3 * 5, abs=1e-6)


def test_tilt_is_found_and_biases_are_learned():
    tilt = 0.4
    seen = (0.0, 9.81 * math.sin(tilt), 9.81 * math.cos(tilt))
    out = held_still(attitude.bias_fusion(2, 0.05, gain=0.5, bias_gain=4.0), (0.02, -0.03, 0.0), seen * 2, 4000)
    assert 2 * math.atan2(out[1], out[0]) == pytest.approx(tilt, abs=1e-3)
    # what turns about the vertical cannot be seen
    assert out[4] == pytest.approx(0.02, abs=1e-4) and out[5] == pytest.approx(-0.03 * math.cos(tilt) ** 2, abs=1e-4)
    # without learning, the bias leaves a tilt error behind
    still = held_still(attitude.bias_fusion(2, 0.05, gain=0.5, bias_gain=0.0), (0.02, -0.03, 0.0), seen * 2, 4000)
    assert still[4:] == (0.0, 0.0, 0.0) and abs(2 * math.atan2(still[1], still[0]) - tilt) > 5e-4


def test_a_velocity_vouches_for_the_prediction():
    tilted = (0.0, 9.81 * math.sin(0.2), 9.81 * math.cos(0.2))
    free, tied = (held_still(attitude.bias_fusion(1, 0.1, dvl=True), (0.0, 0.0, 0.0), (*tilted, *v), 1) for v in ((None, None, None), (1.0, 0.0, 0.0)))
    assert 0 < tied[1] < free[1]


def test_nulls_count_for_nothing():
    rule = attitude.bias_fusion(1, 0.1)
    assert rule.step(rule.start, None, None, None, None, 0.0, 0.0)[1] == (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert rule.step(rule.start, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)[1][0] == 1.0


@pytest.fixture(scope="module")
def trip(spark):
    rows = spark.range(150).select((F.col("id") % 3).alias("agent"), F.floor(F.col("id") / 3 + 1).alias("tick"), "id")
    return rows.select("agent", "tick", *((F.sin(F.col("id") * k) / 5).alias(f"g{k}") for k in (1, 2, 3)), F.cos("id").alias("a1"), F.lit(0.1).alias("a2"), F.lit(9.8).alias("a3"), F.when(F.col("id") % 2 == 0, F.lit(0.5)).alias("v1"), F.lit(0.1).alias("v2"), F.lit(0.0).alias("v3"))


INPUTS = ["g1", "g2", "g3", "a1", "a2", "a3", "v1", "v2", "v3"]


def test_fusion_in_batch_and_stream_equals_the_recurrence(spark, trip, tmp_path):
    rule = attitude.bias_fusion(1, 0.1, dvl=True)
    want = walk_by_hand([tuple(r) for r in trip.select("agent", "tick", *INPUTS).collect()], rule)
    batch = runs.walk(trip, "agent", ["tick"], INPUTS, rule)
    assert {(r[0], r[1]): tuple(r[2:]) for r in batch.collect()} == want
    got = streamed(spark, trip, tmp_path, lambda s: stateful.walked(s, "agent", ["tick"], INPUTS, rule))
    assert {(r[0], r[1]): tuple(r[2:]) for r in got.select(*batch.columns).collect()} == want


def test_followers_in_batch_and_stream(spark, tmp_path):
    draw = random.Random(1)
    rows = [(a, t, draw.random() * 10, draw.choice([None, *[draw.random() * 10] * 9])) for a in (1, 2, None) for t in range(1, 60)]
    df = spark.createDataFrame(rows, "agent long, tick long, x double, y double")
    rule = guidance.follower([(5.0, 5.0), (2.0, 2.0), (8.0, 8.0)], 2.0)
    want = walk_by_hand(rows, rule)
    got = runs.walk(df.repartition(4), "agent", ["tick"], ["x", "y"], rule)
    assert got.columns == ["agent", "tick", "waypoint", "distance", "error0", "error1"]
    assert {(r.agent, r.tick): tuple(r[2:]) for r in got.collect()} == want and want
    known = df.where("agent IS NOT NULL")
    out = streamed(spark, known, tmp_path, lambda s: stateful.walked(s, "agent", ["tick"], ["x", "y"], rule))
    assert {(r.agent, r.tick): tuple(r[2:]) for r in out.select(*got.columns).collect()} == {k: v for k, v in want.items() if k[0]}


def test_walk_of_nothing(spark):
    none = spark.createDataFrame([], "agent long, tick long, x double")
    assert runs.walk(none, "agent", ["tick"], ["x"], guidance.follower([(1.0,)], 1.0)).collect() == []


def deliveries(rows, last):
    """Tick by tick: a waiting message counts down, is heard for one tick, and gives way to a newer one."""
    out = []
    for to in {r[0] for r in rows}:
        waiting, full = None, False
        sent = {}
        for _, tick, wait, value in rows:
            if _ == to:
                sent[tick] = max(sent.get(tick, (float("-inf"),)), (value, wait))
        for tick in range(1, last):
            if tick in sent:
                waiting = (tick + sent[tick][1], sent[tick][0])
            heard = waiting if waiting and waiting[0] == tick else None
            if heard:
                out.append((to, tick, heard[1]))
                waiting = None
            elif full:
                out.append((to, tick, None))
            full = bool(heard)
    return sorted(out, key=repr)


MESSAGES = [(1, 1, 3, 10.0), (1, 6, 5, 11.0), (1, 8, 1, 12.0), (1, 9, 1, 13.0), (1, 9, 2, 12.5), (2, 2, 4, 20.0), (2, 6, 1, 21.0), (2, 20, 2, 22.0), (2, 21, 2, 23.0), (3, 30, 1, 1.0), (3, 31, 1, 2.0)]


def test_delivery_equals_ticks(spark):
    df = spark.createDataFrame([*MESSAGES, (None, 1, 1, 1.0), (4, 1, None, 1.0)], "to long, tick long, wait long, heard double")
    got = guidance.delivered(df, "to", "tick", F.col("wait"), "heard")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == deliveries(MESSAGES, 60)


def test_streamed_delivery_equals_batch_up_to_the_last_ticks(spark, tmp_path):
    # two late messages to someone else move the clock on
    rows = [*MESSAGES, (9, 90, 1, 0.0), (9, 120, 1, 0.0)]
    df = spark.createDataFrame(rows, "to long, tick long, wait long, heard double")
    got = streamed(spark, df, tmp_path, lambda s: stateful.delivered(s, "to", "tick", "wait", "heard"), parts=4)
    want = [r for r in deliveries(rows, 150) if r[1] < 100]
    assert sorted((tuple(r) for r in got.select("to", "tick", "heard").collect() if r.tick < 100), key=repr) == want


def test_latches_in_batch_and_stream(spark, tmp_path):
    draw = random.Random(2)
    rows = [(a, t, draw.random() < 0.3, draw.choice([True, False, False, None]), float(t)) for a in (1, 2) for t in range(1, 80)]
    df = spark.createDataFrame(rows, "agent long, tick long, read boolean, event boolean, value double")
    want = walk_by_hand(rows, guidance.latch())
    got = guidance.latched(df, "agent", ["tick"], F.col("read"), F.col("event"), F.col("value")).select("agent", "tick", "hit", "n", "last")
    assert {(r.agent, r.tick): tuple(r[2:]) for r in got.collect()} == want
    out = streamed(spark, df, tmp_path, lambda s: stateful.walked(s, "agent", ["tick"], ["read", "event", "value"], guidance.latch()))
    assert {(r.agent, r.tick): tuple(r[2:]) for r in out.select(*got.columns).collect()} == want
