"""Edges of the smaller operators: nulls, ties, names that no one has, walls, angles and batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import noise, vehicle
from tidewater.operators import attitude, comms, control, learning, rewards
from tidewater.sources import readers, sinks


def facing(spark, half, walls=(), **at):
    p = {"ax": 0.0, "ay": 0.0, "bx": 10.0, "by": 0.0, "fx": 1.0, "fy": 0.0, "gx": -1.0, "gy": 0.0} | at
    c = {k: F.lit(v) for k, v in p.items()}
    zero = F.lit(0.0)
    return spark.range(1).select(comms.between_beams([c["ax"], c["ay"], zero], [c["bx"], c["by"], zero], [c["fx"], c["fy"], zero], [c["gx"], c["gy"], zero], half, list(walls)).alias("s")).first().s


def test_beams_need_both_axes_and_a_free_way(spark):
    assert facing(spark, 60.0)
    assert not facing(spark, 60.0, gx=1.0)
    assert not facing(spark, 60.0, fx=0.0, fy=1.0)
    assert facing(spark, 60.0, by=10.0) and not facing(spark, 40.0, by=10.0)
    assert not facing(spark, 60.0, walls=[([4.0, -1.0, -1.0], [5.0, 1.0, 1.0])]) and facing(spark, 60.0, walls=[([4.0, 1.0, -1.0], [5.0, 2.0, 1.0])])
    assert not facing(spark, 60.0, bx=0.0) and not facing(spark, 60.0, fx=0.0)


def test_fan_out_leaves_out_senders_and_strangers(spark):
    m = spark.createDataFrame([(1, 1, 10, -1), (2, 1, 10, 11), (3, 1, 10, 10), (4, 1, 10, 99), (5, 2, 20, -1), (6, None, 10, -1), (7, 1, 12, None)], "message int, net int, sender int, goal int")
    s = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 12), (2, 20), (1, None)], "net int, id int")
    assert sorted((r.message, r.receiver) for r in comms.sent_to(m, s, "net", "sender", "goal", "id").collect()) == [(1, 11), (1, 12), (2, 11)]


def test_requests_at_one_time_come_by_tie(spark):
    rows = [("a", 1, 2, "REQ2"), ("a", 1, 1, "REQ"), ("a", 2, 3, "RESP")]
    got = comms.answered(spark.createDataFrame(rows, "link string, at int, id int, kind string"), "link", "at", "kind", {"REQ": "RESP", "REQ2": "RESP2"}, tie="id").collect()
    assert [(r.request, r.answered_at) for r in got] == [("REQ", 2)]


def test_direct_pid_by_hand(spark):
    rows = [("a", t, angle, 0.5) for t, angle in enumerate([0.0, 350.0, 10.0, 2e7, 20.0])]
    df = spark.createDataFrame(rows, "run string, t int, angle double, rate double")
    p, i, d, dt = 2.0, 0.5, 0.25, 0.1
    for turn in (None, 360.0):
        got = [r.command for r in control.pid_direct(df, "run", ["t"], "angle", "rate", 0.0, dt, (p, i, d), turn).orderBy("t").collect()]
        area = last = 0.0
        for r, command in zip(rows, got):
            gap = -r[2]
            if turn:
                gap = gap - turn if gap >= turn / 2 else gap + turn if gap <= -turn / 2 else gap
            before = gap if abs(gap) > control.FAULT else last
            area += dt / 2 * (gap + before)
            last = gap
            assert command == pytest.approx(p * gap + i * area - d * 0.5)


def test_allocation_gives_the_forces_back(spark):
    for surge, yaw in [(100.0, 5.0), (-40.0, 3.0), (0.0, 0.0), (1.0, -20.0)]:
        left, right = spark.range(1).select(*control.allocated(F.lit(surge), F.lit(yaw), 0.4, 0.02, 0.01)).first()
        thrust = [(0.02 if n > 0 else 0.01) * n * abs(n) for n in (left, right)]
        assert sum(thrust) == pytest.approx(surge, abs=1e-9) and 0.4 * (thrust[0] - thrust[1]) == pytest.approx(yaw, abs=1e-9)


def test_noise_factors_and_settings(spark):
    assert noise.factor_of(2.0, 2) == [[2.0, 0.0], [0.0, 2.0]] and noise.factor_of([1.0, 3.0], 2) == [[1.0, 0.0], [0.0, 3.0]]
    low = np.array(noise.factor_of([[4.0, 2.0], [2.0, 5.0]], 2))
    assert np.allclose(low @ low.T, [[4, 2], [2, 5]])
    m = lambda *ks: F.create_map(*(F.lit(v) for k in ks for v in (k, "1"))) if ks else F.lit(None).cast("map<string,string>")
    rule = lambda c: noise.exclusive(c, [("S", "C"), ("A", "B")])
    assert tuple(spark.range(1).select(rule(m("S")), rule(m("A", "B", "S")), rule(m("C", "S", "A", "B")), rule(m())).first()) == (None, "A, B", "S, C", None)


def test_bytes_are_decoded_at_any_depth(spark):
    df = spark.createDataFrame([({"a": [bytearray("é".encode()), None]}, bytearray(b"x"), 7), (None, None, None)], "m map<string,array<binary>>, b binary, n int")
    got = df.select(*(vehicle.decoded(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in df.schema)).collect()
    assert got[0].m == {"a": ["é", None]} and (got[0].b, got[0].n) == ("x", 7) and tuple(got[1]) == (None, None, None)


def test_attitude_from_vectors_with_noise_and_one_group_on_a_line(spark):
    deal = np.random.default_rng(3)
    true = attitude.turn(np.array([0.3, -0.5, 1.1]), 1.0)
    body = deal.normal(size=(400, 3))
    world = body @ true.T + 0.01 * deal.normal(size=(400, 3))
    rows = [("a", *map(float, b), *map(float, w)) for b, w in zip(body, world)] + [("line", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, b0 double, b1 double, b2 double, w0 double, w1 double, w2 double")
    got = {r.g: np.array(r.m).reshape(3, 3) for r in attitude.aligned(df, "g", ["b0", "b1", "b2"], ["w0", "w1", "w2"], F.lit(1.0)).collect()}
    assert np.abs(got["a"] - true).max() < 0.01
    assert np.allclose(got["line"] @ [1, 0, 0], [0, 1, 0]) and np.linalg.det(got["line"]) == pytest.approx(1.0)


def test_batches_and_splits_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(k % 7, None if k % 5 == 0 else "x" if k % 2 else "y") for k in range(103)], "id int, label string")
    sizes = [r["count"] for r in learning.batched(df, "id", 20).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [20] * 5 + [3]
    got = learning.stratified(df, "id", "label", 0.8).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("train").cast("int")).alias("t")).collect()
    assert all(r.t == math.floor(r.n * 0.8) for r in got) and len(got) == 3
    assert learning.stratified(df.limit(0), "id", "label", 0.8).collect() == []


def test_cup_game_by_hand(spark):
    rows = [(1, t, *r) for t, r in enumerate([(False, True, False), (None, True, None), (True, True, False), (False, True, True), (True, False, True), (False, False, False)])]
    df = spark.createDataFrame(rows, "run int, t int, ball boolean, hit boolean, wrong boolean")
    got = rewards.cup_game(df, "run", ["t"], F.col("ball"), F.col("hit"), F.col("wrong")).orderBy("t").collect()
    assert [(r.reward, r.terminal) for r in got] == [(1, False), (0, False), (2, True), (-1, True), (-1, True), (0, True)]


def test_missing_materials_are_written_back_once(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("sand", 2000.0, 1700.0)], "material string, density double, sound_speed double").write.csv(path, header=True)
    rows = spark.createDataFrame([("sand",), ("mud",), ("mud",), (None,)], "name string")
    for _ in range(2):
        sinks.add_missing_materials(rows, path, "name", 1e5, 1e3)
        assert sorted((r.material, r.impedance) for r in readers.materials(spark, path).collect()) == [("mud", 1e8), ("sand", 3.4e6)]


def tasks_with_rows(df):
    # few rows are many tasks' work only while Spark does not put small partitions together
    df.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return df.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_messages_of_one_net_are_many_tasks_work(spark):
    m = spark.range(400).coalesce(1).select(F.col("id").cast("int").alias("message"), F.lit(1).alias("net"), F.lit(5).alias("sender"), F.lit(-1).alias("goal"))
    s = spark.range(7).coalesce(1).select(F.lit(1).alias("net"), F.col("id").cast("int").alias("id"))
    got = comms.sent_to(m, s, "net", "sender", "goal", "id")
    assert sorted((r.message, r.receiver) for r in got.collect()) == [(k, j) for k in range(400) for j in range(7) if j != 5]
    assert got.columns == ["message", "net", "sender", "goal", "receiver"] and tasks_with_rows(got) == 4


def test_modems_of_one_crowded_cell_are_many_tasks_work(spark):
    a = spark.range(200).coalesce(1).select("id", F.lit(1).alias("net"), (F.col("id") % 9 * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"))
    b = a.select(F.col("id").alias("oid"), F.col("net").alias("onet"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    got = comms.in_reach(a, b, "net", "onet", [("x", "ox"), ("y", "oy")], 5.0)
    near = {(i, j) for i in range(200) for j in range(200) if math.hypot(i % 9 - j % 9, i % 7 - j % 7) <= 5}
    rows = [(r.id, r.oid) for r in got.collect()]
    assert len(rows) == len(near) and set(rows) == near
    assert got.columns == ["id", "net", "x", "y", "oid", "onet", "ox", "oy", "distance"] and tasks_with_rows(got) == 4
