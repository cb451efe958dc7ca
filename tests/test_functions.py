import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import fields, geometry, noise, profiles
from tidewater.operators import attitude, comms, control, learning, navigation, sampling, sonar


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("x", "want"), [(5.07, (2.365897, 34.238064, 24.01283)), (7.07, (2.6363587, 34.508522, 24.283293))])
def test_known_field_values(spark, x, want):
    at, cluster = (F.lit(x), F.lit(10.0), F.lit(-10.0)), [(10.0, 10.0, -10.0, 2.0, 10.0)]
    got = one(spark, fields.biomass(*at, cluster), fields.salinity(*at, cluster), fields.temperature(*at, cluster))
    assert got == pytest.approx(want, abs=1e-5)


def test_fields_above_the_surface_and_fallbacks(spark):
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    assert one(spark, fields.temperature(*up), fields.biomass(*up)) == (0.0, 0.0)
    b = one(spark, fields.bst(F.lit(float("nan")), F.lit(None).cast("double"), F.lit(7.0)).alias("b")).b
    assert tuple(b) == (0.0, 35.0, 7.0)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(x=st.floats(-50, 50), y=st.floats(-50, 50), z=st.floats(-50, 50))
def test_spherical_round_trip(spark, x, y, z):
    s = geometry.spherical(F.lit(x), F.lit(y), F.lit(z))
    back = geometry.cartesian(s["range"], s["azimuth"], s["elevation"])
    got = one(spark, back.alias("b"), geometry.atan2_approx(F.lit(y), F.lit(x)), geometry.wrapped(F.lit(x)))
    assert tuple(got[0]) == pytest.approx((x, y, z), abs=1e-6)
    if abs(x) + abs(y) > 1e-3:
        gap = got[1] - math.degrees(math.atan2(y, x))
        assert abs((gap + 180) % 360 - 180) < 0.6
    assert -math.pi <= got[2] < math.pi


def test_quaternions_and_reflection(spark):
    q = geometry.quaternion_of_rate(F.lit(0.0), F.lit(0.0), F.lit(math.pi), 1.0)
    assert one(spark, *q) == pytest.approx((0, 0, 0, 1), abs=1e-9)
    assert one(spark, *geometry.quaternion_of_rate(F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0)) == (1.0, 0.0, 0.0, 0.0)
    assert one(spark, *geometry.reflected([F.lit(1.0), F.lit(1.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)])) == (-1.0, 1.0, 0.0)
    turned = geometry.rotated(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2), F.lit(1.0), F.lit(0.0), F.lit(0.0))
    assert one(spark, *turned) == pytest.approx((0, 1, 0), abs=1e-9)


def test_noise_moments_and_determinism(spark):
    n = spark.range(20000).select(noise.normal(F.col("id"), 1).alias("g"), noise.exponential(F.col("id"), 5, 2.0).alias("e"), noise.rayleigh(F.col("id"), 9).alias("r"), *[c.alias(f"c{k}") for k, c in enumerate(noise.correlated(F.col("id"), 20, [[2.0], [1.0, 1.0]]))])
    got = n.agg(F.avg("g"), F.stddev("g"), F.avg("e"), F.avg("r"), F.corr("c0", "c1")).first()
    assert got == pytest.approx((0, 1, 2, math.sqrt(math.pi / 2), 1 / math.sqrt(2)), abs=0.05)
    a = {r.id: r.g for r in spark.range(100).withColumn("g", noise.normal(F.col("id"), 1)).collect()}
    assert a == {r.id: r.g for r in spark.range(100).repartition(7).withColumn("g", noise.normal(F.col("id"), 1)).collect()}


def test_profiles(spark):
    rows = spark.createDataFrame([([1.0, 5.0, 5.0],), ([2.0, 2.0],), ([],), (None,)], "p array<float>")
    got = rows.select(profiles.strongest_bin(F.col("p")), profiles.normalised(F.col("p")), profiles.quantised(profiles.normalised(F.col("p")))).collect()
    assert [tuple(r) for r in got] == [(1, [0.0, 1.0, 1.0], [0, 255, 255]), (0, [0.0, 0.0], [0, 0]), (None, [], []), (None, None, None)]


def test_rates():
    assert sampling.every_for(15, 30) == 2 and sampling.every_for(20, 30) == 1
    with pytest.raises(ValueError):
        sampling.every_for(60, 30)


def test_occlusion_against_a_loop(spark):
    deal = np.random.default_rng(0)
    rows = [(int(k), i, float(d)) for k in range(20) for i, d in enumerate(deal.integers(0, 60, 30))]
    want = set()
    for k in range(20):
        last = None
        for _, i, d in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if last is not None and d - last > 3:
                break
            want.add((k, i))
            last = d
    got = sonar.unoccluded(spark.createDataFrame(rows, "k int, i int, d double"), ["k"], "d", "i", 3.0).collect()
    assert {(r.k, r.i) for r in got} == want


def test_kalman_equals_the_matrix_form():
    f, b = np.array([[1, 0.5], [0, 1]]), np.array([[0.125], [0.5]])
    x, p, k = np.zeros((2, 1)), np.eye(2), navigation.Kalman(5.0)
    for a, z in [(0.1, 1.0), (-0.2, None), (0.3, 2.0), (0.0, float("nan")), (0.5, -1.0)]:
        x, p = f @ x + b * a, f @ p @ f.T + 0.25 * b @ b.T
        k.predict(a, 0.5)
        if z is not None and z == z:
            gain = p[:, :1] / (p[0, 0] + 5.0)
            x, p = x + gain * (z - x[0, 0]), p - gain @ p[:1]
        k.update(z)
        assert (k.x, k.v) == pytest.approx(tuple(x[:, 0]))


def test_pid(spark):
    rows = [(1, k, v) for k, v in enumerate((1.0, 1e9, 3.0, 2.0))] + [(2, 0, 1.0)]
    got = sorted(map(tuple, control.pid(spark.createDataFrame(rows, "run int, tick int, v double"), "run", ["tick"], "v", 2.0, 0.1, (1.0, 10.0, 1.0), 0.1).collect()))
    slope = [2 / 0.3 * 1.0]
    slope += [slope[0] / 3 + 2 / 0.3 * (3.0 - 1e9)]
    slope += [slope[1] / 3 + 2 / 0.3 * (2.0 - 3.0)]
    area = [0.05, 0.05 + 0.05 * (2 - 1e9 - 1)]
    area += [area[1] + 0.05 * (-1 + 0)]
    want = [1 + 10 * area[0] - slope[0], 0.0, -1 + 10 * area[1] - slope[1], 10 * area[2] - slope[2]]
    assert [c for *_, c in got] == pytest.approx([*want, want[0]])


def test_smooth_path():
    path = control.smooth_path(0.5, 1.0, 2.0, 0.01)
    seen = np.array([path.step(5.0) for _ in range(6000)])
    assert seen[-1] == pytest.approx([5, 0, 0], abs=1e-3) and 0.5 < seen[:, 1].max() <= 2


def test_controllers():
    task = control.DistanceReward(1.0, 2.0)
    assert [task.step(d) for d in (10.0, 7.9, 7.0, 5.8, 0.5)] == [(0, False), (1, False), (0, False), (1, False), (1, True)]
    assert control.DistanceReward(9.0, 1.0, 5.0, True).step(10.0) == (1, True)


def test_message_delay(spark):
    assert [one(spark, comms.delay_ticks(F.lit(float(d)), 30))[0] for d in (0, 10, 49, 51, 1000)] == [0, 0, 1, 1, 20]


def test_gravity_alignment(spark):
    rows = [(1, t, 0.0, 0.0, 0.0, 3.0, 0.0, 9.0) for t in range(200)]
    df = spark.createDataFrame(rows, "run int, t int, gx double, gy double, gz double, ax double, ay double, az double")
    last = attitude.fused(df, "run", "t", ["gx", "gy", "gz"], ["ax", "ay", "az"], 0.1).orderBy(F.desc("t")).first()
    assert (last.ux, last.uy, last.uz) == pytest.approx(np.array([3, 0, 9]) / math.sqrt(90), abs=1e-3)
    still = spark.createDataFrame([(1, t, 0.0, 0.0, 0.0, 0.0, 0.0, 9.81) for t in range(20)], df.schema)
    assert attitude.strapdown(still, "run", "t", ["gx", "gy", "gz"], ["ax", "ay", "az"], 0.1).orderBy(F.desc("t")).first()[2:] == pytest.approx((0, 0, 0))
    r = attitude.turn(np.array([0.3, -0.2, 0.5]), 1.0)
    body = np.eye(3)
    assert np.allclose(attitude.wahba(body, body @ r.T, np.ones(3)), r)


def test_sparse_gp_equals_dense_algebra(spark):
    deal = np.random.default_rng(1)
    x = deal.uniform(-2, 2, (300, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    z, w = learning.gp_fit(df, ["a", "b"], "y", "id", inducing=40, noise=0.01)
    k = lambda p, q: np.exp(-0.5 * ((p[:, None] - q[None]) ** 2).sum(2))
    mean = k(x, z) @ w
    assert np.abs(mean - y).mean() < 0.05
    got = df.select("id", learning.gp_predict(df, ["a", "b"], z.tolist(), w.tolist(), 1.0, 1.0).alias("m")).orderBy("id").collect()
    assert np.allclose([r.m for r in got], mean, atol=1e-6)


def test_classifier(spark):
    deal = np.random.default_rng(2)
    rows = [(f"k{c}", float(c * 3 + deal.normal()), float(deal.normal())) for c in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "label string, a double, b double")
    got = learning.classifier(df, ["a", "b"], "label", trees=10).transform(df).where("label = predicted_label").count()
    assert got > 160


def test_frames_at_the_poles_and_sizes(spark):
    from tidewater.functions import vehicle

    for roll, pitch, yaw in [(0.3, math.pi / 2, 0.0), (-0.4, -math.pi / 2, 0.0), (2.9, 0.2, -3.0), (3.1, -1.5, 1.0)]:
        m = vehicle.rotation_matrix(F.lit(roll), F.lit(pitch), F.lit(yaw))
        back = vehicle.roll_pitch_yaw(vehicle.matrix_of_quaternion(vehicle.quaternion_of_matrix(m)))
        again = vehicle.rotation_matrix(*back)
        flat = [c for r in m for c in r] + [c for r in again for c in r]
        got = one(spark, *flat)
        assert got[:9] == pytest.approx(got[9:], abs=1e-4)
    assert one(spark, *(vehicle.readable_size(F.lit(n)) for n in (0, 1, 1536, 5 * 1024**3))) == ("0B", "1.0 B", "1.5 KB", "5.0 GB")
    assert one(spark, vehicle.version_key(F.lit("1.10")) > vehicle.version_key(F.lit("1.9.3")))[0]
    assert one(spark, *vehicle.euler_rates(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))) == (1.0, 2.0, 3.0)


def test_requests_and_replies(spark):
    rows = [(1, 1, "REQ"), (1, 2, "REQ"), (1, 3, "RESP"), (1, 4, "RESP"), (1, 5, "REQU"), (1, 6, "RESP"), (2, 1, "REQ"), (2, 2, "noise")]
    got = comms.answered(spark.createDataFrame(rows, "link int, at int, kind string"), "link", "at", "kind", {"REQ": "RESP", "REQU": "RESPU"}).collect()
    assert [tuple(r) for r in got] == [(1, 1, "REQ", 3)]


def test_attitudes_equal_rotation_matrices_and_pass_over_nulls(spark):
    """Up vectors and places by quaternions against matrices made orthogonal in every row."""
    deal = np.random.default_rng(4)
    rows = [(1, t, *(float(v) for v in deal.normal(size=3)), *(float(v) for v in deal.normal(size=3) * 5)) for t in range(150)]
    df = spark.createDataFrame(rows, "run int, t int, gx double, gy double, gz double, ax double, ay double, az double")
    up = attitude.fused(df, "run", "t", ["gx", "gy", "gz"], ["ax", "ay", "az"], 0.1).orderBy("t").collect()
    at = attitude.strapdown(df, "run", "t", ["gx", "gy", "gz"], ["ax", "ay", "az"], 0.1).orderBy("t").collect()
    tilt, pose, v, p = np.eye(3), np.eye(3), np.zeros(3), np.zeros(3)
    for row, u, a in zip(rows, up, at):
        rate, acc = np.array(row[2:5]), np.array(row[5:])
        tilt = tilt @ attitude.turn(rate, 0.1)
        tilt = attitude.nearest_rotation(attitude.turn(0.1 * np.cross(tilt @ (acc / np.linalg.norm(acc)), [0, 0, 1.0]), 1.0) @ tilt)
        pose = attitude.nearest_rotation(pose @ attitude.turn(rate, 0.1))
        v = v + (pose @ acc - np.array([0, 0, 9.81])) * 0.1
        p = p + v * 0.1
        assert (u.ux, u.uy, u.uz) == pytest.approx(tilt[2], abs=1e-9) and (a.x, a.y, a.z) == pytest.approx(p, abs=1e-7)
    # a row with nulls turns by nothing and measures nothing
    holes = spark.createDataFrame([(1, 0, None, 0.0, 0.0, 1.0, None, 2.0), (1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 9.81)], df.schema)
    for f in (attitude.fused, attitude.strapdown):
        assert [r[2:] for r in f(holes, "run", "t", ["gx", "gy", "gz"], ["ax", "ay", "az"], 0.1).collect()] == [(0.0, 0.0, 1.0 if f is attitude.fused else 0.0)] * 2
