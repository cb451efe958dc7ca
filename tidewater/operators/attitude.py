"""Attitude estimation run by run: gyro integration with a gravity correction, and strapdown dead reckoning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.runs import Recurrence, walk


def turn(omega: np.ndarray, dt: float) -> np.ndarray:
    """Rotation matrix of an angular rate held over dt."""
    angle = float(np.linalg.norm(omega)) * dt
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = omega / np.linalg.norm(omega)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v


def wahba(body: np.ndarray, world: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rotation that best takes body vectors to world vectors (Wahba's problem, by SVD)."""
    return nearest_rotation((world * weights[:, None]).T @ body)


def fused(df: DataFrame, by: str, order: str, gyro: list[str], accel: list[str], dt: float, gain: float = 0.1) -> DataFrame:
    """World-frame up vector of each row: gyro prediction, pulled towards measured gravity.

    Parallel gravity references leave the heading open, so only the tilt is given back.  The attitude is a quaternion of plain
    numbers.  Null rates count as 0, an acceleration with a null for nothing.
    """

    def on(q: tuple, *row: float):
        q = turned(q, row[:3], dt)
        a = row[3:]
        size = 0.0 if None in a else math.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
        if size > 1e-9:
            up = rotated(q, a)
            # the small turn that brings what is measured towards straight up
            x, y = gain * up[1] / size, -gain * up[0] / size
            c, s = half_turn(math.sqrt(x * x + y * y), 1.0)
            q = normal(product((c, x * s, y * s, 0.0), q))
        w, x, y, z = q
        return q, (2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z)

    return walk(df, by, [order], [*gyro, *accel], Recurrence(LEVEL, on, "", "ux double, uy double, uz double"))


def strapdown(df: DataFrame, by: str, order: str, gyro: list[str], accel: list[str], dt: float, gravity: float = 9.81) -> DataFrame:
    """Dead reckoning with rotation: attitude, then acceleration in the world frame without gravity, integrated twice.  A row
    whose acceleration is not whole measures none."""

    def on(held: tuple, *row: float):
        q, v, p = held
        q = turned(q, row[:3], dt)
        a = (0.0, 0.0, gravity) if None in row[3:] else rotated(q, row[3:])
        v = (v[0] + a[0] * dt, v[1] + a[1] * dt, v[2] + (a[2] - gravity) * dt)
        p = (p[0] + v[0] * dt, p[1] + v[1] * dt, p[2] + v[2] * dt)
        return (q, v, p), p

    still = (0.0, 0.0, 0.0)
    return walk(df, by, [order], [*gyro, *accel], Recurrence((LEVEL, still, still), on, "", "x double, y double, z double"))


def aligned(df: DataFrame, by: str, body: list[str], world: list[str], weight: Column) -> DataFrame:
    """by and the rotation `m` (nine numbers, row by row) that best takes each group's body vectors to its world vectors.

    The weighted outer products are summed where the rows are, so a group of any size is nine numbers; one small
    decomposition a group follows (wahba).  Groups whose vectors all lie on one line leave a turn open.
    """
    cells = [F.sum(weight * F.col(w) * F.col(b)).alias(f"p{k}") for k, (w, b) in enumerate((w, b) for w in world for b in body)]
    sums = df.groupBy(by).agg(*cells)

    def solve(batches):
        for pdf in batches:
            m = [nearest_rotation(np.array(r, dtype=float).reshape(3, 3)).ravel().tolist() for r in pdf[[f"p{k}" for k in range(9)]].itertuples(index=False, name=None)]
            yield pdf[[by]].assign(m=m)

    return sums.mapInPandas(solve, f"{by} {df.schema[by].dataType.simpleString()}, m array<double>")


def bias_fusion(accels: int, dt: float, gain: float = 1.5, bias_gain: float = 0.05, gravity: float = 9.81, dvl: bool = False) -> Recurrence:
    """Attitude quaternion (body to world) and gyro bias from rates, `accels` accelerometers and, with `dvl`, a velocity.

    Each step turns by the rate less the bias.  Every accelerometer then asks for the smallest turn that brings the
    predicted up vector onto what it measures, weighted by exp(-5 |size / gravity - 1|); a velocity vouches for the
    prediction with the weight of its speed (none under 0.2, 1 at most).  The weighted turn corrects the attitude by `gain`,
    and the bias against it by `bias_gain`, so that a constant bias is learned.  Gravity leaves the heading to the gyros.
    Inputs: three rates, three components for each accelerometer, and with `dvl` three of the velocity.  Null or zero
    vectors count for nothing; null rates as 0.
    """

    def step(state, *values):
        w, x, y, z, bx, by, bz = state
        gx, gy, gz = (a - b for a, b in zip((v or 0.0 for v in values[:3]), (bx, by, bz)))
        rate = math.sqrt(gx * gx + gy * gy + gz * gz)
        c, s = math.cos(rate * dt / 2), (math.sin(rate * dt / 2) / rate if rate > 1e-12 else dt / 2)
        w, x, y, z = normal(product((w, x, y, z), (c, gx * s, gy * s, gz * s)))
        up = (2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z)
        ex = ey = ez = total = 0.0
        for k in range(accels):
            a = values[3 + 3 * k : 6 + 3 * k]
            size = 0.0 if None in a else math.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
            if size > 1e-6:
                weight = math.exp(-5 * abs(size / gravity - 1))
                total += weight
                m = (a[0] / size, a[1] / size, a[2] / size)
                half = math.sqrt(max(2 * (1 + m[0] * up[0] + m[1] * up[1] + m[2] * up[2]), 0.0))
                if half > 1e-6:
                    ex += weight * (m[1] * up[2] - m[2] * up[1]) / half
                    ey += weight * (m[2] * up[0] - m[0] * up[2]) / half
                    ez += weight * (m[0] * up[1] - m[1] * up[0]) / half
        if dvl and None not in values[-3:]:
            speed = math.sqrt(sum(v * v for v in values[-3:]))
            total += 0.0 if speed < 0.2 else min(1.0, speed)
        total += 1e-6
        ex, ey, ez = ex / total, ey / total, ez / total
        bx, by, bz = bx - bias_gain * ex * dt, by - bias_gain * ey * dt, bz - bias_gain * ez * dt
        out = (*normal(product((w, x, y, z), normal((1.0, gain * ex, gain * ey, gain * ez)))), bx, by, bz)
        return out, out

    columns = "qw double, qx double, qy double, qz double, bx double, by double, bz double"
    return Recurrence((1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), step, columns, columns)


def product(p, q):
    return (
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
        p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1],
        p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    )


def normal(q):
    size = math.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return (q[0] / size, q[1] / size, q[2] / size, q[3] / size)


LEVEL = (1.0, 0.0, 0.0, 0.0)


def half_turn(rate: float, dt: float) -> tuple[float, float]:
    """The cosine of half the angle, and what a vector of this length is multiplied with for the quaternion's other part."""
    return math.cos(rate * dt / 2), (math.sin(rate * dt / 2) / rate if rate > 1e-12 else dt / 2)


def turned(q, rates, dt: float):
    """q after body rates held over dt."""
    gx, gy, gz = (v or 0.0 for v in rates)
    c, s = half_turn(math.sqrt(gx * gx + gy * gy + gz * gz), dt)
    return normal(product(q, (c, gx * s, gy * s, gz * s)))


def rotated(q, v):
    """v, a body vector, in the world frame."""
    w, x, y, z = q
    a, b, c = v
    return (
        (w * w + x * x - y * y - z * z) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c,
        2 * (x * y + w * z) * a + (w * w - x * x + y * y - z * z) * b + 2 * (y * z - w * x) * c,
        2 * (x * z - w * y) * a + 2 * (y * z + w * x) * b + (w * w - x * x - y * y + z * z) * c,
    )
