"""Angles, spherical coordinates, frames and quaternions as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def atan2_approx(y: Column, x: Column) -> Column:
    """Degrees of the angle of (x, y) by a cubic in the octant ratio (about 0.3 degrees off at most)."""
    height = F.abs(y) + 1e-10
    left = x < 0
    ratio = F.when(left, (x + height) / (height - x)).otherwise((x - height) / (x + height))
    angle = (F.when(left, 3 * pi / 4).otherwise(pi / 4) + (0.1963 * ratio * ratio - 0.9817) * ratio) * (180 / pi)
    return F.when(y < 0, -angle).otherwise(angle)


def spherical(x: Column, y: Column, z: Column) -> Column:
    """range, azimuth (y negated) and elevation from the z axis, in degrees."""
    return F.struct(
        F.sqrt(x * x + y * y + z * z).alias("range"),
        F.degrees(F.atan2(-y, x)).alias("azimuth"),
        F.degrees(F.atan2(F.sqrt(x * x + y * y), z)).alias("elevation"),
    )


def cartesian(distance: Column, azimuth: Column, elevation: Column) -> Column:
    """The inverse of spherical()."""
    flat = distance * F.sin(F.radians(elevation))
    return F.struct((flat * F.cos(F.radians(azimuth))).alias("x"), (-flat * F.sin(F.radians(azimuth))).alias("y"), (distance * F.cos(F.radians(elevation))).alias("z"))


def bearing(x: Column, y: Column, z: Column) -> Column:
    """azimuth and elevation (radians) and range of a beacon."""
    return F.struct(F.atan2(y, x).alias("azimuth"), F.atan2(z, F.sqrt(x * x + y * y)).alias("elevation"), F.sqrt(x * x + y * y + z * z).alias("range"))


def wrapped(angle: Column) -> Column:
    """The signed angle in [-pi, pi)."""
    return F.pmod(angle + pi, F.lit(2 * pi)) - pi


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    """Hamilton product of (w, x, y, z) pairs."""
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw]


def quaternion_of_rate(wx: Column, wy: Column, wz: Column, dt: float) -> list[Column]:
    """The turn of an angular rate over dt; a tiny one is the identity."""
    rate = F.sqrt(wx * wx + wy * wy + wz * wz)
    tiny = rate * dt < 1e-8
    share = F.when(tiny, 0.0).otherwise(F.sin(rate * dt / 2) / F.when(rate > 0, rate).otherwise(1.0))
    return [F.when(tiny, 1.0).otherwise(F.cos(rate * dt / 2)), wx * share, wy * share, wz * share]


def rotated(roll: Column, pitch: Column, yaw: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """A body vector in the world frame: yaw, pitch and roll (radians) applied as Rz Ry Rx."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        cy * cp * x + (cy * sp * sr - sy * cr) * y + (sy * sr + cy * cr * sp) * z,
        sy * cp * x + (cy * cr + sr * sp * sy) * y + (sp * sy * cr - cy * sr) * z,
        -sp * x + cp * sr * y + cp * cr * z,
    ]


def to_client_frame(x: Column, y: Column, z: Column, angular: bool = False) -> list[Column]:
    """Engine vectors (centimetres, left-handed) as client vectors (metres, right-handed)."""
    return [-x, y, -z] if angular else [x / 100, -y / 100, z / 100]


def reflected(incoming: list[Column], normal: list[Column]) -> list[Column]:
    """Specular reflection -i + 2 (n . i) n."""
    dot = sum((i * n for i, n in zip(incoming[1:], normal[1:])), incoming[0] * normal[0])
    return [2 * dot * n - i for i, n in zip(incoming, normal)]


def echo_strength(impedance: Column, water: float, cosine: Column) -> Column:
    """R^2 cos, with R the reflection coefficient at the boundary."""
    share = (impedance - water) / (impedance + water)
    return share * share * cosine


def unpacked_pose(matrix: Column) -> tuple[list[Column], list[list[Column]]]:
    """Position, and the three axes of the body, of a 4 x 4 pose given as an array of rows."""
    at = [F.element_at(F.element_at(matrix, k), 4) for k in (1, 2, 3)]
    return at, [[F.element_at(F.element_at(matrix, k), c) for k in (1, 2, 3)] for c in (1, 2, 3)]


def polar_to_world(position: list[Column], angles: list[Column], distance: Column, theta: Column) -> list[Column]:
    """A beam's end in the world: position + R (r cos theta, r sin theta, 0)."""
    return [p + d for p, d in zip(position, rotated(*angles, distance * F.cos(theta), distance * F.sin(theta), F.lit(0.0)))]


def faces(normal: list[Column], to_sensor: list[Column]) -> Column:
    """Whether a surface looks towards the sensor."""
    return sum((a * b for a, b in zip(normal[1:], to_sensor[1:])), normal[0] * to_sensor[0]) > 0


def segment_meets_box(start: list[Column], end: list[Column], low: list[float], high: list[float]) -> Column:
    """Whether the segment touches an axis-aligned box: on every axis it spends a share of its way inside, and the shares overlap."""
    enter, leave, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for a, b, lo, hi in zip(start, end, low, high):
        way = F.when(b != a, b - a)
        one, two = (lo - a) / way, (hi - a) / way
        # least() and greatest() pass over the nulls of an axis along which nothing moves
        enter.append(F.least(one, two))
        leave.append(F.greatest(one, two))
        outside = outside | ((b == a) & ((a < lo) | (a > hi)))
    return ~outside & (F.greatest(*enter) <= F.least(*leave))


def ring_angles(count: Column) -> Column:
    """Directions in degrees of a range finder's beams, a full turn without its end."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * 360.0 / count)


def strip_loads(sway: Column, yaw_rate: Column, length: float, draft: float, density: float, coefficient: float, strips: int = 21) -> tuple[Column, Column]:
    """Side force and turning moment of cross-flow drag, summed over strips along the hull."""
    step = length / (strips - 1)
    places = F.array(*[F.lit(-length / 2 + step * k) for k in range(strips)])
    flow = F.transform(places, lambda x: F.struct(x.alias("x"), (sway + x * yaw_rate).alias("u")))
    scale = -0.5 * density * draft * coefficient * step
    force = F.aggregate(flow, F.lit(0.0), lambda s, p: s + F.abs(p["u"]) * p["u"])
    moment = F.aggregate(flow, F.lit(0.0), lambda s, p: s + p["x"] * F.abs(p["u"]) * p["u"])
    return scale * force, scale * moment
