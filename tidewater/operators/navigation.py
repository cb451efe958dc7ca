"""Kinematics over ordered runs, and a Kalman filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.runs import Recurrence, walk


def acceleration(df: DataFrame, by: str, order: list[str], value: str, time: str) -> DataFrame:
    """First difference over the step in time; 0 on the first row and where time stands still."""
    w = Window.partitionBy(by).orderBy(*order)
    dt = F.col(time) - F.lag(time).over(w)
    return df.withColumn("dt", dt).withColumn("acceleration", F.when(F.col("dt") > 0, (F.col(value) - F.lag(value).over(w)) / F.col("dt")).otherwise(0.0))


def dead_reckoning(df: DataFrame, by: str, order: list[str], rate: str, dt: float) -> DataFrame:
    """Velocity and position by Euler steps, with the new velocity."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("velocity", F.sum(F.col(rate) * dt).over(w)).withColumn("position", F.sum(F.col("velocity") * dt).over(w))


def path_error(a: DataFrame, b: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Distance between two paths at equal steps."""
    from .matching import distance

    met = a.select(*keys, *axes).join(b.select(*keys, *(F.col(x).alias(f"other_{x}") for x in axes)), keys)
    return met.withColumn("error", distance([F.col(x) for x in axes], [F.col(f"other_{x}") for x in axes]))


class Kalman:
    """Position and velocity on one axis.  Axes do not mix here, so three of these make the whole filter."""

    def __init__(self, r: float = 5.0, sigma: float = 0.5):
        self.r, self.q = r, sigma * sigma
        self.x = self.v = 0.0
        self.p = [1.0, 0.0, 1.0]  # variances and covariance: xx, xv, vv

    def predict(self, a: float, dt: float) -> None:
        self.x, self.v = self.x + self.v * dt + 0.5 * a * dt * dt, self.v + a * dt
        xx, xv, vv = self.p
        self.p = [xx + 2 * dt * xv + dt * dt * vv + self.q * dt**4 / 4, xv + dt * vv + self.q * dt**3 / 2, vv + self.q * dt * dt]

    def update(self, z: float | None) -> None:
        """A missing measurement leaves the prediction."""
        if z is None or z != z:
            return
        xx, xv, vv = self.p
        kx, kv = xx / (xx + self.r), xv / (xx + self.r)
        gap = z - self.x
        self.x, self.v = self.x + kx * gap, self.v + kv * gap
        self.p = [(1 - kx) * xx, (1 - kx) * xv, vv - kv * xv]


def kalman(df: DataFrame, by: str, order: list[str], a: str, z: str, dt: float, r: float = 5.0) -> DataFrame:
    """Filtered x and v of every row, run by run; parallel over runs, with one state a task (runs.walk)."""

    def on(held: tuple, acc: float, seen: float | None):
        k = held[0] or Kalman(r)
        k.predict(acc, dt)
        k.update(seen)
        return (k,), (k.x, k.v)

    return walk(df, by, order, [a, z], Recurrence((None,), on, "", "x double, v double"))


def corrected_pose(gap: Column, far: Column, dead: Column, other: Column, matched: Column, reach: float = 3.0, near: float = 50.0) -> Column:
    """Which position corrects a filter: the other estimate where the two differ too much, the map match where the
    echo is near, else the dead-reckoned one."""
    return F.when(F.abs(gap) > reach, other).when((far < near) & matched.isNotNull(), matched).otherwise(dead)


def depth_from_sonar(sonar_depth: Column, terrain: Column, reckoned: Column) -> Column:
    """Depth by altitude over known terrain; without an echo the reckoned one stays."""
    return F.when(sonar_depth.isNull() | F.isnan(sonar_depth), reckoned).otherwise(sonar_depth + terrain)
