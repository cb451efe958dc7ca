"""Controllers and actuators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.geometry import clipped
from tidewater.operators.runs import Recurrence, walk

# Two-dimensional cross-flow drag coefficient against beam over twice the draught (digitised Hoerner curve).
DRAG_X = [0.0109, 0.1766, 0.3530, 0.4519, 0.4728, 0.4929, 0.4933, 0.5585, 0.6464, 0.8336, 0.9880, 1.3081, 1.6392, 1.8600, 2.3129, 2.6000, 3.0088, 3.4508, 3.7379, 4.0031]
DRAG_Y = [1.9661, 1.9657, 1.8976, 1.7872, 1.5837, 1.2786, 1.2108, 1.0836, 0.9986, 0.8796, 0.8284, 0.7599, 0.6914, 0.6571, 0.6307, 0.5962, 0.5868, 0.5859, 0.5599, 0.5593]


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear table lookup, held at the ends."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for k in range(1, len(xs)):
        out = out.when(x <= xs[k], ys[k - 1] + (x - xs[k - 1]) * ((ys[k] - ys[k - 1]) / (xs[k] - xs[k - 1])))
    return out.when(x.isNotNull(), F.lit(ys[-1]))


def thrusters(ex: Column, ey: Column, ez: Column, most: float = 20.0) -> list[Column]:
    """Eight thruster commands from a position error: four vertical, then the horizontal ones."""
    return [clipped(c, -most, most) for c in (ez, ez, ez, ez, ex + ey, ex - ey, ey, -ey)]


# Fixed value: a gap to the set point beyond this is taken for a sensor fault.
FAULT = 9_999_999.0


class Linear:
    """The recurrence state = A state + B inputs (over inputs that are not `held`), its components kept within bounds."""

    def __init__(self, a: np.ndarray, b: np.ndarray, bounds: np.ndarray | None = None):
        self.a, self.b, self.bounds = np.atleast_2d(a).astype(float), np.atleast_2d(b).astype(float), bounds
        self.state = np.zeros(len(self.a))

    def step(self, *inputs: float, held: bool = False) -> tuple[float, ...]:
        if not held:
            self.state = self.a @ self.state + self.b @ np.array(inputs, dtype=float)
            if self.bounds is not None:
                self.state = np.clip(self.state, -self.bounds, self.bounds)
        return tuple(self.state.tolist())


def smooth_path(frequency: float, damping: float, most_speed: float, dt: float) -> Linear:
    """Position, speed and acceleration on the way to a set point, by Euler steps of a third-order low-pass filter: one real
    pole at the frequency and a pair of the damping ratio, in companion form."""
    _, c2, c1, c0 = np.polymul([1.0, frequency], [1.0, 2 * damping * frequency, frequency * frequency])
    companion = np.array([[0, 1, 0], [0, 0, 1], [-c0, -c1, -c2]])
    return Linear(np.eye(3) + dt * companion, dt * c0 * np.array([[0], [0], [1]]), np.array([np.inf, most_speed, np.inf]))


def pid(df: DataFrame, by: str, order: list[str], value: str, want: float, dt: float, gains: tuple[float, float, float], tau: float, fault: float = FAULT) -> DataFrame:
    """by, order and command of a PID controller over every run: gains of the gap, its trapezoid integral and the slope of the
    measurement, which a low-pass filter of time constant tau smooths (by the bilinear transform).

    Gap, integral and differences are window sums; only the filter is a recurrence.  A measurement further than `fault` from
    the set point gives no command and moves neither integral nor slope.  Before a run everything is 0.
    """
    run = Window.partitionBy(by).orderBy(*order)
    gap = F.lit(float(want)) - F.col(value)
    seen = df.select(by, *order, gap.alias("gap"), (F.col(value) - F.coalesce(F.lag(value).over(run), F.lit(0.0))).alias("rise"), (F.coalesce(F.lag(gap).over(run), F.lit(0.0)) + gap).alias("ends"))
    seen = seen.withColumn("held", F.abs("gap") > fault)
    area = F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("ends") * (dt / 2))).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p, i, d = gains
    pole, gain = (2 * tau - dt) / (2 * tau + dt), 2 / (2 * tau + dt)

    def command(smooth: list[float], gap: float, area: float, rise: float, held: bool) -> tuple[float]:
        if not held:
            smooth[0] = pole * smooth[0] + gain * rise
        return (0.0 if held else p * gap + i * area - d * smooth[0],)

    return scanned(seen.withColumn("area", area), by, order, ["gap", "area", "rise", "held"], lambda: [0.0], command, "command double", ["command"])


class Actuator:
    """First-order lag by Euler steps, saturated."""

    def __init__(self, lag: float, most: float):
        self.lag, self.most, self.at = lag, most, 0.0

    def step(self, command: float, dt: float) -> float:
        self.at += dt * (command - self.at) / self.lag
        self.at = max(-self.most, min(self.most, self.at))
        return self.at


class DistanceReward:
    """Rewards each time a distance beats the next target, which then moves on by an interval."""

    def __init__(self, goal: float, interval: float, first: float | None = None, maximise: bool = False):
        self.goal, self.interval, self.next, self.maximise = goal, interval, first, maximise

    def step(self, distance: float) -> tuple[int, bool]:
        sign = 1 if self.maximise else -1
        if self.next is None:
            self.next = distance + sign * self.interval
        beats = (distance > self.next) if self.maximise else (distance < self.next)
        if beats:
            self.next = distance + sign * self.interval
        return int(beats), (distance > self.goal) if self.maximise else (distance < self.goal)


def scanned(df: DataFrame, by: str, order: list[str], inputs: list[str], make, step, schema: str, names: list[str]) -> DataFrame:
    """Runs a stateful step over every ordered run: state = make(); outputs = step(state, *inputs).  See runs.walk."""

    def on(held: tuple, *values):
        state = held[0] or make()
        return (state,), step(state, *values)

    return walk(df, by, order, inputs, Recurrence((None,), on, "", schema)).select(by, *order, *names)


def pid_direct(df: DataFrame, by: str, order: list[str], value: str, slope: str, want: float, dt: float, gains: tuple[float, float, float], turn: float | None = None, fault: float = FAULT) -> DataFrame:
    """by, order and command of a PID controller that is given the measurement's slope, so that all of it is window sums.

    With `turn` (360 or 2 pi) the measurement is an angle: a gap of half a turn or more goes the other way round, once.
    A gap beyond `fault` is taken over as the gap before, so its trapezoid counts whole.  Before a run the gap is 0.
    """
    run = Window.partitionBy(by).orderBy(*order)
    gap = F.lit(float(want)) - F.col(value)
    if turn:
        gap = F.when(gap >= turn / 2, gap - turn).when(gap <= -turn / 2, gap + turn).otherwise(gap)
    seen = df.select(by, *order, gap.alias("__gap"), F.col(slope).alias("__slope"))
    before = F.when(F.abs("__gap") > fault, F.col("__gap")).otherwise(F.coalesce(F.lag("__gap").over(run), F.lit(0.0)))
    area = F.sum(dt / 2 * (F.col("__gap") + F.col("__before"))).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p, i, d = gains
    return seen.withColumn("__before", before).withColumn("__area", area).select(by, *order, (p * F.col("__gap") + i * F.col("__area") - d * F.col("__slope")).alias("command"))


def allocated(surge: Column, yaw: Column, arm: float, ahead: float, astern: float) -> tuple[Column, Column]:
    """Turns of two propellers, `arm` to the left and right of the axis, whose thrusts add up to a surge force and whose
    difference makes a yaw moment; thrust is k n |n| with a k for each direction."""
    thrusts = ((surge + yaw / arm) / 2, (surge - yaw / arm) / 2)
    return tuple(F.signum(t) * F.sqrt(F.abs(t) / F.when(t > 0, ahead).otherwise(astern)) for t in thrusts)
