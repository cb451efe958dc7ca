"""Gaussian processes with fitted kernels: exact on a bounded sample, sparse on all rows; and their models as tables."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.noise import uniform
from tidewater.operators.learning import gp_predict
from tidewater.storage import fresh_path


class Kernel(NamedTuple):
    """variance * exp(-distance^2 / (2 length^2)), and the noise variance of the readings."""

    variance: float
    length: float
    noise: float


class Model(NamedTuple):
    """The mean at a place is offset + scale * (sum of weights times the kernel at the centres)."""

    axes: list[str]
    centres: np.ndarray
    weights: np.ndarray
    kernel: Kernel
    offset: float = 0.0
    scale: float = 1.0

    def mean(self, df: DataFrame) -> Column:
        return self.offset + self.scale * gp_predict(df, self.axes, self.centres.tolist(), self.weights.tolist(), self.kernel.variance, self.kernel.length)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)


def first_by_hash(df: DataFrame, axes: list[str], key: str, rows: int, seed: int, more: tuple[str, ...] = ()) -> np.ndarray:
    """At most `rows` complete rows, those with the smallest hashes of the key."""
    picked = df.select(key, *axes, *more).na.drop().orderBy(uniform(F.col(key), seed), key).limit(rows)
    return np.array([[float(v) for v in r] for r in picked.select(*axes, *more).toLocalIterator()]).reshape(-1, len(axes) + len(more))


# --- exact, on a sample ---------------------------------------------------------------------------------------------


def evidence(theta: np.ndarray, gaps: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log marginal likelihood and its gradient; theta: logs of variance, length and noise."""
    variance, length, noise = np.exp(theta)
    k = variance * np.exp(-0.5 * gaps / length**2)
    low = np.linalg.cholesky(k + (noise + 1e-8) * np.eye(len(y)))
    inverse = np.linalg.inv(low)
    inverse = inverse.T @ inverse
    alpha = inverse @ y
    value = 0.5 * y @ alpha + np.log(np.diag(low)).sum() + 0.5 * len(y) * np.log(2 * np.pi)
    outer = inverse - np.outer(alpha, alpha)
    return value, 0.5 * np.array([(outer * k).sum(), (outer * (k * gaps / length**2)).sum(), noise * np.trace(outer)])


def climbed(f, theta: np.ndarray, steps: int, box: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
    """The least value that quasi-Newton steps with halving find within a box."""
    value, slope = f(theta)
    shape = np.eye(len(theta))
    for _ in range(steps):
        move = -shape @ slope
        if move @ slope >= 0:
            shape, move = np.eye(len(theta)), -slope
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        for half in range(20):
            new = np.clip(theta + move * 0.5**half, *box)
            try:
                ahead, turn = f(new)
            except np.linalg.LinAlgError:
                continue
            if ahead < value - 1e-4 * abs(slope @ (new - theta)):
                break
        else:
            break
        went, bent = new - theta, turn - slope
        theta, gain, value, slope = new, value - ahead, ahead, turn
        if went @ bent > 1e-12:
            r = 1 / (went @ bent)
            left = np.eye(len(theta)) - r * np.outer(went, bent)
            shape = left @ shape @ left.T + r * np.outer(went, went)
        if gain < 1e-7 * (1 + abs(value)):
            break
    return value, theta


def fit_exact(df: DataFrame, axes: list[str], target: str, key: str, sample: int = 512, starts: int = 6, steps: int = 60, seed: int = 7) -> Model:
    """Kernel by the largest marginal likelihood over several starts, then the exact posterior mean.

    Learns from at most `sample` complete rows, those with the smallest hashes of the key (a sample-by-sample matrix is
    factored at each step); the target is centred and scaled.  Each start is a Spark task; the first is at variance 1,
    length 1/4 of the extent and noise 0.1, the others are drawn around it.  With fewer than two rows the mean is constant.
    """
    rows = first_by_hash(df, axes, key, sample, seed, (target,))
    x, y = rows[:, :-1], rows[:, -1]
    offset = float(y.mean()) if len(y) else 0.0
    scale = float(y.std()) or 1.0 if len(y) else 1.0
    if len(y) < 2:
        return Model(axes, x, np.zeros(len(x)), Kernel(1.0, 1.0, 0.1), offset, scale)
    gaps, z = squares(x, x), (y - offset) / scale
    extent = max(float(np.ptp(x, axis=0).max()), 1e-9)
    middle = np.log([1.0, extent / 4, 0.1])
    box = (np.log([1e-3, extent * 1e-3, 1e-5]), np.log([1e3, extent * 10, 10.0]))
    draw = np.random.default_rng(seed)
    begin = [middle, *(middle + draw.normal(0, 1, 3) for _ in range(starts - 1))]
    spark = df.sparkSession
    table = spark.createDataFrame([(k, *map(float, t)) for k, t in enumerate(begin)], "k int, a double, b double, c double").repartition(starts, "k")

    def search(batches):
        for pdf in batches:
            found = [climbed(lambda t: evidence(t, gaps, z), np.clip(r, *box), steps, box) for r in pdf[["a", "b", "c"]].to_numpy()]
            yield pd.DataFrame([(v, *t) for v, t in found], columns=["v", "a", "b", "c"])

    best = min(tuple(r) for r in table.mapInPandas(search, "v double, a double, b double, c double").collect())
    kernel = Kernel(*map(float, np.exp(best[1:])))
    k = kernel.variance * np.exp(-0.5 * gaps / kernel.length**2)
    return Model(axes, x, np.linalg.solve(k + (kernel.noise + 1e-8) * np.eye(len(z)), z), kernel, offset, scale)


# --- sparse, on all rows --------------------------------------------------------------------------------------------


class Sums(NamedTuple):
    """What the bound needs of the rows, for a kernel of variance 1: K K', K y, y'y, the count, and the slopes of the first two
    in the log of the length."""

    kk: np.ndarray
    ky: np.ndarray
    yy: float
    n: float
    kk_slope: np.ndarray
    ky_slope: np.ndarray


def sums_of(rows: DataFrame, axes: list[str], target: str, centres: np.ndarray, length: float) -> Sums:
    """One pass: each partition adds up its share, arrays of the size of the centres squared, and these are added up by place."""
    m = len(centres)

    def part(batches):
        flat = np.zeros(2 * m * m + 2 * m + 2)
        for pdf in batches:
            x, y = pdf[axes].to_numpy(float), pdf[target].to_numpy(float)
            gaps = squares(centres, x) / length**2
            k = np.exp(-0.5 * gaps)
            slope = k * gaps
            flat += np.concatenate([(k @ k.T).ravel(), k @ y, (slope @ k.T).ravel(), slope @ y, [y @ y, len(y)]])
        yield pd.DataFrame({"at": np.arange(len(flat)), "v": flat})

    added = rows.select(*axes, target).mapInPandas(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    flat = added.orderBy("at").toPandas().v.to_numpy()
    kk, ky, half, ky_slope = np.split(flat[:-2], np.cumsum([m * m, m, m * m]))
    half = half.reshape(m, m)
    return Sums(kk.reshape(m, m), ky, flat[-2], flat[-1], half + half.T, ky_slope)


def loss(theta: np.ndarray, at: np.ndarray, s: Sums, gaps: np.ndarray, share: float = 1.0) -> float:
    """The negative collapsed bound of Titsias (2009) for each row.  `s` was summed at the length of `at`; for a length nearby
    its slopes carry it over.  share: rows of all rows that `s` stands for."""
    variance, length, noise = np.exp(theta)
    move = theta[1] - at[1]
    kk, ky = s.kk + move * s.kk_slope, s.ky + move * s.ky_slope
    m, n = len(ky), s.n / share
    low = np.linalg.cholesky(np.exp(-0.5 * gaps / length**2) + 1e-6 * np.eye(m))
    half = np.linalg.solve(low, kk)
    inner = np.linalg.solve(low, half.T) * variance / share
    b = np.eye(m) + inner / noise
    c = np.linalg.solve(low, ky) * np.sqrt(variance) / share
    lb = np.linalg.cholesky(b)
    q = np.linalg.solve(lb, c)
    yy = s.yy / share
    value = 0.5 * n * np.log(2 * np.pi * noise) + np.log(np.diag(lb)).sum() + 0.5 * (yy / noise - q @ q / noise**2) + 0.5 * (n * variance - np.trace(inner)) / noise
    return float(value / n)


def fit_sparse(df: DataFrame, axes: list[str], target: str, key: str, inducing: int = 50, epochs: int = 8, batches: int = 4, rate: float = 0.15, seed: int = 7) -> tuple[Model, list[float]]:
    """A sparse process whose variance, length and noise are fitted to all complete rows, and the mean loss of each epoch.

    Rows are dealt into `batches` by a hash of the key and stored by batch, so a step reads its batch only: one pass sums
    what the bound needs where the rows are, the driver moves three numbers by it (Adam on their logs), and the
    arrays that it sees are of the size of the centres squared, however many rows there are.  The centres are the
    `inducing` rows with the smallest hashes.  The last pass, over all rows, gives the weights.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    whole = df.select(key, *axes, target).na.drop()
    stats = whole.agg(F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"), *(F.max(a).alias(f"hi{a}") for a in axes), *(F.min(a).alias(f"lo{a}") for a in axes)).first()
    offset, scale = stats["mean"] or 0.0, stats["std"] or 1.0
    centres = first_by_hash(whole, axes, key, inducing, seed)
    if not len(centres):
        return Model(axes, centres, np.zeros(0), Kernel(1.0, 1.0, 0.1), offset, scale), []
    scaled = whole.select(*(F.col(a).cast("double").alias(a) for a in axes), ((F.col(target) - offset) / scale).alias(target), F.floor(uniform(F.col(key), seed + 1) * batches).cast("int").alias("batch"))
    scaled.write.partitionBy("batch").parquet(path)
    rows = spark.read.parquet(path)
    # equal centres would make the kernel's matrix singular
    centres = np.unique(centres, axis=0)
    gaps = squares(centres, centres)
    extent = max((float(stats[f"hi{a}"] - stats[f"lo{a}"]) for a in axes), default=1.0) or 1.0
    theta = np.log([1.0, extent / 4, 0.1])
    box = (np.log([1e-3, extent * 1e-3, 1e-5]), np.log([1e3, extent * 10, 10.0]))
    first, second, losses, step = np.zeros(3), np.zeros(3), [], 0
    for _ in range(epochs):
        seen = []
        for k in range(batches):
            s = sums_of(rows.where(F.col("batch") == k), axes, target, centres, float(np.exp(theta[1])))
            if not s.n:
                continue
            share = 1.0 / batches
            seen.append(loss(theta, theta, s, gaps, share))
            slope = np.array([(loss(theta + e, theta, s, gaps, share) - loss(theta - e, theta, s, gaps, share)) / 2e-4 for e in np.eye(3) * 1e-4])
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            theta = np.clip(theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8), *box)
        losses.append(float(np.mean(seen)))
    kernel = Kernel(*map(float, np.exp(theta)))
    s = sums_of(rows, axes, target, centres, kernel.length)
    own = kernel.variance * np.exp(-0.5 * gaps / kernel.length**2)
    inner = kernel.noise * own + kernel.variance**2 * s.kk + 1e-6 * np.eye(len(own))
    return Model(axes, centres, np.linalg.solve(inner, kernel.variance * s.ky), kernel, offset, scale), losses


# --- models as tables -----------------------------------------------------------------------------------------------


def save(spark: SparkSession, model: Model, path: str) -> None:
    """One row of Parquet for each centre, in order, with the kernel beside it.  What stands there is overwritten."""
    rows = [(k, [float(v) for v in c], float(w)) for k, (c, w) in enumerate(zip(model.centres, model.weights))]
    table = spark.createDataFrame(rows, "k int, centre array<double>, weight double")
    about = (F.lit(v).alias(n) for n, v in (*model.kernel._asdict().items(), ("offset", model.offset), ("scale", model.scale)))
    table.select("*", F.array(*map(F.lit, model.axes)).alias("axes"), *about).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).orderBy("k").collect()
    r = rows[0]
    return Model(list(r.axes), np.array([x.centre for x in rows]), np.array([x.weight for x in rows]), Kernel(r.variance, r.length, r.noise), r.offset, r.scale)
