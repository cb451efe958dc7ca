"""Labels, splits, reports, scaling, classification and sparse Gaussian-process regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.noise import uniform
from tidewater.operators.ordering import places


def encoded_labels(df: DataFrame, label: str) -> DataFrame:
    """Adds `code`, the place of the label among the sorted distinct ones, from 0 (the labels, not the rows, are ranked)."""
    kinds = df.select(label).where(F.col(label).isNotNull()).distinct()
    ranks = kinds.withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(ranks, label, "left")


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def stratified(df: DataFrame, key: str, label: str, share: float, seed: int = 42) -> DataFrame:
    """Adds `train`: the share of rows with the smallest hashes within each label.  No task sorts a whole label."""
    placed = places(df.withColumn("__hash", shuffle_key(key, seed)), label, ["__hash", key])
    return placed.select(*df.columns, (F.col("__place") < F.floor(F.col("__size") * share)).alias("train"))


def batched(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Adds `batch` (from 0): rows shuffled by hash and cut into batches of `size`, the last one shorter."""
    placed = places(df.withColumns({"__hash": shuffle_key(key, seed), "__all": F.lit(0)}), "__all", ["__hash", key])
    return placed.select(*df.columns, F.floor(F.col("__place") / size).alias("batch"))


def report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, from one small confusion table."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("side")), F.struct(F.col("g").alias("label"), F.lit("g").alias("side")))).alias("s"), "t", "g", "n")
    sums = sides.groupBy("s.label").agg(
        F.sum(F.when((F.col("s.side") == "t") & (F.col("t") == F.col("g")), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.side") == "g", F.col("n")).otherwise(0)).alias("guessed"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("label", ratio(F.col("hits"), F.col("guessed")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2.0 * F.col("hits"), F.col("support") + F.col("guessed")).alias("f1"), "support")


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z-scores with the population deviation; 0 where a column is constant.  The statistics are one row, read once."""
    stats = df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).first()
    out = df
    for c in columns:
        mean, std = stats[f"{c}_mean"], stats[f"{c}_std"]
        out = out.withColumn(f"{c}_scaled", (F.col(c) - mean) / std if std else F.lit(0.0))
    return out


def rbf(a: list[Column], b: list[Column], variance: float, length: float) -> Column:
    gap = sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))
    return variance * F.exp(-0.5 * gap / (length * length))


def gp_predict(df: DataFrame, axes: list[str], centres: list[tuple], weights: list[float], variance: float, length: float) -> Column:
    """The mean of a sparse Gaussian process at each row: a sum over a bounded list of centres."""
    table = F.array(*(F.struct(*(F.lit(float(v)).alias(f"c{k}") for k, v in enumerate(c)), F.lit(float(w)).alias("w")) for c, w in zip(centres, weights)))
    return F.aggregate(table, F.lit(0.0), lambda total, c: total + c["w"] * rbf([F.col(a) for a in axes], [c[f"c{k}"] for k in range(len(axes))], variance, length))


def gp_fit(df: DataFrame, axes: list[str], target: str, key: str, inducing: int = 100, variance: float = 1.0, length: float = 1.0, noise: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Centres and weights of the optimal sparse posterior mean for a fixed kernel (Titsias 2009).

    Every partition sums its share of K_mn K_nm and K_mn y, an m x m and an m array; the sums are added up and one
    m x m system is solved on the driver.  Centres: the `inducing` rows with the smallest hashes of the key.
    """
    centres = np.array([[float(v) for v in r] for r in df.orderBy(uniform(F.col(key), 7), key).limit(inducing).select(*axes).toLocalIterator()])
    m = len(centres)

    def kernel(a, b):
        return variance * np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(2) / length**2)

    def part(batches):
        left, right = np.zeros((m, m)), np.zeros(m)
        for pdf in batches:
            k = kernel(centres, pdf[axes].to_numpy(float))
            left += k @ k.T
            right += k @ pdf[target].to_numpy(float)
        yield pd.DataFrame({"at": np.arange(m * m + m), "v": np.concatenate([left.ravel(), right])})

    sums = df.select(*axes, target).na.drop().mapInPandas(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toPandas().v.to_numpy()
    left, right = sums[: m * m].reshape(m, m), sums[m * m :]
    inner = noise * kernel(centres, centres) + left + 1e-6 * np.eye(m)
    return centres, np.linalg.solve(inner, right)


def classifier(train: DataFrame, features: list[str], label: str, trees: int = 40, seed: int = 42):
    """A multiclass forest over numeric columns; .transform() adds prediction, probability and the label's name."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=label, outputCol="__code", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    steps = [index, VectorAssembler(inputCols=features, outputCol="__features"), RandomForestClassifier(featuresCol="__features", labelCol="__code", numTrees=trees, maxDepth=8, seed=seed), IndexToString(inputCol="prediction", outputCol="predicted_label", labels=index.labels)]
    return Pipeline(stages=steps).fit(train)
