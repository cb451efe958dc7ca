"""Gaussian processes with fitted kernels, boosted classes, and models that are saved and loaded."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewater.operators import boosting, gaussian, learning


def drawn(n, kernel, seed, axes=1):
    """Rows of a function drawn from a process with this kernel."""
    deal = np.random.default_rng(seed)
    x = deal.uniform(0, 10, (n, axes))
    k = kernel.variance * np.exp(-0.5 * gaussian.squares(x, x) / kernel.length**2)
    f = np.linalg.cholesky(k + 1e-8 * np.eye(n)) @ deal.normal(size=n)
    return x, f, f + np.sqrt(kernel.noise) * deal.normal(size=n)


def table(spark, x, y):
    names = ["a", "b"][: x.shape[1]]
    return spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{c} double" for c in names) + ", y double")


def test_gradients():
    deal = np.random.default_rng(1)
    x, y, theta = deal.normal(size=(30, 2)), deal.normal(size=30), np.log([1.3, 0.7, 0.2])
    f = lambda t: gaussian.evidence(t, gaussian.squares(x, x), y)
    near = [(f(theta + e)[0] - f(theta - e)[0]) / 2e-5 for e in np.eye(3) * 1e-5]
    assert np.allclose(f(theta)[1], near, rtol=1e-5)


def test_exact_fit_recovers_the_kernel(spark):
    true = gaussian.Kernel(2.0, 1.0, 0.05)
    x, f, y = drawn(400, true, 3)
    model = gaussian.fit_exact(table(spark, x, y), ["a"], "y", "id", sample=400)
    # in the units of the readings
    assert model.kernel.length == pytest.approx(1.0, rel=0.3)
    assert model.kernel.noise * model.scale**2 == pytest.approx(0.05, rel=0.4)
    df = table(spark, x, f)
    got = df.select((model.mean(df) - F.col("y")).alias("e")).toPandas().e
    assert np.sqrt((got**2).mean()) < 0.12


def test_exact_fit_of_few_rows(spark):
    none = spark.createDataFrame([], "id long, a double, y double")
    assert gaussian.fit_exact(none, ["a"], "y", "id").weights.tolist() == []
    one = spark.createDataFrame([(1, 2.0, 7.0), (2, None, 9.0)], "id long, a double, y double")
    assert one.select(gaussian.fit_exact(one, ["a"], "y", "id").mean(one)).first()[0] == 7.0


def test_bound_equals_dense_algebra(spark):
    x, _, y = drawn(60, gaussian.Kernel(1.0, 1.0, 0.1), 4, axes=2)
    centres, theta = x[:12], np.log([1.4, 0.9, 0.2])
    s = gaussian.sums_of(table(spark, x, y).repartition(3), ["a", "b"], "y", centres, 0.9)
    k = lambda a, b: 1.4 * np.exp(-0.5 * gaussian.squares(a, b) / 0.81)
    q = k(x, centres) @ np.linalg.solve(k(centres, centres) + 1.4e-6 * np.eye(12), k(centres, x))
    cov = q + 0.2 * np.eye(60)
    dense = 0.5 * (60 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + y @ np.linalg.solve(cov, y)) + (60 * 1.4 - np.trace(q)) / 0.4
    assert gaussian.loss(theta, theta, s, gaussian.squares(centres, centres)) == pytest.approx(dense / 60, rel=1e-6)
    # a slope in the length by the carried sums equals one by sums at the other length
    step = np.array([0.0, 1e-3, 0.0])
    there = gaussian.sums_of(table(spark, x, y), ["a", "b"], "y", centres, float(np.exp(theta[1] + 1e-3)))
    assert gaussian.loss(theta + step, theta, s, gaussian.squares(centres, centres)) == pytest.approx(gaussian.loss(theta + step, theta + step, there, gaussian.squares(centres, centres)), abs=1e-5)


def test_sparse_fit_lowers_the_loss_and_beats_a_fixed_kernel(spark, tmp_path):
    x, f, y = drawn(900, gaussian.Kernel(1.0, 0.8, 0.02), 5)
    train, rest = table(spark, x[:700], y[:700]), table(spark, x[700:], f[700:])
    model, losses = gaussian.fit_sparse(train, ["a"], "y", "id", inducing=40, epochs=6, batches=2, rate=0.25)
    assert len(losses) == 6 and losses[-1] < losses[0] - 0.1
    error = lambda m: np.sqrt((rest.select((m - F.col("y")).alias("e")).toPandas().e ** 2).mean())
    z, w = learning.gp_fit(train, ["a"], "y", "id", inducing=40, length=5.0)
    assert error(model.mean(rest)) < error(learning.gp_predict(rest, ["a"], z.tolist(), w.tolist(), 1.0, 5.0))
    gaussian.save(spark, model, str(tmp_path / "gp"))
    again = gaussian.load(spark, str(tmp_path / "gp"))
    assert again.kernel == model.kernel and rest.select(again.mean(rest)).collect() == rest.select(model.mean(rest)).collect()


def test_sparse_fit_of_nothing(spark):
    none = spark.createDataFrame([], "id long, a double, y double")
    model, losses = gaussian.fit_sparse(none, ["a"], "y", "id")
    assert losses == [] and len(model.weights) == 0


@pytest.fixture(scope="module")
def rings(spark):
    """Three classes by distance from the middle: additive in the squares, which boosting follows better than averages."""
    deal = np.random.default_rng(6)
    at = deal.uniform(-1, 1, (900, 6))
    far = (at[:, :3] ** 2).sum(1) + 0.5 * at[:, 3]
    cut = np.quantile(far, [1 / 3, 2 / 3])
    rows = [(k, *map(float, r), "abc"[int(np.searchsorted(cut, d))]) for k, (r, d) in enumerate(zip(at, far))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"f{k} double" for k in range(6)) + ", label string")


def test_boosting_beats_the_forest_and_comes_back_from_disk(spark, rings, tmp_path):
    names = [f"f{k}" for k in range(6)]
    train, rest = rings.where("id < 600"), rings.where("id >= 600")
    model = boosting.boosted(train.union(spark.createDataFrame([(-1, *[0.0] * 6, None)], train.schema)), names, "label", rounds=12, depth=3, step=0.3)
    got = model.transform(rest)
    assert [c for c in got.columns if c in ("prediction", "probability", "predicted_label")] == ["probability", "prediction", "predicted_label"]
    shares = got.select(vector_to_array("probability").alias("p"), "prediction", "label", "predicted_label").collect()
    assert all(abs(sum(r.p) - 1) < 1e-12 and min(r.p) >= 0 and int(np.argmax(r.p)) == r.prediction for r in shares)
    right = sum(r.label == r.predicted_label for r in shares)
    forest = learning.classifier(train, names, "label", trees=12).transform(rest).where("label = predicted_label").count()
    assert right > forest and right > 200
    boosting.save(model, str(tmp_path / "boosted"))
    again = boosting.load(str(tmp_path / "boosted")).transform(rest)
    assert again.select("id", "probability", "predicted_label").collect() == got.select("id", "probability", "predicted_label").collect()
