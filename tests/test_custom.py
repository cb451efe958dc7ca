"""User functions under their guards."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidewater.functions import custom

POINTS = [(1.0, 2.0, -1.0), (0.0, 2.0, -1.0), (1.0, 2.0, 0.5), (None, 2.0, -1.0), (4.0, math.nan, -1.0), (1.0, 2.0, 0.0), (9.0, 9.0, None)]


def points(spark):
    return spark.createDataFrame([(k, *p) for k, p in enumerate(POINTS)], "k int, x double, y double, z double")


def values(spark, f):
    return [r.v for r in points(spark).select("k", f(F.col("x"), F.col("y"), F.col("z")).alias("v")).orderBy("k").collect()]


def test_column_field(spark):
    # null z: neither under nor above the surface, so the value counts
    assert values(spark, custom.field(lambda x, y, z: y + F.ln(x))) == [2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 9.0 + math.log(9.0)]


def test_batch_field_with_infinite_values(spark):
    assert values(spark, custom.batch_field(lambda x, y, z: y / x)) == [2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0]


def test_batch_that_raises_is_tried_point_by_point(spark):
    def picky(x, y, z):
        if (x == 0).any():
            raise ValueError("no such place")
        return x + y

    assert values(spark, custom.batch_field(picky)) == [3.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.0]


def test_a_constant_field(spark):
    assert values(spark, custom.batch_field(lambda x, y, z: 7.0)) == [7.0, 7.0, 0.0, 7.0, 7.0, 7.0, 0.0]


def test_currents(spark):
    flow = lambda x, y, z: (x, y * 2, z)
    rows = values(spark, custom.current(flow))
    assert tuple(rows[0]) == (1.0, 4.0, -1.0) and tuple(rows[2]) == (0.0, 0.0, 0.0) and tuple(rows[3]) == (0.0, 4.0, -1.0)
    rows = values(spark, custom.batch_current(lambda x, y, z: np.stack([x, y * 2, z])))
    assert tuple(rows[0]) == (1.0, 4.0, -1.0) and tuple(rows[3]) == (0.0, 0.0, 0.0) and tuple(rows[6]) == (0.0, 0.0, 0.0)


def test_samplers(spark):
    key = F.col("id")
    got = spark.range(4000).select(custom.action(key, 3, 1).alias("a"), custom.action(key, 2, 9, low=F.lit(-0.5), high=F.lit(0.5)).alias("b"), custom.discrete_action(key, 2, 5, -1, 2).alias("d")).collect()
    a = np.array([r.a for r in got])
    assert a.shape == (4000, 3) and np.abs(a.mean(0)).max() < 0.06 and np.abs(a.std(0) - 1).max() < 0.05 and np.abs(np.corrcoef(a.T) - np.eye(3)).max() < 0.06
    assert np.abs([r.b for r in got]).max() == 0.5
    assert {v for r in got for v in r.d} == {-1, 0, 1}
