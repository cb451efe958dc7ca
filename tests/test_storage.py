"""Settled tables are read whole, and go when asked."""

import os

from tidewater import storage


def test_settle_and_drop(spark):
    df = spark.range(10).selectExpr("id", "nullif(id, 3) AS v")
    kept = storage.settle(df)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, df.collect())) and kept.dtypes == df.dtypes
    folder = storage.shared_dir(spark).removeprefix("file://")
    mine = f"tidewater-{spark.sparkContext.applicationId}-"
    assert any(f.startswith(mine) for f in os.listdir(folder))
    storage.drop_all_settled(spark)
    assert not any(f.startswith(mine) for f in os.listdir(folder))
