from pyspark.sql import functions as F

from tidewater.llm import common


def test_least_of_hot_and_cold_groups(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), ((F.col("id") * 7919) % 6007).alias("v"))
    got = {(r.k, r.v): r.least for r in common.with_least(rows, ["k"], "v", "least").collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r.k, []).append(r.v)
    assert got == {(k, v): min(vs) for k, vs in by.items() for v in vs}
    assert common.with_least(rows.where("false"), ["k"], "v", "least").collect() == []


def test_near_and_without_keys(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("x")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L"))
    keys = spark.range(0, 1000, 10).select(F.col("id").alias("key"))
    near = {r.id for r in common.near_keys(rows, "id", keys).collect()}
    assert set(range(0, 1000, 10)) <= near and len(near) < 300
    rest = [r.id for r in common.without_keys(rows, "id", keys).collect()]
    assert sorted(rest, key=str) == sorted([None, *(i for i in range(1000) if i % 10)], key=str)
    assert common.without_keys(rows, "id", keys.where("false")).count() == 1001


def test_few_rows_are_joined_without_salts(spark):
    from tidewater.llm.common import spread_join

    rows, other = spark.range(40).selectExpr("id % 4 AS k", "id AS v"), spark.range(4).selectExpr("id AS k", "id * 2 AS w")
    few, many = (spread_join(rows, other, "k", "v", n) for n in (40, 2000))
    assert sorted(few.collect()) == sorted(many.collect()) and few.columns == many.columns
    assert "__salt" not in few._jdf.queryExecution().toString() and "__salt" in many._jdf.queryExecution().toString()
