import json

from pyspark.sql import functions as F

from tidewater.operators import matching, navigation
from tidewater.sources import octree, readers, sinks
from tidewater.streaming import stateful


def test_csv_round_trip_and_cleaning(spark, tmp_path):
    folder = tmp_path / "maps"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y,z,obstacle_type\n1,2,3,rock\nx,y,z,obstacle_type\nbad,2,3,rock\n4,5,6,\n")
    (folder / "b.csv").write_text("x,y,z,obstacle_type\n7,8,9,wreck\nNaN,8,9,wreck\n")
    raw = readers.dirty_csv(spark, str(folder), ["x", "y", "z", "obstacle_type"])
    got = matching.cleaned(raw, ["x", "y", "z"], "obstacle_type").collect()
    assert sorted((r.x, r.obstacle_type, r.file) for r in got) == [(1.0, "rock", "a.csv"), (7.0, "wreck", "b.csv")]
    points = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, None)], readers.MAP_LOG)
    sinks.csv_log(points, str(tmp_path / "log"))
    sinks.csv_log(points, str(tmp_path / "log"))
    assert readers.csv_log(spark, str(tmp_path / "log"), readers.MAP_LOG).count() == 4
    sinks.by_ping(points.withColumn("step", F.col("x").cast("int")), str(tmp_path / "pings"), "step")
    assert {p.name for p in (tmp_path / "pings").glob("step=*")} == {"step=1", "step=4"}
    where = sinks.predictions(points, str(tmp_path), "m.csv", "x", 2.0)
    assert spark.read.csv(where, header=True).count() == 1


def test_scenarios(spark, tmp_path):
    body = {"name": "s", "world": "w", "ticks_per_sec": 30, "agents": [{"agent_name": "auv0", "sensors": [{"sensor_type": "IMUSensor", "Hz": 15, "configuration": {"ReturnBias": "true"}}, {"sensor_type": "DVLSensor", "sensor_name": "dvl", "Hz": 20}, {"sensor_type": "GPSSensor"}, {"sensor_type": "X", "Hz": 60}]}]}
    (tmp_path / "s.json").write_text(json.dumps(body, indent=1))
    got = {r.sensor_name: r for r in readers.sensors_of(readers.scenarios(spark, str(tmp_path / "s.json"))).collect()}
    assert {k: r.tick_every for k, r in got.items()} == {"IMUSensor": 2, "dvl": 1, "GPSSensor": 1, "X": None}
    both = readers.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert spark.range(1).select(both.alias("m")).first().m == {"a": "1", "b": "3"}


def test_octree_and_materials(spark, tmp_path):
    tree = {"p": [0, 0, 0], "l": [{"p": [1, 1, 1], "n": [0, 0, 1], "m": "sand"}, {"p": [-1, -1, -1], "l": [{"p": [-1.5, -1, -1], "m": "steel"}]}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    leaves = sorted((r.x, r.size, r.material) for r in octree.leaves_of(spark, str(tmp_path / "t.json"), 8.0, 5).collect())
    assert leaves == [(-1.5, 2.0, "steel"), (1.0, 4.0, "sand")]
    (tmp_path / "m.csv").write_text("Material,density,speed\nsand,2000,1700\n")
    known = readers.materials(spark, str(tmp_path / "m.csv"))
    assert known.first().impedance == 3.4e6
    rows = spark.createDataFrame([("sand",), ("steel",), (None,)], "m string")
    assert [r.material for r in sinks.missing_materials(rows, known, "m").collect()] == ["steel"]


def test_messages(spark):
    rows = spark.createDataFrame([(45, 1.5)], "tick int, depth double")
    assert tuple(sinks.messages(rows, "d", "tick", 30).first()) == ("d", 1500, '{"depth":1.5}')


def streamed(spark, df, tmp_path, run, parts=3):
    """Feeds df in tick order, batch by batch, and gives back what the stream wrote."""
    top = df.agg(F.max("tick")).first()[0]
    for k in range(parts):
        df.where((F.col("tick") > top * k // parts) & (F.col("tick") <= top * (k + 1) // parts)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_streamed_filter_equals_batch(spark, tmp_path):
    df = spark.range(120).select((F.col("id") % 3).alias("agent"), F.floor(F.col("id") / 3 + 1).alias("tick"), F.sin("id").alias("a"), F.cos("id").alias("z"))
    want = {(r.agent, r.tick): r.x for r in navigation.kalman(df, "agent", ["tick"], "a", "z", 0.5).collect()}
    got = {(r.agent, r.tick): r.x for r in streamed(spark, df, tmp_path, lambda s: stateful.kalman(s, "agent", "tick", "a", "z", 0.5)).collect()}
    assert got == want


def test_streamed_waypoints(spark, tmp_path):
    df = spark.range(1, 13).select(F.lit(1).alias("agent"), F.col("id").alias("tick"), F.col("id").cast("double").alias("v"))
    got = streamed(spark, df, tmp_path, lambda s: stateful.waypoints(s, "agent", "tick", "v", [3.0, 7.0, 10.0], 0.5)).collect()
    assert sorted((r.tick, r.waypoint) for r in got) == [(1, 0), (2, 0), (4, 1), (5, 1), (6, 1), (8, 2), (9, 2)]


def test_windowed_means(spark, tmp_path):
    df = spark.range(1, 13).select(F.col("id").alias("tick"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.lit("click").alias("sensor"), F.col("id").cast("double").alias("value"))
    got = streamed(spark, df, tmp_path, lambda s: stateful.windowed_means(s, "ts", "sensor", "value", "5 minutes", "0 seconds")).collect()
    assert {r["mean"] for r in got} >= {2.5, 7.0}
