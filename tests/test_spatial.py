"""Places and running sums in order, nearest neighbours and views by trees of boxes, octrees; against brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import vehicle
from tidewater.operators import matching, ordering, spatial
from tidewater.sources import octree


def test_places_of_nulls_ties_and_clashing_names(spark):
    rows = [(g, draw) for g in (None, 1, 1, 2) for draw in (3, 1, None, 1)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5).withColumns({c: F.lit(0) for c in ("place", "size", "n")})
    got = ordering.places(df, "g", ["v"]).collect()
    for g, n in ((None, 4), (1, 8), (2, 4)):
        mine = sorted((r["__place"], r.v) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(n)) and [v for _, v in mine] == sorted((v for _, v in mine), key=lambda v: (v is not None, v or 0))
        assert {r["__size"] for r in got if r.g == g} == {n}
    assert ordering.places(df.limit(0), "g", ["v"]).collect() == []


def test_running_sums_equal_the_plain_window_and_spread_a_long_run(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.when(F.col("id") < 3500, 1).otherwise(F.col("id") % 7).alias("run"), "id", F.when(F.col("id") % 50 > 0, F.sin("id")).alias("a"))
        got = ordering.running_sums(df, "run", ["id"], {"v": F.col("a") * 0.5}, {"v": "p"})
        w = Window.partitionBy("run").orderBy("id")
        want = df.withColumn("v", F.sum(F.coalesce(F.col("a") * 0.5, F.lit(0.0))).over(w)).withColumn("p", F.sum("v").over(w))
        assert got.columns == want.columns
        pairs = {r.id: (r.v, r.p) for r in got.collect()}
        assert all(pairs[r.id] == pytest.approx((r.v, r.p), abs=1e-8) for r in want.collect()) and len(pairs) == 4000
        # the run that holds nearly all rows lies in several partitions
        parts = ordering.in_parts(df, "run", ["id"]).where("run = 1").select(ordering.part()).distinct().count()
        assert parts > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def places_and_probes(seed):
    draw = random.Random(seed)
    spots = [(0, 0, 0), (100, 3, 5), (-40, 2, 2)]
    point = lambda: tuple(draw.choice([x + draw.gauss(0, 3), float(round(x))]) for x in draw.choice(spots))
    places = [(i, draw.choice([1, 1, 1, 2, 3]), *point()) for i in range(4000)] + [(9999, None, 1.0, 1.0, 1.0), (9998, 2, math.nan, 1.0, 1.0), (9997, 5, 1.0, 1.0, 1.0), (9996, 2, None, 0.0, 0.0)]
    probes = [(i, draw.choice([1, 1, 2, 3, 4, 5, None]), *point()) for i in range(120)] + [(500, 1, None, 0.0, 0.0), (0, 1, 0.0, 0.0, 0.0)]
    return places, probes


def test_nearest_in_class_equals_brute_force(spark):
    places, probes = places_and_probes(3)
    axes = "x double, y double, z double"
    got = matching.nearest_in_class(spark.createDataFrame(probes, f"vec_id long, label int, {axes}"), spark.createDataFrame(places, f"id long, label int, {axes}"), "label", ["x", "y", "z"], "vec_id", "id")
    assert got.columns == ["vec_id", "label", "x", "y", "z", "distance", "nearest_id", "nearest_x", "nearest_y", "nearest_z"]
    found = sorted((repr((r.vec_id, r.label, r.x)), r.distance, r.nearest_id) for r in got.collect())
    want = []
    for i, label, *at in probes:
        # a probe without coordinates, or whose class is not there, finds nothing
        near = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(at, p))), j) for j, c, *p in places if label is not None and c == label and None not in at and None not in p and not any(map(math.isnan, p))]
        want.append((repr((i, label, at[0])), *(min(near) if near else (None, None))))
    assert found == sorted(want)


def test_nearest_with_one_crowded_spot(spark):
    """Thousands of places at one spot count as one; no join on the class alone."""
    places = spark.range(5000).select("id", F.lit("a").alias("label"), F.when(F.col("id") < 4900, 0.0).otherwise(F.col("id").cast("double")).alias("x"), F.lit(0.0).alias("y"))
    probes = spark.createDataFrame([(1, "a", 0.0, 1.0), (2, "a", 4950.2, 0.0)], "p long, label string, x double, y double")
    got = matching.nearest_in_class(probes, places, "label", ["x", "y"], "p", "id")
    assert {r.p: r.nearest_id for r in got.collect()} == {1: 0, 2: 4950}
    assert matching.nearest_to([0.0, 1.0], places, ["x", "y"], "id").first().nearest_id == 0
    assert matching.nearest_to([0.0, 1.0], places.limit(0), ["x", "y"], "id").collect() == []


def test_views_equal_brute_force(spark):
    draw = random.Random(7)
    points = [(i, *(draw.uniform(-20, 20) for _ in range(3))) for i in range(3000)]
    sensors = [(k, draw.uniform(-20, 20), draw.uniform(-20, 20), 0.0, draw.uniform(-1, 1), draw.uniform(-3, 3), 1.0, draw.choice([5.0, 30.0])) for k in range(25)]
    tree = spatial.packed(spark.createDataFrame(points, "id long, x double, y double, z double").withColumn("w", F.lit(1)), "w", ["x", "y", "z"])
    s = spark.createDataFrame(sensors, "k long, sx double, sy double, sz double, pitch double, yaw double, low double, high double")
    pose = vehicle.rotation_matrix(F.lit(0.0), F.col("pitch"), F.col("yaw"))
    got = spatial.in_view(s, tree, F.lit(1), ["sx", "sy", "sz"], pose, ("low", "high"), lambda s, off: off < 25, F.lit(25.0), [F.lit(v) for v in (1.0, 0.0, 0.0)])
    want = set()
    for k, sx, sy, sz, p, w, low, high in sensors:
        ahead = (math.cos(w) * math.cos(p), math.sin(w) * math.cos(p), -math.sin(p))
        for i, x, y, z in points:
            d = (x - sx, y - sy, z - sz)
            far = math.sqrt(sum(v * v for v in d))
            if low < far < high and math.degrees(math.acos(sum(a * b for a, b in zip(d, ahead)) / far)) < 25:
                want.add((k, i))
    assert {(r.k, r.id) for r in got.collect()} == want and len(want) > 500


def test_a_tree_of_nothing(spark):
    none = spark.createDataFrame([], "id long, label int, x double, y double")
    probes = spark.createDataFrame([(1, 1, 0.0, 0.0)], "p long, label int, x double, y double")
    assert [r.nearest_id for r in matching.nearest_in_class(probes, none, "label", ["x", "y"], "p", "id").collect()] == [None]


def test_octree_is_read_in_one_scan(spark, tmp_path):
    def grown(depth, at=0.0):
        return {"p": [at, depth, 0], "l": [grown(depth - 1, at + k) for k in range(2)]} if depth else {"p": [at, 0, 0], "n": [0, 0, 1], "m": "mud"}

    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps(grown(6, 100.0 * k)))
    leaves = octree.leaves_of(spark, str(tmp_path), 64.0)
    rows = leaves.collect()
    assert len(rows) == 3 * 2**6 and {r.size for r in rows} == {1.0} and {r.material for r in rows} == {"mud"}
    assert leaves._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    texts = spark.createDataFrame([(1, None), (2, "{}"), (3, '{"l": []}')], "id long, tree string")
    assert sorted((r.id, r.level, r.leaf, r.x) for r in octree.opened(texts, "tree", 8.0).collect()) == [(2, 0, True, None), (3, 0, True, None)]


def test_octrees_hold_nothing_in_memory_and_lose_no_level(spark):
    tree = {"p": [0, 0, 0], "m": "deep"}
    for k in range(1, 12):
        tree = {"p": [k, 0, 0], "l": [tree, {"p": [k, 1, 0]}, None, 5]}
    texts = spark.createDataFrame([(1, json.dumps(tree)), (2, '{"p": [1, 2, 3], "m": "flat"}')], "id long, tree string")
    nodes = octree.opened(texts, "tree", 8.0)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "UnionLoop" not in plan and "CTE" not in plan
    rows = nodes.where("id = 1").collect()
    assert len(rows) == 1 + 11 * 4 and [(r.level, r.size) for r in rows if r.material == "deep"] == [(11, 8.0 / 2**11)]
    assert [(r.level, r.x, r.leaf) for r in nodes.where("id = 2").collect()] == [(0, 1.0, True)]
    with pytest.raises(ValueError):
        octree.opened(texts, "tree", 8.0, 5)


def test_octree_store_round_trip_and_counts(spark, tmp_path):
    draw = random.Random(1)
    points = spark.createDataFrame([(draw.uniform(-1, 9), draw.uniform(0, 8), draw.uniform(0, 8)) for _ in range(500)] + [(None, 1.0, 1.0)], "x double, y double, z double")
    coded = points.withColumn("code", octree.cell_code([F.col(c) for c in "xyz"], [0.0, 0.0, 0.0], 8.0, 4)).where("code IS NOT NULL")
    assert 300 < coded.count() < 500
    path = str(tmp_path / "tree")
    octree.store(coded, path, "code", 4, 1)
    back = octree.load(spark, path)
    assert sorted(map(tuple, back.select("x", "y", "z", "code").collect())) == sorted(map(tuple, coded.collect()))
    part = octree.load(spark, path, 2, 3)
    assert {r.cell for r in part.select("cell").distinct().collect()} == {2, 3}
    assert "PartitionFilters: [isnotnull(cell" in part._jdf.queryExecution().executedPlan().toString()
    codes = {r.code for r in coded.collect()}
    want = {c: (sum(len({x >> 3 * k for x in codes if x >> 9 == c}) for k in range(4)), len({x for x in codes if x >> 9 == c})) for c in {x >> 9 for x in codes}}
    assert {r.cell: (r.nodes, r.leaves) for r in octree.node_counts(coded, "code", 4, 1).collect()} == want


def test_points_are_ordered_only_at_the_least_distance(spark, monkeypatch):
    """The bound that lets points through to the last, sorting step is the nearest distance itself, also for far probes."""
    draw = random.Random(11)
    places = [(i, 1, x, x * draw.uniform(0.9, 2.0)) for i, x in enumerate(draw.uniform(1, 50) for _ in range(3000))]
    probes = [(k, 1, draw.uniform(0, 50), draw.uniform(0, 100)) for k in range(60)]
    frames, settle = [], spatial.settle
    monkeypatch.setattr(spatial, "settle", lambda df: frames.append(settle(df)) or frames[-1])
    got = matching.nearest_in_class(spark.createDataFrame(probes, "p long, label int, x double, y double"), spark.createDataFrame(places, "id long, label int, x double, y double"), "label", ["x", "y"], "p", "id")
    want = {k: min(math.sqrt((x - a) * (x - a) + (y - b) * (y - b)) for _, _, a, b in places) for k, _, x, y in probes}
    assert {r.p: r.distance for r in got.collect()} == want
    assert {r.p: r["__bound"] for r in [f for f in frames if "__bound" in f.columns][-1].collect()} == want


def test_points_at_one_spot_are_seen_once_and_given_back_whole(spark):
    points = spark.range(3000).select("id", F.when(F.col("id") < 1000, 3.0).when(F.col("id") < 1010, None).otherwise(F.col("id") % 10).cast("double").alias("x"), F.lit(0.5).alias("y"), F.lit(0.0).alias("z"), F.lit(1).alias("w"))
    spots = spatial.folded(points, "w", ["x", "y", "z"], 256)
    rows = spots.collect()
    assert sorted(c.id for r in rows for c in r["__copies"]) == list(range(3000))
    # the crowded spot (1,199 points) lies in several lists, all others in one
    assert 11 < len(rows) <= 10 + 1 + 4 and max(len(r["__copies"]) for r in rows) < 400
    s = spark.createDataFrame([(0.0, 0.0, 0.0, 0.1, 20.0)], "sx double, sy double, sz double, low double, high double")
    pose = vehicle.rotation_matrix(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    got = spatial.in_view(s, spatial.packed(spots, "w", ["x", "y", "z"]), F.lit(1), ["sx", "sy", "sz"], pose, ("low", "high"), lambda s, off: off < 12, F.lit(12.0), [F.lit(v) for v in (1.0, 0.0, 0.0)])
    assert {r.x for r in got.collect()} == {float(k) for k in range(3, 10)}
    assert sorted(r.id for r in got.select(F.inline("__copies")).collect()) == sorted(r.id for r in points.where("x > 2").collect())


def test_views_move_sensors_only_to_their_leaves(spark, monkeypatch):
    """Whatever Spark broadcasts of itself: levels of few boxes need no shuffle, and no rotation is shuffled with a leaf."""
    draw = random.Random(5)
    points = spark.createDataFrame([(i, 1, *(draw.uniform(-20, 20) for _ in range(3))) for i in range(3000)], "id long, w int, x double, y double, z double")
    s = spark.createDataFrame([(k, draw.uniform(-20, 20), 1.0, 2.0, draw.uniform(-1, 1), draw.uniform(-3, 3), 0.1, 9.0) for k in range(30)], "k long, sx double, sy double, sz double, pitch double, yaw double, low double, high double")
    pose = vehicle.rotation_matrix(F.lit(0.0), F.col("pitch"), F.col("yaw"))
    look = lambda by: spatial.in_view(s, spatial.packed(points, "w", ["x", "y", "z"]), by, ["sx", "sy", "sz"], pose, ("low", "high"), lambda s, off: off < 25, F.lit(25.0), [F.lit(v) for v in (1.0, 0.0, 0.0)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = {}
        for name, by, few in (("one", None, 1 << 12), ("many", F.lit(1), 1 << 12), ("moved", F.lit(1), 0)):
            monkeypatch.setattr(spatial, "FEW", few)
            got = look(by)
            plan = got._jdf.queryExecution().executedPlan().toString()
            seen[name] = {(r.k, r.id) for r in got.collect()}
            if few:  # the points, and the offsets of their places
                assert plan.count("SortMergeJoin") == 2
        assert seen["one"] == seen["many"] == seen["moved"] and len(seen["one"]) > 20
        assert spatial.folded(points, "w", ["x", "y", "z"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spots_of_full_cells_are_dealt_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HEAP", 100)
    monkeypatch.setattr(spatial, "CELLS", 4)
    points = spark.range(2000).select("id", F.lit(1).alias("w"), F.when(F.col("id") < 1500, 1.0).when(F.col("id") < 1520, None).otherwise(F.col("id") % 7).cast("double").alias("x"))
    rows = spatial.folded(points, "w", ["x"], 64).collect()
    assert sorted(c.id for r in rows for c in r["__copies"]) == list(range(2000)) and max(len(r["__copies"]) for r in rows) <= 64
    assert all(c.id < 1500 or c.id % 7 == 1 for r in rows if r.x == 1.0 for c in r["__copies"])


def test_few_leaves_are_opened_for_probes_beside_the_points(spark, monkeypatch):
    """Far from all points a first guess at the nearest one reaches over many leaves; only few of them are to be moved."""
    draw = random.Random(2)
    places = [(i, 1, x, x * draw.uniform(0.9, 2.0), float(-draw.randrange(11))) for i, x in enumerate(draw.uniform(1, 50) for _ in range(20000))]
    probes = [(k, 1, float(draw.randrange(50)), draw.uniform(0, 100), draw.uniform(-10, 0)) for k in range(60)]
    opened, descend = [], spatial.descend
    monkeypatch.setattr(spatial, "descend", lambda *a, **k: opened.append(descend(*a, **k)) or opened[-1])
    axes = "x double, y double, z double"
    got = matching.nearest_in_class(spark.createDataFrame(probes, f"p long, label int, {axes}"), spark.createDataFrame(places, f"id long, label int, {axes}"), "label", ["x", "y", "z"], "p", "id")
    want = {k: min((math.sqrt(sum((a - b) ** 2 for a, b in zip(at, p))), i) for i, _, *p in places) for k, _, *at in probes}
    assert {r.p: r.nearest_id for r in got.collect()} == {k: i for k, (_, i) in want.items()}
    moved = [d.count() for d in opened if "__near" not in d.columns]
    assert max(moved) < 15 * len(probes), moved
