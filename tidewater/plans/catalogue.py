"""Named queries over the driver's tables, with their SQL twins.  The docstring names the inventory ids that a query covers.

Roles: `events` are telemetry (agent = user_id, sensor = event_type, tick = row number by time), `embeddings` are
sonar profiles of 64 range bins, `lineitem` is a point cloud (x = quantity, y = price / 1000, z = -100 * discount, ring =
line number), `part` holds materials and `supplier` beacons.
"""

from __future__ import annotations

from math import floor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import custom, fields, geometry, noise, profiles, vehicle
from tidewater.operators import attitude, boosting, comms, control, gaussian, guidance, learning, lidar, matching, navigation, ordering, rewards, runs, sampling, sonar, spatial, voxels
from tidewater.sources import octree, readers, sinks
from tidewater.storage import fresh_path

FLAGSHIP = "sonar_argmax_depth"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """agent, sensor, tick, ts (microseconds), value, event_id."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("agent"), F.col("event_type").alias("sensor"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "value", "event_id")
    return sampling.with_tick(e, "agent", ["ts", "event_id"])


TICKS = "t AS (SELECT user_id AS agent, event_type AS sensor, epoch_us(ts) AS ts, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tick FROM events)"


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * -100).alias("z"), "l_tax", "l_returnflag")


CLOUD = "c AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * -100 AS z, l_tax, l_returnflag FROM lineitem)"


def xyz():
    return F.col("x"), F.col("y"), F.col("z")


KEYED = "l_orderkey || '-' || l_linenumber"


def u_sql(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT / 4294967296.0)"


KEY = ["l_orderkey", "l_linenumber"]
CLUSTERS = [(10.0, 10.0, -10.0, 2.0, 10.0), (30.0, 40.0, -5.0, 1.5, 20.0), (0.0, 0.0, 0.0, 9.0, 0.0)]
NEAR = " + ".join(f"{s} * exp(-sqrt((x - {a}) * (x - {a}) + (y - {b}) * (y - {b}) + (z - {c}) * (z - {c})) / {f})" for a, b, c, s, f in CLUSTERS if f > 0)


# --- sonar profiles -------------------------------------------------------------------------------------------------


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS bin, round(0.5 + (list_position(embedding, list_max(embedding)) - 1) * (99.5 / 63), 6) AS range_m FROM embeddings")
def sonar_argmax_depth(spark, sf):
    """AGG-6, PRJ-12: the strongest bin of each ping and its range."""
    p = table(spark, sf, "embeddings").select("vec_id", profiles.strongest_bin(F.col("embedding")).alias("bin"))
    return p.select("vec_id", "bin", r6(profiles.axis(0.5, 100.0, 64, F.col("bin")), "range_m"))


LEVELS = """l AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS bin, list_min(embedding) AS lo, list_max(embedding) AS hi FROM embeddings),
n AS (SELECT vec_id, CAST(bin AS INTEGER) AS bin, CASE WHEN hi > lo THEN (CAST(v AS DOUBLE) - lo) / (CAST(hi AS DOUBLE) - lo) ELSE 0.0 END AS level FROM l)"""


@query(f"WITH {LEVELS} SELECT vec_id, bin, round(level, 6) AS level, CAST(floor(level * 255) AS INTEGER) AS grey FROM n")
def sonar_normalise(spark, sf):
    """PRJ-10, PRJ-11: profiles scaled to [0, 1] and to 8 bits."""
    p = table(spark, sf, "embeddings").select("vec_id", profiles.normalised(F.col("embedding")).alias("p"))
    return p.select("vec_id", F.posexplode("p").alias("bin", "v")).select("vec_id", "bin", r6(F.col("v"), "level"), F.floor(F.col("v") * 255).cast("int").alias("grey"))


POINTS = f"""p AS (SELECT vec_id, bin, 0.5 + bin * (99.5 / 63) AS r, -pi() / 4 + bin * ((pi() / 4 + pi() / 4) / 63) AS th FROM n WHERE floor(level * 255) > 200)"""


@query(f"WITH {LEVELS}, {POINTS} SELECT vec_id, bin, round(r * sin(th), 6) AS y, round(-r * cos(th), 6) AS z FROM p")
def sonar_threshold_points(spark, sf):
    """FLT-4, PRJ-13, PRJ-14: bright bins as local points."""
    got = sonar.bright_bins(table(spark, sf, "embeddings"), "embedding", "vec_id", 200, 0.5, 100.0, 64)
    return got.select("vec_id", "bin", r6(F.col("y"), "y"), r6(F.col("z"), "z"))


@query(f"WITH {LEVELS}, {POINTS} SELECT vec_id, round(avg(r * sin(th)), 6) AS y, round(avg(-r * cos(th)), 6) AS z, count(*) AS n FROM p GROUP BY vec_id")
def sonar_centroid(spark, sf):
    """AGG-5: mean of the bright points of each ping."""
    got = sonar.bright_bins(table(spark, sf, "embeddings"), "embedding", "vec_id", 200, 0.5, 100.0, 64)
    return got.groupBy("vec_id").agg(r6(F.avg("y"), "y"), r6(F.avg("z"), "z"), F.count("*").alias("n"))


@query(f"WITH {CLOUD}, b AS (SELECT l_returnflag AS ping, CAST(floor(sqrt(x*x + y*y + z*z) / 2.5) AS INTEGER) AS bin, l_tax FROM c), s AS (SELECT ping, bin, avg(l_tax) AS m, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 59 GROUP BY ping, bin) SELECT p.ping, CAST(g.bin AS INTEGER) AS bin, round(coalesce(m, 0.0), 6) AS mean, coalesce(n, 0) AS n FROM (SELECT DISTINCT ping FROM b) p CROSS JOIN (SELECT range AS bin FROM range(60)) g LEFT JOIN s ON s.ping = p.ping AND s.bin = g.bin")
def sonar_bin_average(spark, sf):
    """AGG-8: mean intensity of each range bin, empty ones included."""
    c = cloud(spark, sf).withColumnRenamed("l_returnflag", "ping")
    x, y, z = xyz()
    got = sonar.bin_average(c, ["ping"], F.floor(F.sqrt(x * x + y * y + z * z) / 2.5).cast("int"), "l_tax", 60)
    return got.select("ping", "bin", r6(F.col("mean"), "mean"), "n")


@query(f"WITH {CLOUD}, b AS (SELECT l_returnflag AS ping, CAST(least(floor(x), 49) AS INTEGER) AS r, l_linenumber > 3 AS star, l_tax FROM c) SELECT ping, CAST(CASE WHEN star THEN 25 - floor(r / 2) - 1 ELSE 25 + floor(r / 2) END AS INTEGER) AS idx, round(avg(l_tax), 6) AS mean, count(*) AS n FROM b GROUP BY 1, 2")
def sonar_sidescan_fold(spark, sf):
    """AGG-9: port and starboard folded to one axis."""
    c = cloud(spark, sf).withColumn("r", F.least(F.floor("x"), F.lit(49)))
    idx = sonar.folded_index(F.col("r"), F.col("l_linenumber") > 3, 50)
    return c.groupBy(F.col("l_returnflag").alias("ping"), idx.alias("idx")).agg(r6(F.avg("l_tax"), "mean"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_returnflag AS ping, CAST(floor(l_quantity / 2) AS INTEGER) AS r_bin, CAST(floor(l_extendedprice / 5000) AS INTEGER) AS a_bin, l_tax * 10 AS v, l_discount >= 0.095 AS perfect FROM lineitem),
g AS (SELECT ping, r_bin, a_bin, avg(v) AS mean, count(*) AS n, sum(CAST(perfect AS INTEGER)) AS p FROM b GROUP BY ALL),
w AS (SELECT *, sum(p) OVER (PARTITION BY ping, r_bin) / sum(n) OVER (PARTITION BY ping, r_bin) AS share FROM g)
SELECT ping, r_bin, a_bin, round(CASE WHEN share >= 0.08 THEN 1 - (1 - mean) * (1 - mean) ELSE mean END, 6) AS mean, n, round(share, 6) AS row_share FROM w""")
def sonar_image_histogram(spark, sf):
    """AGG-10, AGG-11, FN-19: range-azimuth image with streaks brightened."""
    b = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("ping"), F.floor(F.col("l_quantity") / 2).cast("int").alias("r_bin"), F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("a_bin"), (F.col("l_tax") * 10).alias("v"), (F.col("l_discount") >= 0.095).alias("perfect"))
    got = sonar.image(b, ["ping"], "v", "perfect", streaks=1)
    return got.select("ping", "r_bin", "a_bin", r6(F.col("mean"), "mean"), "n", r6(F.col("row_share"), "row_share"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity - lag(l_quantity) OVER w > 6 THEN 1 ELSE 0 END AS far FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber)),
b AS (SELECT *, sum(far) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS cut FROM a) SELECT l_orderkey, l_linenumber, l_quantity FROM b WHERE cut = 0""")
def sonar_occlusion_prefix(spark, sf):
    """WIN-6, SRT-1: what lies before the first gap in range."""
    return sonar.unoccluded(table(spark, sf, "lineitem").select(*KEY, "l_quantity"), ["l_orderkey"], "l_quantity", "l_linenumber", 6.0)


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 10) AS INTEGER) AS idx FROM lineitem), b AS (SELECT *, lag(idx) OVER (PARTITION BY l_orderkey ORDER BY idx, l_linenumber) AS before FROM a)
SELECT l_orderkey, l_linenumber, idx FROM b WHERE before IS NULL OR before <> idx""")
def sonar_run_starts(spark, sf):
    """WIN-7: the first row of each run of equal range indices."""
    rows = table(spark, sf, "lineitem").select(*KEY, F.floor(F.col("l_quantity") / 10).cast("int").alias("idx"))
    return sonar.run_starts(rows, ["l_orderkey"], ["idx", "l_linenumber"], "idx")


@query("""WITH m AS (SELECT p_brand, avg(p_retailprice) * 3 AS density, 1480.0 + avg(p_size) AS speed FROM part WHERE p_brand < 'Brand#4' GROUP BY p_brand), j AS (SELECT p_partkey, p_size, coalesce(density * speed, 1e8) AS z FROM part LEFT JOIN m USING (p_brand))
SELECT p_partkey, round(z, 3) AS impedance, round(((z - 1.48e6) / (z + 1.48e6)) * ((z - 1.48e6) / (z + 1.48e6)) * cos(p_size / 50.0), 6) AS strength FROM j""")
def sonar_echo_strength(spark, sf):
    """FN-11, JN-5, SRC-9, SNK-8: echo by material impedance, with a default for unknown materials."""
    part = table(spark, sf, "part")
    m = part.where("p_brand < 'Brand#4'").groupBy(F.col("p_brand").alias("material")).agg((F.avg("p_retailprice") * 3).alias("density"), (1480.0 + F.avg("p_size")).alias("sound_speed"))
    got = sonar.with_impedance(part, m, "p_brand")
    return got.select("p_partkey", F.round("impedance", 3).alias("impedance"), r6(geometry.echo_strength(F.col("impedance"), 1.48e6, F.cos(F.col("p_size") / 50.0)), "strength"))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id DESC LIMIT 100")
def sonar_waterfall(spark, sf):
    """WIN-5: the last 100 pings (a top-k)."""
    return sampling.waterfall(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 100)


SPH = "s AS (SELECT *, sqrt(x*x + y*y + z*z) AS r, degrees(atan2(-y, x)) AS az, degrees(atan2(sqrt(x*x + y*y), z)) AS el FROM c)"


@query(f"WITH {CLOUD}, {SPH} SELECT l_orderkey, l_linenumber, round(r, 6) AS r, round(az, 6) AS az, round(el, 6) AS el, round(r * sin(radians(el)) * cos(radians(az)), 6) AS back_x FROM s")
def geo_spherical(spark, sf):
    """FN-9, FN-10: spherical coordinates and back."""
    s = cloud(spark, sf).withColumn("s", geometry.spherical(*xyz()))
    back = geometry.cartesian(F.col("s.range"), F.col("s.azimuth"), F.col("s.elevation"))
    return s.select(*KEY, r6(F.col("s.range"), "r"), r6(F.col("s.azimuth"), "az"), r6(F.col("s.elevation"), "el"), r6(back["x"], "back_x"))


@query(f"WITH {CLOUD}, a AS (SELECT l_orderkey, l_linenumber, y - 50 AS y, x - 25 AS x, abs(y - 50) + 1e-10 AS h FROM c), b AS (SELECT *, CASE WHEN x < 0 THEN (x + h) / (h - x) ELSE (x - h) / (x + h) END AS q, CASE WHEN x < 0 THEN 3 * pi() / 4 ELSE pi() / 4 END AS o FROM a), d AS (SELECT *, (o + (0.1963::DOUBLE * q * q - 0.9817::DOUBLE) * q) * (180 / pi()) AS g FROM b) SELECT l_orderkey, l_linenumber, round(CASE WHEN y < 0 THEN -g ELSE g END, 6) AS angle FROM d")
def geo_atan2_approx(spark, sf):
    """FN-8: the cubic arctangent."""
    return cloud(spark, sf).select(*KEY, r6(geometry.atan2_approx(F.col("y") - 50, F.col("x") - 25), "angle"))


@query(f"WITH {CLOUD}, {SPH} SELECT l_orderkey, l_linenumber, round(r, 6) AS r FROM s WHERE r > 5 AND r < 40 AND az > -60 AND az < -20 AND el > 80 AND el < 120")
def geo_frustum(spark, sf):
    """FLT-8, JN-6: a range query over leaves, bounds first."""
    got = sonar.in_frustum(cloud(spark, sf), (5.0, 40.0), (-60.0, -20.0), (80.0, 120.0))
    return got.select(*KEY, r6(F.col("range"), "r"))


# --- sampling and alignment -----------------------------------------------------------------------------------------


@query(f"WITH {TICKS} SELECT agent, tick, sensor, value FROM t WHERE tick % 2 = 0")
def sampling_rate_filter(spark, sf):
    """FLT-5, STM-1: a 15 Hz sensor on a 30 Hz clock."""
    return sampling.rate_filter(ticks(spark, sf), 15, 30).select("agent", "tick", "sensor", "value")


SENSORS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id AS agent, date_trunc('hour', ts)::VARCHAR AS hour, " + ", ".join(f"round(avg(value) FILTER (event_type = '{s}'), 6) AS {s}" for s in SENSORS) + " FROM events GROUP BY 1, 2")
def align_tick_pivot(spark, sf):
    """JN-3, FLT-6: one row for each agent and hour, sensors as columns."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("agent"), F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("hour"), F.col("event_type").alias("sensor"), "value")
    got = sampling.align(e, ["agent", "hour"], "sensor", "value", SENSORS)
    return got.select("agent", "hour", *(r6(F.col(s), s) for s in SENSORS))


@query("WITH p AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT c.event_id, c.user_id AS agent, p.v AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts")
def align_asof_last(spark, sf):
    """JN-4, STM-24: clicks with the last purchase value at or before them."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("agent"), "ts", "value", "event_type")
    got = sampling.last_known(e.where("event_type = 'click'").select("event_id", "agent", "ts"), e.where("event_type = 'purchase'").select("agent", "ts", "value"), "agent", "ts", "value")
    return got.select("event_id", "agent", "last_value")


@query(f"WITH {TICKS}, b AS (SELECT *, lag(sensor) OVER (PARTITION BY agent ORDER BY tick) AS before FROM t) SELECT agent, tick, sensor FROM b WHERE before IS NULL OR before <> sensor")
def suppress_repeats(spark, sf):
    """STM-25: rows at which the sensor changes."""
    return sampling.changes(ticks(spark, sf), "agent", ["tick"], "sensor").select("agent", "tick", "sensor")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value FROM events WHERE value > 50")
def union_all(spark, sf):
    """SET-1, SET-3: two surveys one after the other."""
    e = table(spark, sf, "events")
    return e.where("event_type = 'click'").select("event_id", "value").unionByName(e.where("value > 50").select("event_id", "value"))


@query("SELECT min(c) AS next_id FROM (SELECT 1::BIGINT AS c UNION ALL SELECT s_suppkey + 1 FROM supplier WHERE s_suppkey >= 1) WHERE c NOT IN (SELECT s_suppkey FROM supplier)")
def next_free_id(spark, sf):
    """SET-2: the least id that no beacon uses."""
    used = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    # it is 1 or follows a used one
    after = spark.range(1, 2).union(used.where("id >= 1").select(F.col("id") + 1))
    return after.join(used, "id", "left_anti").agg(F.min("id").alias("next_id"))


@query("SELECT c_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS start_order, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS end_order, count(*) AS steps FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def path_ends(spark, sf):
    """SRT-2: first and last step of each run."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    at = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("c_custkey").agg(F.min_by("o_orderkey", at).alias("start_order"), F.max_by("o_orderkey", at).alias("end_order"), F.count("*").alias("steps"))


# --- survey files and matching --------------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_type AS label FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0")
def clean_map(spark, sf):
    """PRJ-3, FLT-2, FLT-3, SRC-2: header rows, text in number columns and missing labels go."""
    p = table(spark, sf, "part")
    dirty = p.select("p_partkey", F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE cast(p_size AS STRING) END").alias("x"), F.expr("CASE WHEN p_partkey % 11 = 0 THEN 'label' WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END").alias("label"))
    return matching.cleaned(dirty, ["x"], "label")


# probes: customers, with a class from 0 to 8; map: the cloud, with the line number, 1 to 7, as class
MAP = "m AS (SELECT l_orderkey * 8 + l_linenumber AS place, l_linenumber AS label, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * -100 AS z FROM lineitem)"
PROBES = "p AS (SELECT c_custkey, CAST(c_nationkey % 9 AS INTEGER) AS label, CAST(c_custkey % 50 AS DOUBLE) AS x, abs(c_acctbal) / 100 AS y, -0.1::DOUBLE * (c_custkey % 101) AS z FROM customer)"
SIDES = f"{MAP}, {PROBES}, d AS (SELECT p.*, m.place AS nid, m.x AS nx, m.y AS ny, m.z AS nz, sqrt((p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) + (p.z - m.z) * (p.z - m.z)) AS dist FROM p LEFT JOIN m ON p.label = m.label), n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, nid) = 1)"


def survey(spark, sf):
    return cloud(spark, sf).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), F.col("l_linenumber").alias("label"), "x", "y", "z")


def probes(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", (F.col("c_nationkey") % 9).cast("int").alias("label"), (F.col("c_custkey") % 50).cast("double").alias("x"), (F.abs("c_acctbal") / 100).alias("y"), (-0.1 * (F.col("c_custkey") % 101)).alias("z"))


def matched(spark, sf):
    return matching.nearest_in_class(probes(spark, sf), survey(spark, sf), "label", ["x", "y", "z"], "c_custkey", "place")


@query(f"WITH {SIDES} SELECT c_custkey, label, nid AS nearest_id, round(dist, 6) AS distance FROM n")
def match_class_nn(spark, sf):
    """JN-1, AGG-7: the nearest point of the map in a probe's class; classes that the map lacks give nulls."""
    return matched(spark, sf).select("c_custkey", "label", "nearest_id", r6(F.col("distance"), "distance"))


@query(f"WITH {MAP}, d AS (SELECT *, sqrt((25.0 - x) * (25.0 - x) + (40.0 - y) * (40.0 - y) + (-5.0 - z) * (-5.0 - z)) AS dist FROM m) SELECT place AS nearest_id, round(x, 6) AS nx, round(y, 6) AS ny, round(z, 6) AS nz, round(dist, 6) AS distance FROM d ORDER BY dist, place LIMIT 1")
def match_single_nn(spark, sf):
    """JN-2: the point of the map nearest to one place."""
    got = matching.nearest_to([25.0, 40.0, -5.0], survey(spark, sf), ["x", "y", "z"], "place")
    return got.select("nearest_id", *(r6(F.col(f"nearest_{c}"), f"n{c}") for c in "xyz"), r6(F.col("distance"), "distance"))


@query(f"WITH {SIDES}, e AS (SELECT *, 2.0::DOUBLE AS r, c_custkey / 500.0::DOUBLE AS th FROM n), g AS (SELECT *, ny - r * sin(th) AS cy, nz + r * cos(th) AS cz FROM e) SELECT c_custkey, round(cy, 6) AS calc_y, round(cz, 6) AS calc_z, round(((y + r * sin(th)) - cy) - ((z - r * cos(th)) - cz), 6) AS residual FROM g WHERE dist < 1.5")
def match_residual(spark, sf):
    """PRJ-8, PRJ-9, FLT-1: re-projection from the match, residual, and the distance filter."""
    m = matched(spark, sf).where("distance < 1.5").withColumn("r", F.lit(2.0)).withColumn("th", F.col("c_custkey") / 500.0)
    cy, cz = matching.reprojected(F.col("nearest_y"), F.col("nearest_z"), F.col("r"), F.col("th"))
    return m.select("c_custkey", r6(cy, "calc_y"), r6(cz, "calc_z"), r6(matching.residual(F.col("y"), F.col("z"), F.col("r"), F.col("th"), cy, cz), "residual"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(spark, sf):
    """AGG-1, AGG-2: frequency of each class."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def label_encode(spark, sf):
    """ML-1: codes by sorted label."""
    return learning.encoded_labels(table(spark, sf, "events").select("event_id", "event_type"), "event_type").select("event_id", "event_type", F.col("code").cast("long").alias("code"))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8::DOUBLE) AS train FROM embeddings")
def stratified_split(spark, sf):
    """SRT-6, SRT-4, SRT-5: 80 / 20 by label, in hash order."""
    return learning.stratified(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label", 0.8)


@query("""WITH g AS (SELECT label AS t, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS g FROM embeddings), k AS (SELECT DISTINCT t AS label FROM g UNION SELECT g FROM g),
s AS (SELECT label, (SELECT count(*) FROM g WHERE t = label AND g = label) AS hits, (SELECT count(*) FROM g WHERE t = label) AS support, (SELECT count(*) FROM g WHERE g = label) AS guessed FROM k)
SELECT label, round(CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 6) AS recall, round(2.0 * hits / (support + guessed), 6) AS f1, support FROM s""")
def confusion_report(spark, sf):
    """AGG-18: precision, recall, F1 and support of each class."""
    e = table(spark, sf, "embeddings").select("label", F.expr("CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END").alias("guess"))
    return learning.report(e, "label", "guess").select("label", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"), r6(F.col("f1"), "f1"), "support")


# --- fields ---------------------------------------------------------------------------------------------------------


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round(CASE WHEN z > 0 THEN 0.0 ELSE 23.0 + (4.0 - 23.0) / (1 + exp(-(greatest(-z, 0.0) - 100.0) / 20.0)) + {NEAR} END, 6) AS value FROM c")
def field_temperature(spark, sf):
    """FN-1, AGG-15, FLT-18, FLT-19: temperature with a thermocline and clusters."""
    return cloud(spark, sf).select(*KEY, r6(fields.temperature(*xyz(), CLUSTERS), "value"))


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round(CASE WHEN z > 0 THEN 0.0 ELSE 33.0 + (34.5 - 33.0) / (1 + exp(-(greatest(-z, 0.0) - 100.0) / 20.0)) + {NEAR} END, 6) AS value FROM c")
def field_salinity(spark, sf):
    """FN-2: salinity with a halocline and clusters."""
    return cloud(spark, sf).select(*KEY, r6(fields.salinity(*xyz(), CLUSTERS), "value"))


BIO = "(1.2 + (1.0 - 1.2) * exp(-(greatest(-z, 1e-3) - 50.0) * (greatest(-z, 1e-3) - 50.0) / (2 * 25.0 * 25.0))) * (1 / (1 + exp((greatest(-z, 1e-3) - 200.0) / 20.0))) + 0.1 * (1 - 1 / (1 + exp((greatest(-z, 1e-3) - 200.0) / 20.0)))"


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round(CASE WHEN z > 0 THEN 0.0 ELSE {BIO} + {NEAR} END, 6) AS value FROM c")
def field_biomass(spark, sf):
    """FN-3: biomass with a peak layer and a deep constant."""
    return cloud(spark, sf).select(*KEY, r6(fields.biomass(*xyz(), CLUSTERS), "value"))


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round(CASE WHEN z > 0 THEN 0.0 ELSE {BIO} END, 6) AS biomass, 35.0::DOUBLE AS salinity, round(CASE WHEN z > 0 THEN 0.0 ELSE 23.0 + (4.0 - 23.0) / (1 + exp(-(greatest(-z, 0.0) - 100.0) / 20.0)) END, 6) AS temperature FROM c")
def field_bst(spark, sf):
    """FN-4: the triple, with a fallback for a missing field."""
    b = cloud(spark, sf).select(*KEY, fields.bst(fields.biomass(*xyz()), F.lit(None).cast("double"), fields.temperature(*xyz())).alias("b"))
    return b.select(*KEY, r6(F.col("b.biomass"), "biomass"), F.col("b.salinity").alias("salinity"), r6(F.col("b.temperature"), "temperature"))


@query(f"WITH {TICKS} SELECT agent, tick, round(2.5 * sin(2 * pi() / 240.0 * tick), 6) AS height FROM t")
def field_tide(spark, sf):
    """FN-5: tide height by tick."""
    return ticks(spark, sf).select("agent", "tick", r6(fields.tide_height(F.col("tick"), 2.5, 240.0), "height"))


@query(f"WITH {TICKS} SELECT agent, tick, round((tick % 50) / 50.0::DOUBLE * 24, 6) AS hour FROM t")
def field_time_of_day(spark, sf):
    """FN-6: hour of the simulated day."""
    return ticks(spark, sf).select("agent", "tick", r6(fields.time_of_day(F.col("tick"), 50.0), "hour"))


@query("WITH b AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(a + i * ((b - a) / 19), 6) AS x, round(c + j * ((d - c) / 19), 6) AS y FROM b, range(20) p(i), range(20) q(j)")
def grid_mesh(spark, sf):
    """SRC-12, SRC-14, AGG-3: a grid over the bounds of the points."""
    lo = table(spark, sf, "lineitem").agg(F.min("l_quantity"), F.max("l_quantity"), F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return readers.mesh(spark, (lo[0], lo[1], 20), (lo[2], lo[3], 20)).select("i", "j", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


_LATTICE = "e AS (SELECT floor(min(x)) AS x0, floor(min(y)) AS y0, floor(min(z)) AS z0, CAST(floor((max(x) - floor(min(x))) / 6) AS BIGINT) AS nx, CAST(floor((max(y) - floor(min(y))) / 6) AS BIGINT) AS ny, CAST(floor((max(z) - floor(min(z))) / 6) AS BIGINT) AS nz FROM c)"


@query(f"WITH {CLOUD}, {_LATTICE} SELECT x0 + 6.0 * i AS x, y0 + 6.0 * j AS y, z0 + 6.0 * k AS z FROM e, range(0, 1000) a(i), range(0, 1000) b(j), range(0, 100) d(k) WHERE i <= nx AND j <= ny AND k <= nz")
def grid_lattice(spark, sf):
    """SRC-13: every third cell, two metres wide, of the box that the cloud fills."""
    x, y, z = xyz()
    ends = cloud(spark, sf).agg(*(f(c) for c in (x, y, z) for f in (F.min, F.max))).first()
    box = [(float(floor(lo)), float(hi)) for lo, hi in zip(ends[::2], ends[1::2])]
    return readers.lattice(spark, box, 2.0, 3)


@query("SELECT l_orderkey, l_linenumber, round((l_suppkey % 256 + (l_partkey % 256) * 256 + (l_orderkey % 256) * 65536) / 16777215.0::DOUBLE * 1000, 6) AS depth FROM lineitem")
def depth_decode(spark, sf):
    """FN-7: metres from three bytes."""
    return table(spark, sf, "lineitem").select(*KEY, r6(fields.decoded_depth(F.col("l_suppkey") % 256, F.col("l_partkey") % 256, F.col("l_orderkey") % 256), "depth"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS scaled FROM lineitem")
def feature_scale(spark, sf):
    """FN-51, AGG-4: z-scores with the population deviation."""
    return learning.scaled(table(spark, sf, "lineitem").select(*KEY, "l_quantity"), ["l_quantity"]).select(*KEY, r6(F.col("l_quantity_scaled"), "scaled"))


CENTRES = [(0.02 * (k % 10) - 0.1, 0.04 * (k // 10) - 0.08) for k in range(50)]
ALPHA = [((k * 7) % 11 - 5) / 10 for k in range(50)]


@query("WITH z(a, b, w) AS (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {w!r}::DOUBLE)" for (a, b), w in zip(CENTRES, ALPHA)) + ") SELECT vec_id, round(sum(w * 1.3 * exp(-0.5 * ((embedding[1]::DOUBLE - a) * (embedding[1]::DOUBLE - a) + (embedding[2]::DOUBLE - b) * (embedding[2]::DOUBLE - b)) / (0.2::DOUBLE * 0.2::DOUBLE))), 6) AS mean FROM embeddings, z GROUP BY vec_id")
def gp_predict(spark, sf):
    """FN-50, ML-6, ML-7: the mean of a sparse Gaussian process with given weights."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return e.select("vec_id", r6(learning.gp_predict(e, ["a", "b"], CENTRES, ALPHA, 1.3, 0.2), "mean"))


# --- kinematics and control -----------------------------------------------------------------------------------------


@query(f"WITH {TICKS}, d AS (SELECT *, ts / 1e6 - lag(ts / 1e6) OVER w AS dt, value - lag(value) OVER w AS dv FROM t WINDOW w AS (PARTITION BY agent ORDER BY tick)) SELECT agent, tick, round(CASE WHEN dt > 0 THEN dv / dt ELSE 0.0 END, 6) + 0.0 AS acceleration FROM d")
def nav_acceleration(spark, sf):
    """WIN-1, WIN-4: first difference over the step in time."""
    got = navigation.acceleration(ticks(spark, sf).withColumn("s", F.col("ts") / 1e6), "agent", ["tick"], "value", "s")
    return got.select("agent", "tick", r6(F.col("acceleration"), "acceleration"))


@query(f"WITH {TICKS}, v AS (SELECT agent, tick, sum(value * 0.1::DOUBLE) OVER (PARTITION BY agent ORDER BY tick) AS velocity FROM t) SELECT agent, tick, round(velocity, 4) AS velocity, round(sum(velocity * 0.1::DOUBLE) OVER (PARTITION BY agent ORDER BY tick), 4) AS position FROM v")
def nav_dead_reckoning(spark, sf):
    """WIN-2: velocity and position by two running sums."""
    got = navigation.dead_reckoning(ticks(spark, sf), "agent", ["tick"], "value", 0.1)
    return got.select("agent", "tick", F.round("velocity", 4).alias("velocity"), F.round("position", 4).alias("position"))


@query(f"WITH {TICKS}, a AS (SELECT agent, tick, value AS x, value * 2 AS y FROM t), b AS (SELECT agent, tick + 1 AS tick, value AS x, value * 3 AS y FROM t) SELECT agent, tick, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS error FROM a JOIN b USING (agent, tick)")
def nav_path_error(spark, sf):
    """JN-14, PRJ-7: distance of two paths at equal steps."""
    t = ticks(spark, sf)
    a = t.select("agent", "tick", F.col("value").alias("x"), (F.col("value") * 2).alias("y"))
    b = t.select("agent", (F.col("tick") + 1).cast("int").alias("tick"), F.col("value").alias("x"), (F.col("value") * 3).alias("y"))
    return navigation.path_error(a, b, ["agent", "tick"], ["x", "y"]).select("agent", "tick", r6(F.col("error"), "error"))


@query(f"""WITH RECURSIVE {TICKS}, u AS (SELECT agent, tick, value / 100 AS a, value AS z FROM t),
k AS (SELECT agent, 0::BIGINT AS tick, 0.0::DOUBLE AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS p, 0.0::DOUBLE AS c, 1.0::DOUBLE AS q FROM (SELECT DISTINCT agent FROM u)
UNION ALL SELECT agent, tick, x1 + g * (z - x1), v1 + h * (z - x1), (1 - g) * p1, (1 - g) * c1, q1 - h * c1 FROM (SELECT *, p1 / (p1 + 5.0) AS g, c1 / (p1 + 5.0) AS h FROM
(SELECT k.agent, u.tick, u.z, k.x + k.v * 0.5 + 0.5 * u.a * 0.25 AS x1, k.v + u.a * 0.5 AS v1, p + 2 * 0.5 * c + 0.25 * q + 0.25 * 0.0625 / 4 AS p1, c + 0.5 * q + 0.25 * 0.125 / 2 AS c1, q + 0.25 * 0.25 AS q1 FROM k JOIN u ON u.agent = k.agent AND u.tick = k.tick + 1)))
SELECT agent, tick, round(x, 6) AS x, round(v, 6) AS v FROM k WHERE tick > 0""")
def nav_ekf(spark, sf):
    """STM-2: a Kalman filter over each run."""
    t = ticks(spark, sf).select("agent", F.col("tick").cast("long").alias("tick"), (F.col("value") / 100).alias("a"), F.col("value").alias("z"))
    return navigation.kalman(t, "agent", ["tick"], "a", "z", 0.5).select("agent", "tick", r6(F.col("x"), "x"), r6(F.col("v"), "v"))


@query(f"""WITH RECURSIVE {TICKS}, k AS (SELECT agent, 0::BIGINT AS tick, 0.0::DOUBLE AS i, 0.0::DOUBLE AS d, 0.0::DOUBLE AS e, 0.0::DOUBLE AS s, 0.0::DOUBLE AS o FROM (SELECT DISTINCT agent FROM t)
UNION ALL SELECT agent, tick, i1, d1, e1, s1, 2.0 * e1 + 0.1 * i1 - 0.5 * d1 FROM (SELECT k.agent, t.tick, k.i + 0.1 / 2 * ((50 - t.value) + k.e) AS i1, (2 * 0.05 - 0.1) / (2 * 0.05 + 0.1) * k.d + 2 / (2 * 0.05 + 0.1) * (t.value - k.s) AS d1, 50 - t.value AS e1, t.value AS s1 FROM k JOIN t ON t.agent = k.agent AND t.tick = k.tick + 1))
SELECT agent, tick, round(o, 6) AS command FROM k WHERE tick > 0""")
def control_pid(spark, sf):
    """STM-7, WIN-9: a PID controller over each run."""
    t = ticks(spark, sf).withColumn("tick", F.col("tick").cast("long"))
    got = control.pid(t, "agent", ["tick"], "value", 50.0, 0.1, (2.0, 0.1, 0.5), 0.05)
    return got.select("agent", "tick", r6(F.col("command"), "command"))


@query(f"""WITH RECURSIVE {TICKS}, k AS (SELECT agent, 0::BIGINT AS tick, 0.0::DOUBLE AS u FROM (SELECT DISTINCT agent FROM t) UNION ALL SELECT k.agent, t.tick, greatest(-40.0, least(40.0, k.u + 0.1::DOUBLE * (t.value - k.u) / 0.37::DOUBLE)) FROM k JOIN t ON t.agent = k.agent AND t.tick = k.tick + 1)
SELECT agent, tick, round(u, 6) AS actual FROM k WHERE tick > 0""")
def control_actuator_lag(spark, sf):
    """STM-11: a first-order actuator with saturation."""
    t = ticks(spark, sf).withColumn("tick", F.col("tick").cast("long"))
    got = control.scanned(t, "agent", ["tick"], ["value"], lambda: control.Actuator(0.37, 40.0), lambda s, v: (s.step(v, 0.1),), "actual double", ["actual"])
    return got.select("agent", "tick", r6(F.col("actual"), "actual"))


@query(f"WITH {CLOUD}, e AS (SELECT l_orderkey, l_linenumber, x - 25 AS a, y - 50 AS b, z + 5 AS d FROM c) SELECT l_orderkey, l_linenumber, round(greatest(-20, least(20, d)), 6) AS up, round(greatest(-20, least(20, a + b)), 6) AS t5, round(greatest(-20, least(20, a - b)), 6) AS t6, round(greatest(-20, least(20, b)), 6) AS t7, round(greatest(-20, least(20, -b)), 6) AS t8 FROM e")
def control_thrusters(spark, sf):
    """FN-36, FN-41: thruster commands from a position error, clipped."""
    x, y, z = xyz()
    t = control.thrusters(x - 25, y - 50, z + 5)
    return cloud(spark, sf).select(*KEY, r6(t[0], "up"), *(r6(t[k], f"t{k + 1}") for k in range(4, 8)))


@query(f"WITH {CLOUD}, w AS (SELECT l_orderkey, l_linenumber, (x - 25 + pi()) AS a FROM c) SELECT l_orderkey, l_linenumber, round(a - floor(a / (2 * pi())) * (2 * pi()) - pi(), 6) AS angle FROM w")
def angle_wrap(spark, sf):
    """FN-35: angles in [-pi, pi)."""
    return cloud(spark, sf).select(*KEY, r6(geometry.wrapped(F.col("x") - 25), "angle"))


@query(f"WITH {CLOUD}, q AS (SELECT l_orderkey, l_linenumber, x/50 AS a, y/100 AS b, z/10 AS d, sqrt(x*x/2500 + y*y/10000 + z*z/100) AS w FROM c), h AS (SELECT *, CASE WHEN w * 0.1 < 1e-8 THEN 1.0 ELSE cos(w * 0.1 / 2) END AS qw, CASE WHEN w * 0.1 < 1e-8 THEN 0.0 ELSE sin(w * 0.1 / 2) / w END AS f FROM q) SELECT l_orderkey, l_linenumber, round(0.5 * qw - 0.5 * a * f - 0.5 * b * f - 0.5 * d * f, 6) AS w, round(0.5 * a * f + 0.5 * qw + 0.5 * d * f - 0.5 * b * f, 6) AS x FROM h")
def quat_ops(spark, sf):
    """FN-30, FN-31: a turn from angular rates, multiplied on."""
    x, y, z = xyz()
    dq = geometry.quaternion_of_rate(x / 50, y / 100, z / 10, 0.1)
    got = geometry.quaternion_product([F.lit(0.5)] * 4, dq)
    return cloud(spark, sf).select(*KEY, r6(got[0], "w"), r6(got[1], "x"))


@query("WITH d(x, y) AS (VALUES " + ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in zip(control.DRAG_X, control.DRAG_Y)) + "), s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM d) SELECT l_orderkey, l_linenumber, round(CASE WHEN v <= 0.0109 THEN 1.9661 WHEN v > 4.0031 THEN 0.5593 ELSE (SELECT min(y + (v - x) * ((y2 - y) / (x2 - x))) FROM s WHERE v > x AND v <= x2) END, 6) AS drag FROM (SELECT l_orderkey, l_linenumber, l_quantity / 12 AS v FROM lineitem)")
def drag_interp(spark, sf):
    """JN-13: piecewise-linear drag, held at the ends."""
    return cloud(spark, sf).select(*KEY, r6(control.interpolated(F.col("x") / 12, control.DRAG_X, control.DRAG_Y), "drag"))


# --- links ----------------------------------------------------------------------------------------------------------


@query(f"WITH {TICKS} SELECT event_id, agent, tick + CAST(round(abs(value) * 10 * 30 / 1500.0) AS BIGINT) AS arrival FROM t")
def comms_delay(spark, sf):
    """FN-27: the tick at which a message arrives."""
    t = ticks(spark, sf)
    return t.select("event_id", "agent", (F.col("tick") + comms.delay_ticks(F.abs("value") * 10, 30)).alias("arrival"))


@query("WITH m AS (SELECT event_id, user_id AS agent, epoch_us(ts) // 60000000 AS tick FROM events) SELECT event_id, agent, tick FROM m QUALIFY count(*) OVER (PARTITION BY tick) = 1")
def comms_collision(spark, sf):
    """FLT-21: messages on ticks with one sender."""
    m = table(spark, sf, "events").select("event_id", F.col("user_id").alias("agent"), F.expr("unix_micros(cast(ts AS timestamp)) div 60000000").alias("tick"))
    return comms.heard(m, "tick")


KINDS = {"click": "OWAY", "view": "OWAYU", "purchase": "MSG_RESPX", "signup": "MSG_RESPU", "error": "MSG_REQX"}
KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


@query(f"WITH m AS (SELECT event_id, {KIND_SQL} AS kind, value FROM events) SELECT event_id, kind, CASE WHEN kind IN ('OWAYU', 'MSG_RESPU', 'MSG_REQX', 'MSG_RESPX') THEN round(value / 100, 6) END AS azimuth, CASE WHEN kind IN ('MSG_RESPU', 'MSG_RESPX') THEN value END AS range, CASE WHEN kind IN ('MSG_REQX', 'MSG_RESPX') THEN -value END AS depth FROM m")
def comms_fields(spark, sf):
    """PRJ-17, STM-14: which fields a message type carries."""
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("event_type")]
    m = table(spark, sf, "events").select("event_id", kind.alias("kind"), "value")
    az, _, rng, dep = comms.exposed(F.col("kind"), F.round(F.col("value") / 100, 6), F.lit(0.0), F.col("value"), -F.col("value"))
    return m.select("event_id", "kind", az, rng, dep)


@query("WITH s AS (SELECT s_suppkey AS id, s_nationkey AS n, s_acctbal / 100 AS x, CAST(s_suppkey % 97 AS DOUBLE) AS y FROM supplier), p AS (SELECT a.id, b.id AS other, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM s a JOIN s b ON a.n = b.n AND a.id <> b.id) SELECT id, other, round(sqrt(dx*dx + dy*dy), 6) AS distance FROM p WHERE sqrt(dx*dx + dy*dy) <= 60 AND CASE WHEN sqrt(ax*ax + ay*ay) * sqrt(dx*dx + dy*dy) > 0 THEN (ax*dx + ay*dy) / (sqrt(ax*ax + ay*ay) * sqrt(dx*dx + dy*dy)) >= cos(radians(60.0)) ELSE false END")
def comms_optical(spark, sf):
    """Pairs of modems of one region within range and within the beam of the sender."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 97).cast("double").alias("y"))
    b = s.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("x").alias("bx"), F.col("y").alias("by"))
    p = comms.in_reach(s, b, "n", "m", [("x", "bx"), ("y", "by")], 60.0).where("id <> other")
    seen = comms.within_cone(F.col("x"), F.col("y"), F.col("bx") - F.col("x"), F.col("by") - F.col("y"), 60.0)
    return p.where(seen).select("id", "other", r6(F.col("distance"), "distance"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) > 50 THEN 'high' ELSE 'low' END AS band FROM events")
def commands_json(spark, sf):
    """FN-47, FN-48, SRC-7: settings out of JSON, written and read again."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    again = e.select("event_id", F.from_json(F.to_json("p"), "k int")["k"].alias("k"))
    return again.select("event_id", "k", F.when(F.col("k") > 50, "high").otherwise("low").alias("band"))


# --- rewards --------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN abs(value - 50) < 10 THEN 1 ELSE 0 END AS reward, abs(value - 50) < 10 AS terminal FROM events")
def reward_location(spark, sf):
    """STM-16: reward within a distance of the goal."""
    reward, done = rewards.location(F.abs(F.col("value") - 50), 10.0)
    return table(spark, sf, "events").select("event_id", reward.alias("reward"), done.alias("terminal"))


@query("SELECT event_id, round(CASE WHEN event_type <> 'error' AND abs(value) < 80 THEN 100.0 * (80.0 - abs(value)) / 80.0 ELSE 0.0 END, 6) AS reward FROM events")
def reward_follow(spark, sf):
    """STM-17: a ramp that grows as the distance shrinks."""
    return table(spark, sf, "events").select("event_id", r6(rewards.follow(F.abs("value"), 80.0, 100.0, F.col("event_type") != "error"), "reward"))


@query("SELECT event_id, round(CASE WHEN abs(value) < 80 THEN 100.0 * abs(value) / 80.0 ELSE 100.0 END, 6) AS reward FROM events")
def reward_avoid(spark, sf):
    """STM-17: a ramp that falls as the distance shrinks."""
    return table(spark, sf, "events").select("event_id", r6(rewards.avoid(F.abs("value"), 80.0, 100.0), "reward"))


@query(f"""WITH RECURSIVE {TICKS}, k AS (SELECT agent, 0::BIGINT AS tick, 100.0::DOUBLE AS goal, 0 AS reward, false AS terminal FROM (SELECT DISTINCT agent FROM t)
UNION ALL SELECT k.agent, t.tick, CASE WHEN t.value < k.goal THEN t.value - 5 ELSE k.goal END, CASE WHEN t.value < k.goal THEN 1 ELSE 0 END, t.value < 10 FROM k JOIN t ON t.agent = k.agent AND t.tick = k.tick + 1)
SELECT agent, tick, reward, terminal FROM k WHERE tick > 0""")
def reward_distance(spark, sf):
    """STM-15: a threshold that moves on each time it is beaten."""
    t = ticks(spark, sf).withColumn("tick", F.col("tick").cast("long"))
    return control.scanned(t, "agent", ["tick"], ["value"], lambda: control.DistanceReward(10.0, 5.0, 100.0), lambda s, v: s.step(v), "reward int, terminal boolean", ["reward", "terminal"])


@query(f"WITH {TICKS} SELECT agent, tick, round(value - coalesce(lag(value) OVER (PARTITION BY agent ORDER BY tick), value), 6) AS reward FROM t")
def reward_cleanup(spark, sf):
    """WIN-8: the change since the tick before."""
    w = sampling.Window.partitionBy("agent").orderBy("tick")
    return ticks(spark, sf).select("agent", "tick", r6(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value")), "reward"))


@query(f"WITH {TICKS}, d AS (SELECT *, (value - lag(value) OVER (PARTITION BY agent ORDER BY tick)) / 0.5 AS a FROM t) SELECT agent, tick, CAST(sensor = 'error' OR abs(coalesce(a, 0)) > 60 AS INTEGER) AS abused FROM d")
def reward_shock(spark, sf):
    """STM-21, STM-20: accelerations over a limit."""
    w = sampling.Window.partitionBy("agent").orderBy("tick")
    t = ticks(spark, sf).withColumn("a", F.coalesce((F.col("value") - F.lag("value").over(w)) / 0.5, F.lit(0.0)))
    return t.select("agent", "tick", rewards.shock(F.col("a"), 60.0, F.col("sensor") == "error").alias("abused"))


@query(f"""WITH {TICKS}, c AS (SELECT agent, tick, value > 97 AND NOT value < 2 AS ball, sensor = 'view' AND value > 60 AND value <= 97 AS hit, value < 2 AS wrong FROM t)
SELECT agent, tick, CASE WHEN ball THEN 2 WHEN hit AND sum(hit::INTEGER) OVER w = 1 THEN 1 WHEN wrong THEN -1 ELSE 0 END AS reward, bool_or(ball OR wrong) OVER w AS terminal FROM c WINDOW w AS (PARTITION BY agent ORDER BY tick)""")
def reward_once(spark, sf):
    """STM-18: rewards of which one is given once a run, and the end of the run."""
    v = F.col("value")
    t = ticks(spark, sf).withColumn("tick", F.col("tick").cast("long"))
    return rewards.cup_game(t, "agent", ["tick"], v > 97, (F.col("sensor") == "view") & (v > 60), v < 2)


@query("SELECT user_id AS agent, bool_or(event_type = 'error') AS hit, max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def event_latch(spark, sf):
    """STM-20: whether anything happened, and the last reading."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("agent")).agg(F.bool_or(F.col("event_type") == "error").alias("hit"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


# --- lidar and noise ------------------------------------------------------------------------------------------------

@query(f"WITH {CLOUD}, i AS (SELECT *, exp(-0.02 * sqrt(x*x + y*y + z*z)) AS level FROM c) SELECT l_orderkey, l_linenumber, round(level, 6) AS intensity FROM i WHERE {u_sql(KEYED, 1)} >= 0.2 AND (level > 0.6 OR {u_sql(KEYED, 2)} < (1 - 0.3) / 0.6 * level + 0.3)")
def lidar_dropoff(spark, sf):
    """FLT-11, FLT-12, FN-12: returns that survive both drop-offs, with draws from the key."""
    x, y, z = xyz()
    key = F.concat_ws("-", *KEY)
    c = cloud(spark, sf).withColumn("level", lidar.intensity(F.sqrt(x * x + y * y + z * z), 0.02))
    return c.where(lidar.kept(F.col("level"), noise.uniform(key, 1), noise.uniform(key, 2), 0.2, 0.6, 0.3)).select(*KEY, r6(F.col("level"), "intensity"))


@query("SELECT l_linenumber AS ring, count(*) AS n, count(DISTINCT l_returnflag) AS tags FROM lineitem GROUP BY 1")
def lidar_counts(spark, sf):
    """AGG-13, AGG-22: points and tags of each ring."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("ring")).agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("tags"))


@query("SELECT s_suppkey, CAST(i AS INTEGER) AS channel, round(10.0 + s_suppkey % 5 - i * (40.0::DOUBLE / 31), 6) AS elevation, round((350.0::DOUBLE + s_suppkey % 7 + i * 2.5::DOUBLE) % 120.0::DOUBLE - 60.0, 6) AS azimuth FROM supplier, range(32) r(i)")
def lidar_geometry(spark, sf):
    """FN-13, FN-14: the laser fan and sweep of each lidar, mounted at a tilt and started at an angle of its own."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.posexplode(lidar.elevation_fan(10.0, -30.0, 32)).alias("channel", "e"))
    return s.select("s_suppkey", "channel", r6(F.col("e") + F.col("s_suppkey") % 5, "elevation"), r6(lidar.sweep_angle(350.0 + F.col("s_suppkey") % 7, F.col("channel"), 2.5, 120.0), "azimuth"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def label_lookup(spark, sf):
    """JN-12, JN-11: names by id through small tables."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", "n_name", "r_name")


@query(f"WITH n AS (SELECT l_returnflag, sqrt(-2 * ln(1 - {u_sql(KEYED, 5)})) * cos(2 * pi() * {u_sql(KEYED, 6)}) AS g, -2.0 * ln(1 - {u_sql(KEYED, 9)}) AS e FROM lineitem) SELECT l_returnflag, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, round(avg(e), 6) AS waiting FROM n GROUP BY 1")
def noise_moments(spark, sf):
    """FN-20, FN-22: moments of keyed normal and exponential noise."""
    key = F.concat_ws("-", *KEY)
    n = table(spark, sf, "lineitem").select("l_returnflag", noise.normal(key, 5).alias("g"), noise.exponential(key, 9, 2.0).alias("e"))
    return n.groupBy("l_returnflag").agg(r6(F.avg("g"), "mean"), r6(F.stddev_pop("g"), "std"), r6(F.avg("e"), "waiting"))


@query("SELECT l_orderkey, round(avg(CASE WHEN l_discount * -100 < -3 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def submerged_fraction(spark, sf):
    """AGG-12: share of points under the surface."""
    return cloud(spark, sf).groupBy("l_orderkey").agg(r6(F.avg(F.when(F.col("z") < -3, 1.0).otherwise(0.0)), "share"))


@query("SELECT l_returnflag AS tag, round(sum((l_tax - l_discount) * (l_tax - l_discount)) / count(*), 6) AS mse, bool_and(abs(l_tax - l_discount) <= 1e-4 + 0.01 * abs(l_discount)) AS equal FROM lineitem GROUP BY 1")
def image_error(spark, sf):
    """AGG-20, FN-52: mean square error and approximate equality."""
    d = F.col("l_tax") - F.col("l_discount")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tag")).agg(r6(F.sum(d * d) / F.count("*"), "mse"), F.bool_and(F.abs(d) <= 1e-4 + 0.01 * F.abs("l_discount")).alias("equal"))


@query("WITH w AS (SELECT l_returnflag, l_tax + 0.01 AS w, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) SELECT l_returnflag, round(sum(w * x * x) / (sum(w) + 1e-6), 4) AS xx, round(sum(w * x * y) / (sum(w) + 1e-6), 4) AS xy, round(sum(w * y * y) / (sum(w) + 1e-6), 4) AS yy FROM w GROUP BY 1")
def outer_products(spark, sf):
    """AGG-16, AGG-17: weighted second moments with normalised weights."""
    w = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_tax") + 0.01).alias("w"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    m = lambda a, b, n: F.round(F.sum(F.col("w") * F.col(a) * F.col(b)) / (F.sum("w") + 1e-6), 4).alias(n)
    return w.groupBy("l_returnflag").agg(m("x", "x", "xx"), m("x", "y", "xy"), m("y", "y", "yy"))


# --- models (no SQL twin; tested against plain Python) ----------------------------------------------------------------


@query()
def ml_classify(spark, sf):
    """ML-2, ML-3: boosted trees for each class, learned from the training part of each label: the class and its share."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)))
    split = learning.stratified(e, "vec_id", "label", 0.8)
    model = boosting.boosted(split.where("train"), [f"f{k}" for k in range(64)], "label", rounds=5, depth=3, step=0.4)
    share = F.array_max(vector_to_array("probability"))
    return model.transform(split).select("vec_id", "label", "train", F.col("predicted_label").cast("int").alias("guess"), r6(share, "share"))


def depths(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"), F.col("embedding")[2].cast("double").alias("y"))


@query()
def gp_sparse_fit(spark, sf):
    """ML-5, ML-6: a sparse Gaussian process with a fitted kernel over all depths, and its mean at each point."""
    d = depths(spark, sf)
    model, _ = gaussian.fit_sparse(d, ["a", "b"], "y", "vec_id", inducing=50)
    return d.select("vec_id", r6(model.mean(d), "mean"))


@query()
def gp_epoch_loss(spark, sf):
    """AGG-19: the mean loss of each epoch of that fit."""
    _, losses = gaussian.fit_sparse(depths(spark, sf), ["a", "b"], "y", "vec_id", inducing=50)
    return spark.createDataFrame([(k + 1, v) for k, v in enumerate(losses)], "epoch int, loss double")


@query()
def gp_exact_fit(spark, sf):
    """ML-4, ML-7: an exact Gaussian process on a sample of at most 256 depths, and its mean at each point."""
    d = depths(spark, sf)
    return d.select("vec_id", r6(gaussian.fit_exact(d, ["a", "b"], "y", "vec_id", sample=256, starts=5).mean(d), "mean"))


@query("WITH z(a, b, w) AS (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {w!r}::DOUBLE)" for (a, b), w in zip(CENTRES, ALPHA)) + ") SELECT vec_id, round(2.5 + 3.0 * sum(w * 1.3 * exp(-0.5 * ((embedding[1]::DOUBLE - a) * (embedding[1]::DOUBLE - a) + (embedding[2]::DOUBLE - b) * (embedding[2]::DOUBLE - b)) / (0.2::DOUBLE * 0.2::DOUBLE))), 6) AS mean FROM embeddings, z GROUP BY vec_id")
def model_round_trip(spark, sf):
    """SNK-6, SRC-11: a process saved as a table, loaded again, and its mean at each point."""
    import numpy as np

    path = fresh_path(spark)
    gaussian.save(spark, gaussian.Model(["a", "b"], np.array(CENTRES), np.array(ALPHA), gaussian.Kernel(1.3, 0.2, 0.1), 2.5, 3.0), path)
    d = depths(spark, sf)
    return d.select("vec_id", r6(gaussian.load(spark, path).mean(d), "mean"))


_GYROS = "g AS (SELECT agent, tick, sin(value) / 10 AS g1, sin(value * 2) / 10 AS g2, sin(value * 3) / 10 AS g3, cos(value) / 10 AS a1, 0.1::DOUBLE AS a2, 9.8::DOUBLE AS a3 FROM t)"


def _product_sql(p: list[str], q: list[str], names: str = "n0 n1 n2 n3") -> str:
    """The product of two quaternions, named n0 to n3."""
    w, x, y, z = p
    a, b, c, d = q
    terms = (f"{w} * {a} - {x} * {b} - {y} * {c} - {z} * {d}", f"{w} * {b} + {x} * {a} + {y} * {d} - {z} * {c}", f"{w} * {c} - {x} * {d} + {y} * {a} + {z} * {b}", f"{w} * {d} + {x} * {c} - {y} * {b} + {z} * {a}")
    return ", ".join(f"{t} AS {n}" for t, n in zip(terms, names.split()))


_TURNED = f"""(SELECT *, {_product_sql(["w", "x", "y", "z"], ["c", "g1 * s", "g2 * s", "g3 * s"])} FROM
(SELECT *, cos(rate * 0.1 / 2) AS c, CASE WHEN rate > 1e-12 THEN sin(rate * 0.1 / 2) / rate ELSE 0.05 END AS s FROM (SELECT k.* EXCLUDE (tick), g.* EXCLUDE (agent), sqrt(g1 * g1 + g2 * g2 + g3 * g3) AS rate FROM k JOIN g ON g.agent = k.agent AND g.tick = k.tick + 1)))"""
_START = "agent, 0::BIGINT AS tick, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z"


def gyros(spark, sf):
    return ticks(spark, sf).select("agent", F.col("tick").cast("long").alias("tick"), *((F.sin(F.col("value") * k) / 10).alias(f"g{k}") for k in (1, 2, 3)), (F.cos("value") / 10).alias("a1"), F.lit(0.1).alias("a2"), F.lit(9.8).alias("a3"))


@query(f"""WITH RECURSIVE {TICKS}, {_GYROS}, k AS (SELECT {_START} FROM (SELECT DISTINCT agent FROM t)
UNION ALL SELECT agent, tick, m0, m1, m2, m3 FROM (SELECT agent, tick, {_product_sql(["cc", "ax * ss", "ay * ss", "0.0"], ["n0", "n1", "n2", "n3"], "m0 m1 m2 m3")} FROM
(SELECT *, cos(0.1 * sqrt(ax * ax + ay * ay) / 2) AS cc, CASE WHEN sqrt(ax * ax + ay * ay) > 1e-11 THEN sin(0.1 * sqrt(ax * ax + ay * ay) / 2) / sqrt(ax * ax + ay * ay) ELSE 0.05 END AS ss FROM
(SELECT *, (2 * (n1 * n2 + n0 * n3) * a1 + (n0 * n0 - n1 * n1 + n2 * n2 - n3 * n3) * a2 + 2 * (n2 * n3 - n0 * n1) * a3) / size AS ax, -((n0 * n0 + n1 * n1 - n2 * n2 - n3 * n3) * a1 + 2 * (n1 * n2 - n0 * n3) * a2 + 2 * (n1 * n3 + n0 * n2) * a3) / size AS ay FROM
(SELECT *, sqrt(a1 * a1 + a2 * a2 + a3 * a3) AS size FROM {_TURNED})))))
SELECT agent, tick, round(2 * (x * z - w * y), 6) + 0.0 AS ux, round(2 * (y * z + w * x), 6) + 0.0 AS uy, round(w * w - x * x - y * y + z * z, 6) + 0.0 AS uz FROM k WHERE tick > 0""")
def attitude_fusion(spark, sf):
    """STM-4: the up vector of each agent from rates and accelerations."""
    got = attitude.fused(gyros(spark, sf), "agent", "tick", ["g1", "g2", "g3"], ["a1", "a2", "a3"], 0.1)
    return got.select("agent", "tick", *((F.round(c, 6) + 0.0).alias(c) for c in ("ux", "uy", "uz")))


@query(f"""WITH RECURSIVE {TICKS}, {_GYROS}, k AS (SELECT {_START}, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS p3 FROM (SELECT DISTINCT agent FROM t)
UNION ALL SELECT agent, tick, n0, n1, n2, n3, s1, s2, s3, p1 + 0.1 * s1, p2 + 0.1 * s2, p3 + 0.1 * s3 FROM
(SELECT *, v1 + 0.1 * ((n0 * n0 + n1 * n1 - n2 * n2 - n3 * n3) * a1 + 2 * (n1 * n2 - n0 * n3) * a2 + 2 * (n1 * n3 + n0 * n2) * a3) AS s1, v2 + 0.1 * (2 * (n1 * n2 + n0 * n3) * a1 + (n0 * n0 - n1 * n1 + n2 * n2 - n3 * n3) * a2 + 2 * (n2 * n3 - n0 * n1) * a3) AS s2, v3 + 0.1 * (2 * (n1 * n3 - n0 * n2) * a1 + 2 * (n2 * n3 + n0 * n1) * a2 + (n0 * n0 - n1 * n1 - n2 * n2 + n3 * n3) * a3 - 9.81::DOUBLE) AS s3 FROM {_TURNED}))
SELECT agent, tick, round(p1, 6) + 0.0 AS x, round(p2, 6) + 0.0 AS y, round(p3, 6) + 0.0 AS z FROM k WHERE tick > 0""")
def nav_strapdown(spark, sf):
    """STM-3: dead reckoning with rotation."""
    got = attitude.strapdown(gyros(spark, sf), "agent", "tick", ["g1", "g2", "g3"], ["a1", "a2", "a3"], 0.1)
    return got.select("agent", "tick", *((F.round(c, 6) + 0.0).alias(c) for c in "xyz"))


# --- frames, forces and voxels ----------------------------------------------------------------------------------------


@query(f"WITH {CLOUD}, a AS (SELECT l_orderkey, l_linenumber, x / 20 - 1.2 AS r, z / 10 AS p, y / 61.7::DOUBLE - 0.8 AS w FROM c) SELECT l_orderkey, l_linenumber, round(r, 4) + 0.0 AS roll, round(p, 4) + 0.0 AS pitch, round(w, 4) + 0.0 AS yaw, round(cos(w) * cos(p) * 1 - sin(p) * 3 + sin(w) * cos(p) * 2, 6) AS mx FROM a")
def frames_round_trip(spark, sf):
    """FN-25, FN-29, FN-32, FN-34, PRJ-16: angles to matrix to quaternion to matrix to angles, and a field in the body frame."""
    x, y, z = xyz()
    m = vehicle.rotation_matrix(x / 20 - 1.2, z / 10, y / 61.7 - 0.8)
    a = cloud(spark, sf).select(*KEY, F.array(*vehicle.quaternion_of_matrix(m)).alias("q"), vehicle.magnetometer(m, [1.0, 2.0, 3.0])[0].alias("mx"))
    back = vehicle.roll_pitch_yaw(vehicle.matrix_of_quaternion([F.col("q")[k] for k in range(4)]))
    return a.select(*KEY, *(F.round(c, 4).alias(n) for c, n in zip(back, ("roll", "pitch", "yaw"))), r6(F.col("mx"), "mx"))


@query(f"WITH {CLOUD}, v AS (SELECT l_orderkey, l_linenumber, x / 10 AS a, y / 50 AS b, z / 5 AS d, CAST(l_linenumber AS DOUBLE) / 7 AS u FROM c), s AS (SELECT *, sqrt(a*a + b*b + d*d) AS sp, a * 300 - 700 AS n FROM v), t AS (SELECT *, greatest(-100, least(103, n)) AS m FROM s) SELECT l_orderkey, l_linenumber, round(-0.5 * 1000 * 0.8::DOUBLE * 0.1::DOUBLE * sp * a * u, 5) AS drag, round(0.03::DOUBLE * 9.81::DOUBLE * 997 * u, 6) AS lift, round(CASE WHEN m > 0 THEN 0.01::DOUBLE * m * abs(m) ELSE 0.006::DOUBLE * m * abs(m) END, 6) AS thrust, round(CASE WHEN sp < 0.2 THEN 0.0 ELSE least(1.0, sp) END, 6) AS trust FROM t")
def vehicle_forces(spark, sf):
    """FN-39, FN-42, FN-44: drag, buoyancy, thrust and trust in the speed."""
    x, y, z = xyz()
    c = cloud(spark, sf).select(*KEY, (x / 10).alias("a"), (y / 50).alias("b"), (z / 5).alias("d"), (F.col("l_linenumber").cast("double") / 7).alias("u"))
    v, u = [F.col("a"), F.col("b"), F.col("d")], F.col("u")
    return c.select(*KEY, F.round(vehicle.drag(v, 1000.0, 0.8, 0.1, u)[0], 5).alias("drag"), r6(vehicle.buoyancy(0.03, 9.81, 997.0, u), "lift"), r6(vehicle.propeller_thrust(F.col("a") * 300 - 700, -100.0, 103.0, 0.01, 0.006), "thrust"), r6(vehicle.speed_weight(v), "trust"))


@query("SELECT l_orderkey, l_linenumber, round((l_tax - l_discount) / (2 * sin(radians(22.5))), 6) AS x, round((l_tax + l_discount + l_tax * 2 + 0.1::DOUBLE - l_tax * 2 + l_discount - l_discount) / (4 * cos(radians(22.5))), 6) AS z FROM lineitem")
def dvl_noise(spark, sf):
    """FN-24: beam noise projected on the velocity."""
    x, _, z = vehicle.beam_velocity_noise([F.col("l_tax"), F.lit(0.1), F.col("l_discount"), F.lit(0.0)], 22.5)
    return table(spark, sf, "lineitem").select(*KEY, r6(x, "x"), r6(z, "z"))


@query("SELECT vec_id, CAST(i AS INTEGER) AS bin, round((i / 64.0::DOUBLE) * (i / 64.0::DOUBLE) * (1 + 0.5 * exp(-(i - 32.0::DOUBLE) * (i - 32.0::DOUBLE) / (64.0 / 64))), 6) AS scale FROM embeddings, range(64) r(i)")
def sonar_noise_scale(spark, sf):
    """FN-18: noise by range and lobe."""
    cells = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bin"))
    return cells.select("vec_id", "bin", r6(vehicle.range_lobe_scale(F.col("bin") / 64.0, F.col("bin") - 32.0, 64.0), "scale"))


@query("WITH v AS (SELECT p_partkey, CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 12 AS VARCHAR) AS version FROM part) SELECT p_partkey, version, (CAST(split_part(version, '.', 1) AS INTEGER), CAST(split_part(version, '.', 2) AS INTEGER)) >= (2, 3) AS enough FROM v")
def version_check(spark, sf):
    """FN-45: dotted versions compared by their numbers."""
    v = table(spark, sf, "part").select("p_partkey", F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 12).cast("string")).alias("version"))
    return v.select("p_partkey", "version", (vehicle.version_key(F.col("version")) >= vehicle.version_key(F.lit("2.3"))).alias("enough"))


@query("WITH v AS (SELECT DISTINCT l_orderkey, CAST(floor(l_quantity / 5) AS INTEGER) AS i, CAST(floor(l_extendedprice / 10000) AS INTEGER) AS j, CAST(floor(l_discount * 50) AS INTEGER) AS k FROM lineitem), r AS (SELECT s_suppkey, s, CAST(floor((s_suppkey % 10 + 0.5 * s) / 1) AS INTEGER) AS i, CAST(floor((s_suppkey % 7 + 0.3::DOUBLE * s) / 1) AS INTEGER) AS j, CAST(floor(0.1::DOUBLE * s / 1) AS INTEGER) AS k FROM supplier, range(1, 21) q(s)), h AS (SELECT r.*, row_number() OVER (PARTITION BY s_suppkey ORDER BY s) AS n FROM r WHERE (i, j, k) IN (SELECT i, j, k FROM v)) SELECT s_suppkey, CAST(s AS INTEGER) AS step, i, j, k FROM h WHERE n = 1")
def voxel_probe(spark, sf):
    """JN-7, JN-6: the first occupied voxel along each ray."""
    v = table(spark, sf, "lineitem").select(F.floor(F.col("l_quantity") / 5).cast("int").alias("i"), F.floor(F.col("l_extendedprice") / 10000).cast("int").alias("j"), F.floor(F.col("l_discount") * 50).cast("int").alias("k"))
    rays = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10).cast("double").alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(0.5).alias("dx"), F.lit(0.3).alias("dy"), F.lit(0.1).alias("dz"))
    return voxels.first_hit(rays, v, "s_suppkey", 1.0, 1.0, 20)


@query()
def voxel_clusters(spark, sf):
    """JN-8: greedy clusters of neighbouring voxels with like normals."""
    v = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("ping"), F.floor(F.col("l_quantity") / 2).cast("int").alias("i"), F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("j"), F.col("l_linenumber").alias("k"), F.cos(F.col("l_tax") * 20).alias("nx"), F.sin(F.col("l_tax") * 20).alias("ny"), F.lit(0.0).alias("nz"))
    return voxels.clusters(v, "ping", 2)


@query(f"""WITH RECURSIVE {TICKS}, k AS (SELECT agent, 0::BIGINT AS tick, 0.0::DOUBLE AS x, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a FROM (SELECT DISTINCT agent FROM t)
UNION ALL SELECT k.agent, t.tick, k.x + 0.1::DOUBLE * k.v, greatest(-3.0::DOUBLE, least(3.0::DOUBLE, k.v + 0.1::DOUBLE * k.a)), k.a + 0.1::DOUBLE * (0.729::DOUBLE * (t.value - k.x) - 2.6::DOUBLE * 0.81::DOUBLE * k.v - 2.6::DOUBLE * 0.9::DOUBLE * k.a) FROM k JOIN t ON t.agent = k.agent AND t.tick = k.tick + 1)
SELECT agent, tick, round(x, 5) AS x, round(v, 5) AS v FROM k WHERE tick > 0""")
def control_reference_model(spark, sf):
    """STM-9: a smooth third-order path to moving set points."""
    t = ticks(spark, sf).withColumn("tick", F.col("tick").cast("long"))
    got = control.scanned(t, "agent", ["tick"], ["value"], lambda: control.smooth_path(0.9, 0.8, 3.0, 0.1), lambda s, v: s.step(v), "x double, v double, a double", ["x", "v", "a"])
    return got.select("agent", "tick", F.round("x", 5).alias("x"), F.round("v", 5).alias("v"))


@query("SELECT event_id, round(CASE WHEN abs(value - 50) > 30 THEN value * 2 WHEN value < 60 AND value > 40 THEN value * 3 ELSE value END, 6) AS pose, round(CASE WHEN event_type = 'error' THEN value ELSE value / 2 + 10 END, 6) AS depth FROM events")
def nav_corrections(spark, sf):
    """STM-22, STM-23, FLT-16: where a correction comes from, and depth by altitude."""
    v = F.col("value")
    pose = navigation.corrected_pose(v - 50, v, v, v * 2, F.when(v > 40, v * 3), 30.0, 60.0)
    depth = navigation.depth_from_sonar(F.when(F.col("event_type") != "error", v / 2), F.lit(10.0), v)
    return table(spark, sf, "events").select("event_id", r6(pose, "pose"), r6(depth, "depth"))


@query("""WITH m AS (SELECT user_id AS link, epoch_us(ts) AS moment, event_id, event_type AS kind FROM events WHERE event_type IN ('click', 'purchase', 'view', 'signup')),
n AS (SELECT *, kind IN ('click', 'purchase') AS asks, coalesce(sum((kind IN ('view', 'signup'))::INTEGER) OVER (PARTITION BY link ORDER BY moment, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM m),
s AS (SELECT link, n, first(moment ORDER BY moment, event_id) FILTER (asks) AS asked_at, first(kind ORDER BY moment, event_id) FILTER (asks) AS request, max(moment) FILTER (NOT asks) AS answered_at, max(kind) FILTER (NOT asks) AS reply FROM n GROUP BY 1, 2)
SELECT link, asked_at, request, answered_at FROM s WHERE request IS NOT NULL AND reply = CASE request WHEN 'click' THEN 'view' ELSE 'signup' END""")
def comms_requests(spark, sf):
    """STM-14: accepted requests and their replies."""
    m = table(spark, sf, "events").select(F.col("user_id").alias("link"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("event_type").alias("kind"))
    return comms.answered(m, "link", "at", "kind", {"click": "view", "purchase": "signup"}, tie="event_id")


# --- poses, beams and links -----------------------------------------------------------------------------------------


@query("SELECT vec_id, round(CAST(embedding[4] AS DOUBLE), 6) AS px, round(CAST(embedding[8] AS DOUBLE), 6) AS py, round(CAST(embedding[12] AS DOUBLE), 6) AS pz, round(CAST(embedding[1] AS DOUBLE), 6) AS fx, round(CAST(embedding[5] AS DOUBLE), 6) AS fy, round(CAST(embedding[9] AS DOUBLE), 6) AS fz FROM embeddings")
def pose_unpack(spark, sf):
    """PRJ-5: position and forward axis of a 4 x 4 pose."""
    rows = F.array(*[F.transform(F.slice("embedding", 4 * k + 1, 4), lambda v: v.cast("double")) for k in range(4)])
    at, axes = geometry.unpacked_pose(rows)
    return table(spark, sf, "embeddings").select("vec_id", *[r6(c, f"p{n}") for c, n in zip(at, "xyz")], *[r6(c, f"f{n}") for c, n in zip(axes[0], "xyz")])


@query(f"""WITH {CLOUD}, a AS (SELECT *, l_tax * 3 AS ro, z / 20 AS pi, y / 40 AS ya, x / 5 AS r, l_linenumber / 7.0::DOUBLE AS th FROM c), b AS (SELECT *, r * cos(th) AS u, r * sin(th) AS v FROM a)
SELECT l_orderkey, l_linenumber, round(x + cos(ya) * cos(pi) * u + (cos(ya) * sin(pi) * sin(ro) - sin(ya) * cos(ro)) * v, 5) AS wx, round(y + sin(ya) * cos(pi) * u + (cos(ya) * cos(ro) + sin(ro) * sin(pi) * sin(ya)) * v, 5) AS wy, round(z - sin(pi) * u + cos(pi) * sin(ro) * v, 5) AS wz FROM b""")
def sonar_world_points(spark, sf):
    """PRJ-15: beams by range and angle in the world frame, under a full rotation."""
    x, y, z = xyz()
    got = geometry.polar_to_world([x, y, z], [F.col("l_tax") * 3, z / 20, y / 40], x / 5, F.col("l_linenumber") / 7.0)
    return cloud(spark, sf).select(*KEY, *[F.round(c, 5).alias(f"w{n}") for c, n in zip(got, "xyz")])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS accel, round(l_tax, 6) AS gyro, CASE WHEN l_returnflag = 'R' THEN round(l_discount, 6) END AS accel_bias, CASE WHEN l_returnflag = 'R' THEN round(l_discount / 2, 6) END AS gyro_bias FROM lineitem")
def imu_unpack(spark, sf):
    """PRJ-18: readings of two or four parts; the biases are null where a reading leaves them out."""
    short = F.array("l_quantity", "l_tax")
    sent = table(spark, sf, "lineitem").select(*KEY, F.when(F.col("l_returnflag") == "R", F.concat(short, F.array(F.col("l_discount"), F.col("l_discount") / 2))).otherwise(short).alias("m"))
    return sent.select(*KEY, *[r6(F.get("m", F.lit(k)), n) for k, n in enumerate(["accel", "gyro", "accel_bias", "gyro_bias"])])


@query("SELECT p_partkey, CAST(i AS INTEGER) AS beam, round(i * 360.0::DOUBLE / p_size, 6) AS angle FROM part, LATERAL (SELECT unnest(range(p_size)) AS i)")
def rangefinder_angles(spark, sf):
    """PRJ-19: the direction of each beam of range finders of different sizes."""
    p = table(spark, sf, "part").where("p_size > 0")
    return p.select("p_partkey", F.posexplode(geometry.ring_angles(F.col("p_size"))).alias("beam", "angle")).select("p_partkey", "beam", r6(F.col("angle"), "angle"))


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, -z AS depth, round(y - (-(z / 2.5::DOUBLE)), 6) AS delta FROM c")
def predictor_columns(spark, sf):
    """PRJ-1, PRJ-2, PRJ-4, PRJ-6: chosen columns in single precision, depth as minus z, and a dead-reckoning difference."""
    x, y, z = xyz()
    return cloud(spark, sf).select(*KEY, x.cast("float").alias("x"), y.cast("float").alias("y"), (-z).alias("depth"), r6(y - (-(z / 2.5)), "delta"))


@query(f"WITH {CLOUD}, h AS (SELECT *, -z + 0.5 * sqrt(-2 * ln(1 - {u_sql(KEYED, 51)})) * cos(2 * pi() * {u_sql(KEYED, 52)}) + 2.0 * sin(2 * pi() / 600 * (l_orderkey % 600)) AS deep FROM c) SELECT l_orderkey, l_linenumber, CASE WHEN deep < 5 THEN x END AS gps_x, CASE WHEN deep < 5 THEN y END AS gps_y FROM h")
def gps_fix(spark, sf):
    """FLT-7: positions near enough to a surface that the tide moves, with noise on the depth; null elsewhere."""
    x, y, z = xyz()
    surface = fields.tide_height(F.col("l_orderkey") % 600, 2.0, 600.0)
    heard = -z + 0.5 * noise.normal(F.concat_ws("-", *KEY), 51) + surface < 5
    return cloud(spark, sf).select(*KEY, F.when(heard, x).alias("gps_x"), F.when(heard, y).alias("gps_y"))


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber FROM c WHERE cos(l_tax * 50) * (25 - x) + sin(l_tax * 50) * (50 - y) + 0.1::DOUBLE * (-5 - z) > 0")
def sonar_facing(spark, sf):
    """FLT-10: surfaces that look towards the sensor."""
    x, y, z = xyz()
    tilt = F.col("l_tax") * 50
    return cloud(spark, sf).where(geometry.faces([F.cos(tilt), F.sin(tilt), F.lit(0.1)], [25 - x, 50 - y, -5 - z])).select(*KEY)


BEACONS = "b AS (SELECT s_suppkey AS id, CAST(s_suppkey % 53 AS DOUBLE) AS x, s_acctbal / 100 AS y, -CAST(s_suppkey % 13 AS DOUBLE) - 0.5 AS z FROM supplier)"
# Walls between beacons: opposite corners of boxes.
WALLS = [((10.0, -20.0, -20.0), (12.0, 60.0, 0.0)), ((30.0, 10.0, -6.0), (40.0, 50.0, -2.0))]


def _wall_sql(k: int) -> str:
    """The slab test of WALLS[k] for the segment from a to b."""
    low, high = WALLS[k]
    axes = list(zip("xyz", low, high))
    enter = ", ".join(f"CASE WHEN b.{n} <> a.{n} THEN least(({lo}::DOUBLE - a.{n}) / (b.{n} - a.{n}), ({hi}::DOUBLE - a.{n}) / (b.{n} - a.{n})) END" for n, lo, hi in axes)
    leave = ", ".join(f"CASE WHEN b.{n} <> a.{n} THEN greatest(({lo}::DOUBLE - a.{n}) / (b.{n} - a.{n}), ({hi}::DOUBLE - a.{n}) / (b.{n} - a.{n})) END" for n, lo, hi in axes)
    outside = " OR ".join(f"(b.{n} = a.{n} AND (a.{n} < {lo} OR a.{n} > {hi}))" for n, lo, hi in axes)
    return f"(NOT ({outside}) AND greatest(0.0, {enter}) <= least(1.0, {leave}))"


@query(f"WITH {BEACONS}, j AS (SELECT a.id AS sender, b.id AS receiver, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d, {u_sql('a.id', 31)} AS u, ({_wall_sql(0)} OR {_wall_sql(1)}) AS hidden FROM a JOIN b ON b.id = a.id + 1) SELECT sender, receiver, round(d, 6) AS distance, d < 60 + 10 * u AND NOT hidden AS heard FROM j".replace("FROM a JOIN", "FROM b AS a JOIN"))
def comms_acoustic(spark, sf):
    """FLT-13: messages to the next beacon that arrive, by range with noise and a free line of sight."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 53).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"), (-(F.col("s_suppkey") % 13).cast("double") - 0.5).alias("z"))
    near, far = s.select(*[F.col(c).alias(f"a{c}") for c in s.columns]), s.select(*[F.col(c).alias(f"b{c}") for c in s.columns])
    pairs = near.join(far, F.col("bid") == F.col("aid") + 1)
    a, b = ([F.col(f"{side}{n}") for n in "xyz"] for side in "ab")
    distance = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))
    hidden = geometry.segment_meets_box(a, b, *WALLS[0]) | geometry.segment_meets_box(a, b, *WALLS[1])
    return pairs.select(F.col("aid").alias("sender"), F.col("bid").alias("receiver"), r6(distance, "distance"), ((distance < 60 + 10 * noise.uniform(F.col("aid"), 31)) & ~hidden).alias("heard"))


@query("WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size * 2 END AS bins, CASE WHEN p_size % 3 <> 1 THEN p_size / 64.0::DOUBLE END AS res FROM part) SELECT p_partkey, bins IS NOT NULL AND res IS NOT NULL AS both, CASE WHEN res IS NULL THEN bins WHEN bins IS NULL THEN CAST(trunc(99.5 / res) AS INTEGER) END AS bins, CASE WHEN bins IS NULL THEN res WHEN res IS NULL THEN 99.5 / bins END AS res FROM c")
def sonar_bin_config(spark, sf):
    """FLT-20, FN-15: bins by resolution or resolution by bins over 0.5 to 100 m; settings that give both are marked."""
    c = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 2).alias("bins"), F.when(F.col("p_size") % 3 != 1, F.col("p_size") / 64.0).alias("res"))
    bins, res = F.col("bins"), F.col("res")
    return c.select("p_partkey", (bins.isNotNull() & res.isNotNull()).alias("both"), F.when(res.isNull(), bins).when(bins.isNull(), (99.5 / res).cast("int")).alias("bins"), F.when(bins.isNull(), res).when(res.isNull(), 99.5 / bins).alias("res"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, list_transform(range(21), lambda k: {'x': -1.0::DOUBLE + 0.1::DOUBLE * k, 'u': l_tax * 10 - 0.4::DOUBLE + (-1.0::DOUBLE + 0.1::DOUBLE * k) * (l_discount - 0.05::DOUBLE)}) AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, round(-30.0 * list_sum(list_transform(f, lambda p: abs(p.u) * p.u)), 5) + 0.0 AS force, round(-30.0 * list_sum(list_transform(f, lambda p: p.x * abs(p.u) * p.u)), 5) + 0.0 AS moment FROM s""")
def strip_drag(spark, sf):
    """AGG-21: cross-flow drag summed over 21 strips of the hull."""
    force, moment = geometry.strip_loads(F.col("l_tax") * 10 - 0.4, F.col("l_discount") - 0.05, 2.0, 0.6, 1000.0, 1.0)
    return table(spark, sf, "lineitem").select(*KEY, (F.round(force, 5) + 0.0).alias("force"), (F.round(moment, 5) + 0.0).alias("moment"))


@query("SELECT user_id AS agent, max_by(event_type, (ts, event_id)) AS task, max_by(value, (ts, event_id)) AS reward FROM events WHERE contains(event_type, 'i') GROUP BY user_id")
def reward_selection(spark, sf):
    """STM-19: the reward of each agent's last sensor whose name contains a given part."""
    e = table(spark, sf, "events").where(F.col("event_type").contains("i"))
    order = F.struct("ts", "event_id")
    return e.groupBy(F.col("user_id").alias("agent")).agg(F.max_by("event_type", order).alias("task"), F.max_by("value", order).alias("reward"))


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round(atan2(y - 50, x - 25.5), 6) AS azimuth, round(atan2(z + 5, sqrt((x - 25.5) * (x - 25.5) + (y - 50) * (y - 50))), 6) AS elevation, round(sqrt((x - 25.5) * (x - 25.5) + (y - 50) * (y - 50) + (z + 5) * (z + 5)), 6) AS range, -y AS ned_y, -z AS ned_z, round(x / 100, 7) AS client_x, round(-y / 100, 7) AS client_y FROM c")
def beacon_bearings(spark, sf):
    """FN-26, FN-28, FN-37: bearing of a beacon, and the same point in two other frames."""
    x, y, z = xyz()
    ned, client = vehicle.nwu_to_ned([x, y, z]), geometry.to_client_frame(x, y, z)
    seen = cloud(spark, sf).withColumn("b", geometry.bearing(x - 25.5, y - 50, z + 5))
    return seen.select(*KEY, *[r6(F.col(f"b.{n}"), n) for n in ("azimuth", "elevation", "range")], ned[1].alias("ned_y"), ned[2].alias("ned_z"), F.round(client[0], 7).alias("client_x"), F.round(client[1], 7).alias("client_y"))


@query(f"""WITH {CLOUD}, n AS (SELECT *, cos(l_tax * 20) AS nx, sin(l_tax * 20) AS ny, (x * cos(l_tax * 20) + y * sin(l_tax * 20)) AS dot FROM c)
SELECT l_orderkey, l_linenumber, round(2 * dot * nx - x, 5) AS rx, round(2 * dot * ny - y, 5) AS ry, round((x + y + 7.5) / 2, 6) AS range, round(((y + 2 - 1.5) / (y + 2 + 1.5)) * ((y + 2 - 1.5) / (y + 2 + 1.5)) * ((x + 2 - 1.5) / (x + 2 + 1.5)) * ((x + 2 - 1.5) / (x + 2 + 1.5)) * 0.5, 6) AS gain FROM n""")
def sonar_multipath(spark, sf):
    """FN-16, FN-17: specular directions, and range and gain of echoes by way of a second surface."""
    x, y, _ = xyz()
    tilt = F.col("l_tax") * 20
    rx, ry = geometry.reflected([x, y], [F.cos(tilt), F.sin(tilt)])
    distance, gain = vehicle.multipath(x, y, F.lit(7.5), y + 2, x + 2, 1.5, F.lit(0.5))
    return cloud(spark, sf).select(*KEY, F.round(rx, 5).alias("rx"), F.round(ry, 5).alias("ry"), r6(distance, "range"), r6(gain, "gain"))


@query(f"SELECT s_suppkey, round(s_acctbal / 100 + (2 * {u_sql('s_suppkey', 41)} - 1) * 5, 6) AS x, round((2 * {u_sql('s_suppkey', 42)} - 1) * 2, 6) AS y, round(-10 + (2 * {u_sql('s_suppkey', 43)} - 1) * 0.5, 6) AS z FROM supplier")
def start_positions(spark, sf):
    """FN-23: starts moved at random within a span on each axis, drawn from the key."""
    def moved(at, span, seed):
        return at + (2 * noise.uniform(F.col("s_suppkey"), seed) - 1) * span

    return table(spark, sf, "supplier").select("s_suppkey", r6(moved(F.col("s_acctbal") / 100, 5.0, 41), "x"), r6(moved(F.lit(0.0), 2.0, 42), "y"), r6(moved(F.lit(-10.0), 0.5, 43), "z"))


# --- recurrences shared by batch and stream -----------------------------------------------------------------------------

_TURNS = "g AS (SELECT agent, tick, sin(value) / 10 AS g1, sin(value * 2) / 10 AS g2, sin(value * 3) / 10 AS g3, cos(value) AS a1, 0.1::DOUBLE AS a2, 9.8::DOUBLE AS a3, 0.2::DOUBLE AS c1, sin(value) AS c2, 9.7::DOUBLE AS c3, CASE WHEN tick % 3 = 0 THEN value / 100 END AS v1, 0.1::DOUBLE AS v2, 0.05::DOUBLE AS v3 FROM t)"


def _toward(a: str) -> str:
    """Weight and smallest turn that bring the up vector onto one accelerometer's."""
    x, y, z = f"{a}1", f"{a}2", f"{a}3"
    return f"""(SELECT *, exp(-5 * abs({a}n / 9.81::DOUBLE - 1)) AS {a}w, sqrt(greatest(2 * (1 + {x} / {a}n * u1 + {y} / {a}n * u2 + {z} / {a}n * u3), 0)) AS {a}h FROM (SELECT *, sqrt({x} * {x} + {y} * {y} + {z} * {z}) AS {a}n FROM %s))"""


_UP = """(SELECT *, 2 * (x * z - w * y) AS u1, 2 * (y * z + w * x) AS u2, w * w - x * x - y * y + z * z AS u3 FROM
(SELECT agent, tick, p0 / n AS w, p1 / n AS x, p2 / n AS y, p3 / n AS z, b1, b2, b3, a1, a2, a3, c1, c2, c3, v1, v2, v3 FROM (SELECT *, sqrt(p0 * p0 + p1 * p1 + p2 * p2 + p3 * p3) AS n FROM
(SELECT *, w * c - x * r1 * s - y * r2 * s - z * r3 * s AS p0, w * r1 * s + x * c + y * r3 * s - z * r2 * s AS p1, w * r2 * s - x * r3 * s + y * c + z * r1 * s AS p2, w * r3 * s + x * r2 * s - y * r1 * s + z * c AS p3 FROM
(SELECT *, cos(rate * 0.1 / 2) AS c, CASE WHEN rate > 1e-12 THEN sin(rate * 0.1 / 2) / rate ELSE 0.1 / 2 END AS s FROM (SELECT *, sqrt(r1 * r1 + r2 * r2 + r3 * r3) AS rate FROM
(SELECT g.*, k.w, k.x, k.y, k.z, k.b1, k.b2, k.b3, g1 - b1 AS r1, g2 - b2 AS r2, g3 - b3 AS r3 FROM k JOIN g ON g.agent = k.agent AND g.tick = k.tick + 1)))))))"""
_ERR = ", ".join(f"(aw * (a{i} / an * u{j} - a{j} / an * u{i}) / ah + cw * (c{i} / cn * u{j} - c{j} / cn * u{i}) / ch) / total AS e{k}" for k, (i, j) in enumerate(((2, 3), (3, 1), (1, 2)), 1))


@query(f"""WITH RECURSIVE {TICKS}, {_TURNS}, k AS (SELECT agent, 0::BIGINT AS tick, 1.0::DOUBLE AS w, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM (SELECT DISTINCT agent FROM t)
UNION ALL SELECT agent, tick, q0 / n, q1 / n, q2 / n, q3 / n, b1 - 0.05 * e1 * 0.1, b2 - 0.05 * e2 * 0.1, b3 - 0.05 * e3 * 0.1 FROM (SELECT *, sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) AS n FROM
(SELECT *, w * d0 - x * d1 - y * d2 - z * d3 AS q0, w * d1 + x * d0 + y * d3 - z * d2 AS q1, w * d2 - x * d3 + y * d0 + z * d1 AS q2, w * d3 + x * d2 - y * d1 + z * d0 AS q3 FROM
(SELECT *, 1 / m AS d0, 1.5 * e1 / m AS d1, 1.5 * e2 / m AS d2, 1.5 * e3 / m AS d3 FROM (SELECT *, sqrt(1 + 2.25 * (e1 * e1 + e2 * e2 + e3 * e3)) AS m FROM
(SELECT *, {_ERR} FROM (SELECT *, aw + cw + coalesce(CASE WHEN sqrt(v1 * v1 + v2 * v2 + v3 * v3) >= 0.2 THEN least(1.0, sqrt(v1 * v1 + v2 * v2 + v3 * v3)) ELSE 0.0 END, 0.0) + 1e-6 AS total FROM {_toward("c") % (_toward("a") % _UP)})))))))
SELECT agent, tick, round(w, 6) + 0.0 AS qw, round(x, 6) + 0.0 AS qx, round(y, 6) + 0.0 AS qy, round(z, 6) + 0.0 AS qz, round(b1, 6) + 0.0 AS bias1, round(b2, 6) + 0.0 AS bias2, round(b3, 6) + 0.0 AS bias3 FROM k WHERE tick > 0""")
def attitude_bias_fusion(spark, sf):
    """STM-5: attitude and gyro bias of each agent from rates, two accelerometers and, at times, a velocity."""
    v = F.col("value")
    t = ticks(spark, sf).select("agent", F.col("tick").cast("long").alias("tick"), *((F.sin(v * k) / 10).alias(f"g{k}") for k in (1, 2, 3)), F.cos(v).alias("a1"), F.lit(0.1).alias("a2"), F.lit(9.8).alias("a3"), F.lit(0.2).alias("c1"), F.sin(v).alias("c2"), F.lit(9.7).alias("c3"), F.when(F.col("tick") % 3 == 0, v / 100).alias("v1"), F.lit(0.1).alias("v2"), F.lit(0.05).alias("v3"))
    got = runs.walk(t, "agent", ["tick"], t.columns[2:], attitude.bias_fusion(2, 0.1, dvl=True))
    return got.select("agent", "tick", *((F.round(c, 6) + 0.0).alias(n) for c, n in zip(("qw", "qx", "qy", "qz", "bx", "by", "bz"), ("qw", "qx", "qy", "qz", "bias1", "bias2", "bias3"))))


WAY = [(20.0, 10.0, 10.0), (60.0, 30.0, 10.0), (90.0, 45.0, 10.0), (10.0, 5.0, 10.0)]


@query(f"""WITH RECURSIVE {TICKS}, p AS (SELECT agent, tick, value AS x, value / 2 AS y, 10.0::DOUBLE AS z FROM t), w(i, a, b, c) AS (VALUES {", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(WAY))}),
k AS (SELECT agent, 0::BIGINT AS tick, 0 AS i, false AS given, 0.0::DOUBLE AS d FROM (SELECT DISTINCT agent FROM t)
UNION ALL SELECT agent, tick, CAST(CASE WHEN d < 3 THEN i + 1 ELSE i END AS INTEGER), d >= 3, d FROM (SELECT p.agent, p.tick, k.i, sqrt((a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z)) AS d FROM k JOIN p ON p.agent = k.agent AND p.tick = k.tick + 1 LEFT JOIN w ON w.i = k.i))
SELECT agent, tick, i AS waypoint, round(d, 6) AS distance FROM k WHERE tick > 0 AND given""")
def guide_waypoints(spark, sf):
    """STM-6, FLT-17: the waypoint each agent heads for; steps on which one is reached are not given out."""
    t = ticks(spark, sf).select("agent", F.col("tick").cast("long").alias("tick"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"), F.lit(10.0).alias("z"))
    return runs.walk(t, "agent", ["tick"], ["x", "y", "z"], guidance.follower(WAY, 3.0)).select("agent", "tick", "waypoint", r6(F.col("distance"), "distance"))


@query(f"""WITH {TICKS}, m AS (SELECT agent, tick, tick + 1 + event_id % 7 AS due, value FROM t WHERE sensor = 'purchase'), n AS (SELECT *, lead(tick) OVER (PARTITION BY agent ORDER BY tick) AS later FROM m),
d AS (SELECT agent, due, value FROM n WHERE later IS NULL OR later > due)
SELECT agent, due AS tick, value AS heard FROM d UNION ALL SELECT agent, due + 1, NULL FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS e WHERE e.agent = d.agent AND e.due = d.due + 1)""")
def comms_delivery(spark, sf):
    """STM-13: messages heard after their delay, and buffers cleared on the next tick; a later message takes a waiting one's place."""
    t = ticks(spark, sf).where("sensor = 'purchase'").select("agent", F.col("tick").cast("long").alias("tick"), (1 + F.col("event_id") % 7).alias("wait"), F.col("value").alias("heard"))
    return guidance.delivered(t, "agent", "tick", F.col("wait"), "heard")


@query(f"""WITH {TICKS}, r AS (SELECT *, coalesce(sum((sensor = 'view')::INTEGER) OVER (PARTITION BY agent ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM t)
SELECT agent, max(tick) FILTER (sensor = 'view') AS tick, bool_or(sensor = 'error') AS hit, count(*) FILTER (sensor = 'error') AS n, arg_max(value, tick) FILTER (sensor = 'error') AS last FROM r GROUP BY agent, turn HAVING bool_or(sensor = 'view')""")
def latch_read(spark, sf):
    """STM-20: errors since the last view of each agent; a view clears them."""
    t = ticks(spark, sf).select("agent", F.col("tick").cast("long").alias("tick"), "sensor", "value")
    return guidance.latched(t, "agent", ["tick"], F.col("sensor") == "view", F.col("sensor") == "error", F.col("value"))


# --- octrees and views of moving sensors --------------------------------------------------------------------------------

DEPTH = 6
CORNER, SIDE = [0.0, 0.0, -64.0], 128.0
LEAVES = f"v AS (SELECT CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, CAST(floor((z + 64) / 2) AS BIGINT) AS k FROM c), o AS (SELECT " + " + ".join(f"((({a} >> {b}) & 1) << {3 * b + d})" for d, a in enumerate("ijk") for b in range(DEPTH)) + " AS code FROM v WHERE i BETWEEN 0 AND 63 AND j BETWEEN 0 AND 63 AND k BETWEEN 0 AND 63)"


def coded(spark, sf):
    return cloud(spark, sf).withColumn("code", octree.cell_code(list(xyz()), CORNER, SIDE, DEPTH)).where("code IS NOT NULL")


@query(f"WITH {CLOUD}, {LEAVES} SELECT code, code >> 12 AS cell, count(*) AS n FROM o GROUP BY 1")
def octree_round_trip(spark, sf):
    """SNK-7, SRC-10: leaves stored by coarse cell, and read again."""
    path = fresh_path(spark)
    octree.store(coded(spark, sf).groupBy("code").agg(F.count("*").alias("n")), path, "code", DEPTH, 2)
    return octree.load(spark, path)


@query(f"WITH {CLOUD}, {LEAVES}, n AS (SELECT DISTINCT l, code >> (3 * l) AS node FROM o, range(0, 5) q(l)) SELECT node >> (12 - 3 * l) AS cell, count(*) AS nodes, count(*) FILTER (l = 0) AS leaves FROM n GROUP BY 1")
def octree_counts(spark, sf):
    """AGG-14: nodes and leaves of the tree below each coarse cell."""
    return octree.node_counts(coded(spark, sf), "code", DEPTH, 2)


@query("SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, 4.0::DOUBLE AS size, l_returnflag AS material FROM lineitem WHERE l_linenumber < 4 UNION ALL SELECT l_orderkey, CAST(l_quantity AS DOUBLE), CAST(l_linenumber AS DOUBLE), 2.0::DOUBLE, l_returnflag FROM lineitem WHERE l_linenumber >= 4")
def octree_parse(spark, sf):
    """SRC-10: trees in JSON, one for each order, its first lines under the root and the others a level deeper."""
    node = F.struct(F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double"), F.lit(0.0)).alias("p"), F.col("l_returnflag").alias("m"))
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") < 4, node)).alias("near"), F.collect_list(F.when(F.col("l_linenumber") >= 4, node)).alias("far"))
    inner = F.when(F.size("far") > 0, F.concat(F.lit('{"p":[1,1,1],"l":'), F.to_json("far"), F.lit("}")))
    text = F.concat(F.lit('{"p":[0,0,0],"l":['), F.array_join(F.filter(F.array(F.when(F.size("near") > 0, F.regexp_replace(F.to_json("near"), r"^\[|\]$", "")), inner), F.isnotnull), ","), F.lit("]}"))
    got = octree.opened(o.select("l_orderkey", text.alias("tree")), "tree", 8.0).where("leaf")
    return got.select("l_orderkey", "x", "y", "size", "material")


SHIPS = "h AS (SELECT c_custkey, CAST(c_custkey % 50 AS DOUBLE) AS sx, abs(c_acctbal) / 100 AS sy, -0.1::DOUBLE * (c_custkey % 101) AS sz, 0.1::DOUBLE * (c_custkey % 5) AS p, 0.7::DOUBLE * c_custkey AS w, 2.0::DOUBLE + c_custkey % 3 AS far FROM customer)"
# the rotation is Rz(w) Ry(p); points go through its transpose
SIGHT = f"""{CLOUD}, {SHIPS}, d AS (SELECT c_custkey, l_orderkey, l_linenumber, w, p, far, x - sx AS dx, y - sy AS dy, z - sz AS dz FROM h JOIN c ON x BETWEEN sx - 5 AND sx + 5 AND y BETWEEN sy - 5 AND sy + 5),
e AS (SELECT *, cos(w) * cos(p) * dx + sin(w) * cos(p) * dy - sin(p) * dz AS ex, -sin(w) * dx + cos(w) * dy AS ey, cos(w) * sin(p) * dx + sin(w) * sin(p) * dy + cos(p) * dz AS ez FROM d),
g AS (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS r, degrees(atan2(-ey, ex)) AS az, degrees(atan2(sqrt(ex * ex + ey * ey), ez)) AS el, degrees(atan2(sqrt(ey * ey + ez * ez), ex)) AS off FROM e)"""


def seen(spark, sf, view, width):
    s = probes(spark, sf).select("c_custkey", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), (0.1 * (F.col("c_custkey") % 5)).alias("p"), (0.7 * F.col("c_custkey")).alias("w"), F.lit(0.5).alias("close"), (2.0 + F.col("c_custkey") % 3).alias("far"))
    points = cloud(spark, sf).select(F.lit("sea").alias("world"), *KEY, *xyz())
    tree = spatial.packed(spatial.folded(points, "world", ["x", "y", "z"]), "world", ["x", "y", "z"], points)
    ahead = [F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    return spatial.in_view(s, tree, None, ["sx", "sy", "sz"], vehicle.rotation_matrix(F.lit(0.0), F.col("p"), F.col("w")), ("close", "far"), view, F.lit(width), ahead)


@query(f"WITH {SIGHT} SELECT c_custkey, l_orderkey, l_linenumber, round(r, 6) AS r, round(az, 6) AS az FROM g WHERE r > 0.5 AND r < far AND az > -30 AND az < 30 AND el > 60 AND el < 120")
def sonar_view(spark, sf):
    """JN-6, FLT-8: what each of many sensors, with positions and attitudes of their own, has in its frustum."""
    view = lambda s, off: (s["azimuth"] > -30) & (s["azimuth"] < 30) & (s["elevation"] > 60) & (s["elevation"] < 120)
    got = seen(spark, sf, view, 60.0).select("c_custkey", "__copies", r6(F.col("__s.range"), "r"), r6(F.col("__s.azimuth"), "az"))
    return got.select("c_custkey", F.inline("__copies"), "r", "az")


@query(f"WITH {SIGHT} SELECT c_custkey, l_orderkey, l_linenumber, round(r, 6) AS r, round(off, 6) AS off FROM g WHERE r > 0.5 AND r < far AND off < 20")
def sonar_cone(spark, sf):
    """JN-6, FLT-9: what each of many sensors has within its opening angle."""
    got = seen(spark, sf, lambda s, off: off < 20, 20.0).select("c_custkey", "__copies", r6(F.col("__s.range"), "r"), r6(F.col("__off"), "off"))
    return got.select("c_custkey", F.inline("__copies"), "r", "off")


# --- what users bring, and walks of noise ------------------------------------------------------------------------------

_OWN = "CASE WHEN z + 5 > 0 OR x <= 25 THEN 0.0 ELSE ln(x - 25) * y / 10 END"


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round({_OWN}, 6) AS value FROM c")
def field_custom(spark, sf):
    """UDF-1: a user's field as a Column function; what it cannot answer, and what lies above the surface, is 0."""
    x, y, z = xyz()
    mine = custom.field(lambda x, y, z: F.ln(x - 25) * y / 10)
    return cloud(spark, sf).select(*KEY, r6(mine(x, y, z + 5), "value"))


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round({_OWN}, 6) AS value FROM c")
def field_custom_batch(spark, sf):
    """UDF-1: the same field as a numpy function over batches."""
    import numpy as np

    x, y, z = xyz()
    mine = custom.batch_field(lambda x, y, z: np.log(x - 25) * y / 10)
    return cloud(spark, sf).select(*KEY, r6(mine(x, y, z + 5), "value"))


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round(CASE WHEN z + 5 > 0 THEN 0.0 ELSE -y / 61.7::DOUBLE END, 6) + 0.0 AS dx, round(CASE WHEN z + 5 > 0 THEN 0.0 ELSE x / 50 END, 6) AS dy, round(CASE WHEN z + 5 > 0 THEN 0.0 ELSE sin(z + 5) END, 6) + 0.0 AS dz FROM c")
def current_custom(spark, sf):
    """UDF-2: a user's current as a Column function."""
    x, y, z = xyz()
    got = custom.current(lambda x, y, z: (-y / 61.7, x / 50, F.sin(z)))(x, y, z + 5)
    return cloud(spark, sf).select(*KEY, got.alias("d")).select(*KEY, *((F.round(f"d.d{a}", 6) + 0.0).alias(f"d{a}") for a in "xyz"))


_DRAWS = [f"sqrt(-2 * ln(1 - {u_sql('event_id', 11 + 2 * k)})) * cos(2 * pi() * {u_sql('event_id', 12 + 2 * k)})" for k in range(2)]


@query(f"SELECT event_id, round(greatest(-1.0, least(1.0, {_DRAWS[0]})), 6) + 0.0 AS a0, round(greatest(-1.0, least(1.0, {_DRAWS[1]})), 6) + 0.0 AS a1, round(10 * {u_sql('event_id', 21)}, 6) AS own, CAST(3 + floor({u_sql('event_id', 31)} * 5) AS INTEGER) AS step FROM events")
def action_samples(spark, sf):
    """UDF-4: commands drawn for each row: normal ones with bounds, a user's own draw, and whole numbers."""
    key = F.col("event_id")
    normal = custom.action(key, 2, 11, low=F.lit(-1.0), high=F.lit(1.0))
    own = custom.action(key, 1, 21, sample=lambda k, seed: 10 * noise.uniform(k, seed))
    e = table(spark, sf, "events").select("event_id", normal.alias("a"), own.alias("o"), custom.discrete_action(key, 1, 31, 3, 8).alias("s"))
    return e.select("event_id", *((F.round(F.col("a")[k], 6) + 0.0).alias(f"a{k}") for k in range(2)), r6(F.col("o")[0], "own"), F.col("s")[0].alias("step"))


_STEP = f"sqrt(-2 * ln(1 - {u_sql('event_id', 3)})) * cos(2 * pi() * {u_sql('event_id', 4)})"


@query(f"WITH {TICKS}, b AS (SELECT agent, tick, sum(0.01::DOUBLE * {_STEP}) OVER (PARTITION BY agent ORDER BY tick) AS bias FROM t) SELECT agent, tick, round(bias, 6) + 0.0 AS bias, round(sum(bias) OVER (PARTITION BY agent ORDER BY tick), 5) + 0.0 AS drift FROM b")
def nav_bias_walk(spark, sf):
    """WIN-3, WIN-2: a bias that takes a random step each tick, and its sum, in two levels so that runs may be of any length."""
    t = ticks(spark, sf).withColumn("tick", F.col("tick").cast("long"))
    got = ordering.running_sums(t, "agent", ["tick"], {"bias": 0.01 * noise.normal(F.col("event_id"), 3)}, {"bias": "drift"})
    return got.select("agent", "tick", (F.round("bias", 6) + 0.0).alias("bias"), (F.round("drift", 5) + 0.0).alias("drift"))


# --- links between two beams, names and everyone ------------------------------------------------------------------------

MODEMS = "b AS (SELECT s_suppkey AS id, s_nationkey AS n, CAST(s_suppkey % 53 AS DOUBLE) AS x, s_acctbal / 100 AS y, -(s_suppkey % 13) - 0.5::DOUBLE AS z, cos(0.9::DOUBLE * s_suppkey) AS fx, sin(0.9::DOUBLE * s_suppkey) AS fy FROM supplier)"


def modems(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("n"), (k % 53).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"), (-(k % 13).cast("double") - 0.5).alias("z"), F.cos(0.9 * k).alias("fx"), F.sin(0.9 * k).alias("fy"), F.lit(0.0).alias("fz"))


def _within_sql(axis: str, way: str, half: float) -> str:
    (p, q), d = axis.split(), way.split()
    return f"(sqrt({p} * {p} + {q} * {q}) > 0 AND ({p} * ({d[0]}) + {q} * ({d[1]})) > cos(radians({half})) * sqrt({p} * {p} + {q} * {q}) * d)"


@query(f"WITH {MODEMS}, j AS (SELECT a.id, b.id AS other, a.fx AS ax, a.fy AS ay, b.fx AS ox, b.fy AS oy, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d, ({_wall_sql(0)} OR {_wall_sql(1)}) AS hidden FROM b AS a JOIN b ON a.id <> b.id AND a.n = b.n) SELECT id, other, round(d, 6) AS distance FROM j WHERE d <= 60 AND d > 0 AND NOT hidden AND {_within_sql('ax ay', 'dx dy', 75.0)} AND {_within_sql('ox oy', '-dx -dy', 75.0)}")
def comms_beams(spark, sf):
    """FLT-14, FLT-15: pairs of modems of one net that face each other within range, with nothing between them."""
    s = modems(spark, sf)
    b = s.select(*(F.col(c).alias(f"o{c}") for c in s.columns))
    p = comms.in_reach(s, b, "n", "on", [("x", "ox"), ("y", "oy"), ("z", "oz")], 60.0).where("id <> oid")
    cols = lambda *names: [F.col(n) for n in names]
    ends = cols("x", "y", "z"), cols("ox", "oy", "oz")
    facing = p.where(comms.between_beams(*ends, cols("fx", "fy", "fz"), cols("ofx", "ofy", "ofz"), 75.0, []))
    # by a generator, so that walls are looked at after the join, for the few pairs that face each other
    way = facing.select("id", "oid", "distance", F.explode(F.array(F.struct(*ends[0], *ends[1]))).alias("w"))
    start, end = ([F.col(f"w.{c}") for c in names] for names in (("x", "y", "z"), ("ox", "oy", "oz")))
    for low, high in WALLS:
        way = way.where(~geometry.segment_meets_box(start, end, low, high))
    return way.select("id", F.col("oid").alias("other"), r6(F.col("distance"), "distance"))


@query("WITH m AS (SELECT c_custkey AS message, c_nationkey AS net, c_custkey % 100 + 1 AS sender, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_custkey * 7 % 130 END AS goal FROM customer) SELECT message, sender, s_suppkey AS receiver FROM m JOIN supplier ON s_nationkey = net AND s_suppkey <> sender AND (goal = -1 OR goal = s_suppkey)")
def comms_fan_out(spark, sf):
    """JN-9, JN-10: messages to the sensors of their net that they name, or to all but the sender."""
    k = F.col("c_custkey")
    m = table(spark, sf, "customer").select(k.alias("message"), F.col("c_nationkey").alias("net"), (k % 100 + 1).alias("sender"), F.when(k % 4 == 0, -1).otherwise(k * 7 % 130).alias("goal"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("s_net"), F.col("s_suppkey").alias("id"))
    return comms.sent_to(m, s.withColumnRenamed("s_net", "net"), "net", "sender", "goal", "id").select("message", "sender", "receiver")


@query("SELECT n_name, s_suppkey, s_name FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def first_by_tag(spark, sf):
    """JN-11: the first actor that carries each tag; tags that no one carries give nulls."""
    first = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min(F.struct("s_suppkey", "s_name")).alias("a"))
    return table(spark, sf, "nation").join(first, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", "a.s_suppkey", "a.s_name")


# --- control, noise, vectors and settings ------------------------------------------------------------------------------


@query(f"WITH {TICKS}, g AS (SELECT agent, tick, value, CASE WHEN 170 - value * 4 >= 180 THEN 170 - value * 4 - 360 WHEN 170 - value * 4 <= -180 THEN 170 - value * 4 + 360 ELSE 170 - value * 4 END AS e FROM t), a AS (SELECT *, sum(0.05::DOUBLE * (e + p)) OVER (PARTITION BY agent ORDER BY tick) AS area FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY agent ORDER BY tick), 0) AS p FROM g)) SELECT agent, tick, round(2.0 * e + 0.1::DOUBLE * area - 0.5 * value / 10, 6) AS command FROM a")
def control_pid_angle(spark, sf):
    """STM-7: a PID controller of an angle, given its rate."""
    t = ticks(spark, sf).select("agent", F.col("tick").cast("long").alias("tick"), (F.col("value") * 4).alias("angle"), (F.col("value") / 10).alias("rate"))
    got = control.pid_direct(t, "agent", ["tick"], "angle", "rate", 170.0, 0.1, (2.0, 0.1, 0.5), turn=360.0)
    return got.select("agent", "tick", r6(F.col("command"), "command"))


_SIDES = "p AS (SELECT l_orderkey, l_linenumber, (x - 25) * 4 AS surge, (y - 50) / 10 AS yaw FROM c), f AS (SELECT *, (surge + yaw / 0.395::DOUBLE) / 2 AS a, (surge - yaw / 0.395::DOUBLE) / 2 AS b FROM p)"


@query(f"WITH {CLOUD}, {_SIDES} SELECT l_orderkey, l_linenumber, round(sign(a) * sqrt(abs(a) / CASE WHEN a > 0 THEN 0.0221::DOUBLE ELSE 0.0129::DOUBLE END), 6) + 0.0 AS left_turns, round(sign(b) * sqrt(abs(b) / CASE WHEN b > 0 THEN 0.0221::DOUBLE ELSE 0.0129::DOUBLE END), 6) + 0.0 AS right_turns FROM f")
def control_allocation(spark, sf):
    """FN-40: turns of two propellers for a surge force and a yaw moment."""
    x, y, _ = xyz()
    left, right = control.allocated((x - 25) * 4, (y - 50) / 10, 0.395, 0.0221, 0.0129)
    return cloud(spark, sf).select(*KEY, (F.round(left, 6) + 0.0).alias("left_turns"), (F.round(right, 6) + 0.0).alias("right_turns"))


_N = [f"sqrt(-2 * ln(1 - {u_sql(KEYED, 41 + 2 * k)})) * cos(2 * pi() * {u_sql(KEYED, 42 + 2 * k)})" for k in range(2)]


@query(f"WITH n AS (SELECT l_returnflag, 2.0 * {_N[0]} AS a, 0.5 * {_N[0]} + sqrt(0.75::DOUBLE) * {_N[1]} AS b, 1.5 * sqrt({_N[0]} * {_N[0]} + {_N[1]} * {_N[1]}) AS r FROM lineitem) SELECT l_returnflag, round(var_pop(a), 5) AS aa, round(covar_pop(a, b), 5) AS ab, round(var_pop(b), 5) AS bb, round(avg(r), 5) AS rayleigh FROM n GROUP BY 1")
def noise_covariance(spark, sf):
    """FN-20, FN-21: noise of a given covariance, and Rayleigh noise, by their moments."""
    key = F.concat_ws("-", *KEY)
    a, b = noise.correlated(key, 41, noise.factor_of([[4.0, 1.0], [1.0, 1.0]], 2))
    n = table(spark, sf, "lineitem").select("l_returnflag", a.alias("a"), b.alias("b"), noise.rayleigh(key, 41, 1.5).alias("r"))
    m = lambda c, name: F.round(c, 5).alias(name)
    return n.groupBy("l_returnflag").agg(m(F.var_pop("a"), "aa"), m(F.covar_pop("a", "b"), "ab"), m(F.var_pop("b"), "bb"), m(F.avg("r"), "rayleigh"))


@query(f"WITH {CLOUD} SELECT l_orderkey, l_linenumber, round(y * 3 - z * 2, 6) AS cross_x, round(z - x * 3, 6) AS cross_y, round(x * 2 - y, 6) AS cross_z, round((0.3 * x + 0.2 * y) / 0.5, 6) AS rate FROM c")
def vector_ops(spark, sf):
    """FN-33, FN-43: a cross product by the skew matrix, and two gyros blended."""
    x, y, z = xyz()
    c = vehicle.applied(vehicle.skew([x, y, z]), [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    return cloud(spark, sf).select(*KEY, *(r6(v, f"cross_{n}") for v, n in zip(c, "xyz")), r6(vehicle.blended_rate(x, y), "rate"))


@query("SELECT o_orderkey, CASE WHEN b = 0 THEN '0B' ELSE CAST(round(b / pow(1024.0, p), 2) AS VARCHAR) || ' ' || ['B', 'KB', 'MB', 'GB'][p + 1] END AS size FROM (SELECT *, CAST(CASE WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS INTEGER) AS p FROM (SELECT o_orderkey, o_orderkey % 7 * CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 37 ELSE 1009 END AS b FROM orders))")
def readable_sizes(spark, sf):
    """FN-49: sizes in bytes, in words."""
    k = F.col("o_orderkey")
    size = k % 7 * F.floor("o_totalprice") * F.when(k % 3 == 0, 1).when(k % 3 == 1, 37).otherwise(1009)
    return table(spark, sf, "orders").select("o_orderkey", vehicle.readable_size(size).alias("size"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'AccelSigma, AccelCov' WHEN c_custkey % 5 = 0 AND c_custkey % 7 = 0 THEN 'AngVelSigma, AngVelCov' END AS twice, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '0.01' END AS accel, CASE WHEN c_custkey % 5 = 0 THEN 'a' ELSE '0.02' END AS angular, 'true' AS bias FROM customer")
def settings_merge(spark, sf):
    """JN-15, FLT-20: given settings over defaults, and which noise is set both by deviation and by covariance."""
    k = F.col("c_custkey")
    entries = [(k % 2 == 0, "AccelSigma", k.cast("string")), (k % 3 == 0, "AccelCov", F.lit("c")), (k % 5 == 0, "AngVelSigma", F.lit("a")), (k % 7 == 0, "AngVelCov", F.lit("d"))]
    given = F.map_from_entries(F.filter(F.array(*(F.when(on, F.struct(F.lit(n).alias("k"), v.alias("v"))) for on, n, v in entries)), F.isnotnull))
    defaults = F.create_map(*(F.lit(v) for v in ("AccelSigma", "0.01", "AngVelSigma", "0.02", "ReturnBias", "true")))
    c = table(spark, sf, "customer").select("c_custkey", given.alias("given"))
    c = c.select("c_custkey", noise.exclusive(F.col("given"), [("AccelSigma", "AccelCov"), ("AngVelSigma", "AngVelCov")]).alias("twice"), readers.merged(defaults, F.col("given")).alias("m"))
    return c.select("c_custkey", "twice", F.col("m")["AccelSigma"].alias("accel"), F.col("m")["AngVelSigma"].alias("angular"), F.col("m")["ReturnBias"].alias("bias"))


@query("SELECT n_nationkey, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_decode(spark, sf):
    """FN-46: text out of bytes, in arrays and maps too."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = n.select("n_nationkey", F.create_map(F.lit("names"), F.array(F.encode("n_name", "UTF-8"), F.encode("r_name", "UTF-8"))).alias("m"))
    got = raw.select("n_nationkey", vehicle.decoded(F.col("m"), raw.schema["m"].dataType.simpleString())["names"].alias("t"))
    return got.select("n_nationkey", F.col("t")[0].alias("name"), F.col("t")[1].alias("region"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def head_rows(spark, sf):
    """SRT-3: the first rows in an order; a top-k, the limit is the feature."""
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY md5(event_id || ':42'), event_id) - 1) // 512 AS BIGINT) AS batch FROM events")
def mini_batches(spark, sf):
    """SRT-5, SRT-4: rows shuffled by hash into batches of 512."""
    return learning.batched(table(spark, sf, "events").select("event_id"), "event_id", 512)


_TILT = "t AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * -100 AS z, CASE l_returnflag WHEN 'A' THEN 0.3::DOUBLE WHEN 'N' THEN -0.8::DOUBLE ELSE 1.2::DOUBLE END AS w, 0.25::DOUBLE AS p FROM lineitem)"


@query(f"WITH {_TILT}, g AS (SELECT DISTINCT l_returnflag, w, p FROM t) SELECT l_returnflag, round(cos(w) * cos(p), 6) AS m0, round(-sin(w), 6) AS m1, round(cos(w) * sin(p), 6) AS m2, round(sin(w) * cos(p), 6) AS m3, round(cos(w), 6) AS m4, round(sin(w) * sin(p), 6) AS m5, round(-sin(p), 6) AS m6, 0.0::DOUBLE AS m7, round(cos(p), 6) AS m8 FROM g")
def attitude_from_vectors(spark, sf):
    """ML-8, AGG-16: the rotation of each group from its vectors seen from the body and from the world."""
    x, y, z = xyz()
    f = F.col("l_returnflag")
    w = F.when(f == "A", 0.3).when(f == "N", -0.8).otherwise(1.2)
    turned = vehicle.applied(vehicle.rotation_matrix(F.lit(0.0), F.lit(0.25), w), [x, y, z])
    c = cloud(spark, sf).select(f, x, y, z, *(v.alias(f"w{n}") for v, n in zip(turned, "xyz")), "l_tax")
    got = attitude.aligned(c, "l_returnflag", ["x", "y", "z"], ["wx", "wy", "wz"], F.col("l_tax") + 0.01)
    return got.select("l_returnflag", *((F.round(F.col("m")[k], 6) + 0.0).alias(f"m{k}") for k in range(9)))


# --- files written and read again ---------------------------------------------------------------------------------------


@query(f"WITH {CLOUD} SELECT x, y, -z AS sonar_depth FROM c WHERE l_linenumber <= 2")
def log_round_trip(spark, sf):
    """SNK-1, SRC-1, SRC-3: a log written in two appends, and all its files read again."""
    path = fresh_path(spark)
    x, y, z = xyz()
    for k in (1, 2):
        sinks.csv_log(cloud(spark, sf).where(F.col("l_linenumber") == k).select(x, y, (-z).alias("sonar_depth")), path)
    return readers.csv_log(spark, f"{path}/part-*", readers.MAP_LOG)


@query(f"WITH {CLOUD} SELECT CAST(l_linenumber AS INTEGER) AS ping, count(*) AS n, round(sum(y), 2) AS total FROM c WHERE x < 10 GROUP BY 1")
def ping_round_trip(spark, sf):
    """SNK-2: points in one folder a ping, read again by folder."""
    path = fresh_path(spark)
    sinks.by_ping(cloud(spark, sf).where("x < 10").select(F.col("l_linenumber").alias("ping"), *xyz()), path, "ping")
    back = spark.read.option("recursiveFileLookup", "false").schema("x double, y double, z double, ping int").csv(path, header=True)
    return back.groupBy("ping").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("total"))


@query(f"WITH {SIDES} SELECT c_custkey, nid AS nearest_id, dist AS distance FROM n WHERE dist < 1.5")
def prediction_round_trip(spark, sf):
    """SNK-3: close matches under a name with the prefix, read again."""
    where = sinks.predictions(matched(spark, sf).select("c_custkey", "nearest_id", "distance"), fresh_path(spark), "map.csv", "distance", 1.5)
    return spark.read.schema("c_custkey long, nearest_id long, distance double").csv(where, header=True)


@query(f"""WITH {TICKS} SELECT 'depth' AS channel, CAST(floor(1000 * tick / 30) AS BIGINT) AS timestamp, '{{"agent":' || agent || ',"sensor":"' || sensor || '"}}' AS payload FROM t""")
def message_payloads(spark, sf):
    """SNK-4: readings as typed messages with a time and a payload in JSON."""
    return sinks.messages(ticks(spark, sf).select("agent", "tick", "sensor"), "depth", "tick", 30)


@query("""WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 > 0 THEN 30 * (s_suppkey % 3) END AS rate FROM supplier)
SELECT 's' || k AS name, CAST(coalesce(rate, 30) AS INTEGER) AS ticks_per_sec, 'imu' AS sensor_name, 15.0::DOUBLE AS hz, CAST(coalesce(rate, 30) / 15 AS INTEGER) AS tick_every FROM s
UNION ALL SELECT 's' || k, CAST(coalesce(rate, 30) AS INTEGER), 'DVLSensor', CASE WHEN k % 2 = 0 THEN 45.0 ELSE coalesce(rate, 30) END, CAST(CASE WHEN k % 2 = 0 THEN CASE WHEN coalesce(rate, 30) >= 45 THEN floor(coalesce(rate, 30) / 45.0) END ELSE 1 END AS INTEGER) FROM s""")
def scenario_round_trip(spark, sf):
    """SRC-7: scenarios in JSON, read with their defaults, and how often each sensor reads."""
    k = F.col("s_suppkey")
    imu = F.struct(F.lit("IMUSensor").alias("sensor_type"), F.lit("imu").alias("sensor_name"), F.lit(15.0).alias("Hz"))
    dvl = F.struct(F.lit("DVLSensor").alias("sensor_type"), F.lit(None).cast("string").alias("sensor_name"), F.when(k % 2 == 0, 45.0).alias("Hz"))
    agent = F.struct(F.lit("auv0").alias("agent_name"), F.array(imu, dvl).alias("sensors"))
    body = F.struct(F.concat(F.lit("s"), k).alias("name"), F.when(k % 3 > 0, 30 * (k % 3)).alias("ticks_per_sec"), F.array(agent).alias("agents"))
    path = fresh_path(spark)
    table(spark, sf, "supplier").select(F.to_json(body)).write.text(path)
    return readers.sensors_of(readers.scenarios(spark, path, lines=True)).select("name", "ticks_per_sec", "sensor_name", "hz", "tick_every")


@query("WITH m AS (SELECT p_brand AS material, floor(avg(p_retailprice)) * 3 AS density, 1480.0::DOUBLE AS speed FROM part WHERE p_brand < 'Brand#4' GROUP BY 1) SELECT material, density * speed AS impedance FROM m UNION ALL SELECT DISTINCT p_brand, 1e8 FROM part WHERE p_brand IS NOT NULL AND p_brand NOT IN (SELECT material FROM m)")
def material_write_back(spark, sf):
    """SNK-8: materials that the files lack are appended with a default, and all of them read again."""
    part, path = table(spark, sf, "part"), fresh_path(spark)
    known = part.where("p_brand < 'Brand#4'").groupBy(F.col("p_brand").alias("material")).agg((F.floor(F.avg("p_retailprice")) * 3).cast("double").alias("density"), F.lit(1480.0).alias("sound_speed"))
    known.write.csv(path, header=True)
    sinks.add_missing_materials(part, path, "p_brand", 1e5, 1e3)
    return readers.materials(spark, path).select("material", "impedance")
