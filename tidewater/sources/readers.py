"""Readers for survey files, scenarios and materials, and generated grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP_LOG = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "sonar_depth")])
ERROR_LOG = T.StructType([T.StructField("step", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("gt_x", "gt_y", "gt_z", "dr_x", "dr_y", "dr_z", "error"))])
POINT_CLOUD = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "r", "theta")])
IMU_LOG = T.StructType([T.StructField("step", T.LongType()), *(T.StructField(f"imu{i}_{k}{a}", T.DoubleType()) for i in (1, 2) for k in "ag" for a in "xyz")])


def csv_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One CSV file or a folder or glob of them, with a header; cells that do not parse are null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def dirty_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, with the file name, for cleaning later."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True).select("*", F.col("_metadata.file_name").alias("file"))


SENSOR = T.StructType([T.StructField(c, T.StringType()) for c in ("sensor_type", "sensor_name", "socket", "lcm_channel")] + [T.StructField("Hz", T.DoubleType()), T.StructField("configuration", T.MapType(T.StringType(), T.StringType()))])
AGENT = T.StructType([T.StructField("agent_name", T.StringType()), T.StructField("agent_type", T.StringType()), T.StructField("control_scheme", T.IntegerType()), T.StructField("location", T.ArrayType(T.DoubleType())), T.StructField("rotation", T.ArrayType(T.DoubleType())), T.StructField("sensors", T.ArrayType(SENSOR))])
SCENARIO = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "world", "package_name", "main_agent")] + [T.StructField("ticks_per_sec", T.IntegerType()), T.StructField("agents", T.ArrayType(AGENT))])


def scenarios(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scenario files, one row each; with `lines`, files with one scenario in each line."""
    return spark.read.schema(SCENARIO).json(path, multiLine=not lines)


def sensors_of(scenarios_: DataFrame) -> DataFrame:
    """One row for each sensor, with defaults filled in and the ticks between its readings."""
    flat = scenarios_.select("name", F.coalesce("ticks_per_sec", F.lit(30)).alias("ticks_per_sec"), F.explode("agents").alias("a")).select("name", "ticks_per_sec", "a.agent_name", F.explode("a.sensors").alias("s"))
    rate = F.coalesce("s.Hz", F.col("ticks_per_sec").cast("double"))
    return flat.select("name", "ticks_per_sec", "agent_name", "s.sensor_type", F.coalesce("s.sensor_name", "s.sensor_type").alias("sensor_name"), rate.alias("hz"), F.when(rate <= F.col("ticks_per_sec"), F.floor(F.col("ticks_per_sec") / rate).cast("int")).alias("tick_every"), "s.configuration")


def merged(defaults: Column, given: Column) -> Column:
    """Given settings over defaults (maps)."""
    kept = F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(given, F.create_map().cast("map<string,string>")))


def materials(spark: SparkSession, path: str) -> DataFrame:
    """material, density, sound_speed and their product, the impedance."""
    schema = T.StructType([T.StructField("material", T.StringType()), T.StructField("density", T.DoubleType()), T.StructField("sound_speed", T.DoubleType())])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True).withColumn("impedance", F.col("density") * F.col("sound_speed"))


def linspace(low: float, high: float, n: int, index: Column) -> Column:
    return F.lit(low) if n == 1 else low + index * ((high - low) / (n - 1))


def mesh(spark: SparkSession, x: tuple[float, float, int], y: tuple[float, float, int]) -> DataFrame:
    """Rows (i, j, x, y) of a grid, generated where they are used."""
    cells = spark.range(x[2] * y[2]).select((F.col("id") % x[2]).cast("int").alias("i"), F.floor(F.col("id") / x[2]).cast("int").alias("j"))
    return cells.select("i", "j", linspace(*x, F.col("i")).alias("x"), linspace(*y, F.col("j")).alias("y"))


def lattice(spark: SparkSession, extents: list[tuple[float, float]], cell: float, spacing: int) -> DataFrame:
    """Every spacing-th cell of a box, as x, y, z."""
    step = cell * spacing
    n = [int((b - a) // step) + 1 for a, b in extents]
    at = spark.range(n[0] * n[1] * n[2])
    i, j, k = F.col("id") % n[0], F.floor(F.col("id") / n[0]) % n[1], F.floor(F.col("id") / (n[0] * n[1]))
    return at.select(*((extents[d][0] + c * step).alias("xyz"[d]) for d, c in enumerate((i, j, k))))


def centred(n: int, spacing: float) -> Column:
    """n values around 0, `spacing` apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i - (n - 1) / 2) * spacing)
