"""Sonar post-processing: points, bins, images, occlusion, and range queries over a leaf table."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.profiles import axis, normalised, quantised


def bright_bins(pings: DataFrame, profile: str, ping: str, over: int, r_min: float, r_max: float, bins: int) -> DataFrame:
    """Bins whose 8-bit value is over a threshold, with range, beam angle and local y, z."""
    cells = pings.select(ping, F.posexplode(quantised(normalised(F.col(profile)))).alias("bin", "level")).where(F.col("level") > over)
    r, theta = axis(r_min, r_max, bins, F.col("bin")), axis(-pi / 4, pi / 4, bins, F.col("bin"))
    return cells.withColumn("r", r).withColumn("theta", theta).withColumn("y", F.col("r") * F.sin("theta")).withColumn("z", -F.col("r") * F.cos("theta"))


def bin_average(points: DataFrame, keys: list[str], index: Column, value: str, bins: int) -> DataFrame:
    """Mean value in each bin of each key; bins without a point are there too, with 0."""
    sums = points.withColumn("bin", index).where(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    every = points.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(sums, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def folded_index(range_index: Column, starboard: Column, bins: int) -> Column:
    """The place of a range bin on a two-sided axis."""
    half = F.floor(range_index / 2)
    return F.when(starboard, bins // 2 - half - 1).otherwise(bins // 2 + half).cast("int")


def image(points: DataFrame, keys: list[str], value: str, perfect: str, streaks: int = 0, share: float = 0.08) -> DataFrame:
    """Mean by (range, azimuth) cell; rows of a range with enough perfect normals are darkened (-1) or brightened (1)."""
    cells = points.groupBy(*keys, "r_bin", "a_bin").agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.sum(F.col(perfect).cast("int")).alias("perfect"))
    row = Window.partitionBy(*keys, "r_bin")
    cells = cells.withColumn("row_share", F.sum("perfect").over(row) / F.sum("n").over(row))
    changed = F.col("mean") * F.col("mean") if streaks == -1 else 1 - (1 - F.col("mean")) * (1 - F.col("mean")) if streaks == 1 else F.col("mean")
    return cells.withColumn("mean", F.when(F.col("row_share") >= share, changed).otherwise(F.col("mean")))


def unoccluded(points: DataFrame, keys: list[str], distance: str, tie: str, gap: float) -> DataFrame:
    """Per key, by distance: everything up to the first gap over the given one."""
    w = Window.partitionBy(*keys).orderBy(distance, tie)
    far = F.coalesce((F.col(distance) - F.lag(distance).over(w) > gap).cast("int"), F.lit(0))
    return points.withColumn("__far", far).withColumn("__cut", F.sum("__far").over(w)).where("__cut = 0").drop("__far", "__cut")


def run_starts(points: DataFrame, keys: list[str], order: list[str], index: str) -> DataFrame:
    """The first row of each run of equal indices."""
    before = F.lag(index).over(Window.partitionBy(*keys).orderBy(*order))
    return points.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col(index))).drop("__before")


def in_frustum(leaves: DataFrame, r: tuple[float, float], azimuth: tuple[float, float], elevation: tuple[float, float], axes=("x", "y", "z")) -> DataFrame:
    """Leaves strictly inside a sensor's view at the origin.

    Plain bounds on the coordinates come first; they reach the scan, so a table sorted by a coordinate or a cell prunes row groups.
    """
    from tidewater.functions.geometry import spherical

    x, y, z = (F.col(a) for a in axes)
    near = [c.between(-r[1], r[1]) for c in (x, y, z)]
    seen = leaves.where(near[0] & near[1] & near[2]).withColumn("__s", spherical(x, y, z))
    s = lambda c, lim: (F.col(f"__s.{c}") > lim[0]) & (F.col(f"__s.{c}") < lim[1])
    return seen.where(s("range", r) & s("azimuth", azimuth) & s("elevation", elevation)).select(*leaves.columns, "__s.*")


def with_impedance(rows: DataFrame, materials: DataFrame, name: str, default: float = 1e8) -> DataFrame:
    """Adds z = density * sound speed by material; unknown materials get the default."""
    known = materials.select(F.col("material").alias("__m"), (F.col("density") * F.col("sound_speed")).alias("__z"))
    return rows.join(known, F.col(name) == F.col("__m"), "left").withColumn("impedance", F.coalesce("__z", F.lit(default))).drop("__m", "__z")
