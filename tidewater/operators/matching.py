"""Survey files: cleaning, map matching by class, and checks on the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import spatial


def cleaned(df: DataFrame, numbers: list[str], label: str) -> DataFrame:
    """Numbers coerced, header rows inside the data and incomplete rows dropped (NaN counts as missing)."""
    rows = df.where(F.col(label) != label)
    for c in numbers:
        rows = rows.withColumn(c, F.expr(f"nullif(try_cast(`{c}` AS DOUBLE), double('NaN'))"))
    return rows.na.drop(subset=[*numbers, label])


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def nearest_in_class(probes: DataFrame, places: DataFrame, label: str, axes: list[str], probe_id: str, place_id: str) -> DataFrame:
    """For each probe the nearest place of its class, ties to the smallest place id; null where the class is unknown.

    Goes down a tree of boxes for each class (operators.spatial); places at one spot count as the smallest of them.
    """
    spots = places.groupBy(label, *axes).agg(F.min(place_id).alias(place_id))
    return spatial.nearest(probes, spatial.packed(spots, label, axes), [probe_id], label, place_id)


def nearest_to(at: list[float], places: DataFrame, axes: list[str], place_id: str) -> DataFrame:
    """distance, nearest_id and coordinates of the place nearest to one point: one scan, one row from each task."""
    gap = distance([F.lit(float(v)) for v in at], [F.col(a) for a in axes])
    best = F.min(F.struct(gap.alias("distance"), F.col(place_id).alias("nearest_id"), *(F.col(a).alias(f"nearest_{a}") for a in axes))).alias("best")
    return places.agg(best).where("best IS NOT NULL").select("best.*")


def reprojected(y: Column, z: Column, r: Column, theta: Column) -> tuple[Column, Column]:
    """The sensor's y and z as seen from the matched place."""
    return y - r * F.sin(theta), z + r * F.cos(theta)


def residual(y, z, r, theta, calc_y, calc_z) -> Column:
    return ((y + r * F.sin(theta)) - calc_y) - ((z - r * F.cos(theta)) - calc_z)
