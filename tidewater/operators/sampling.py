"""Sampling and time alignment of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_tick(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Numbers the readings of each agent from 1 in time order."""
    return df.withColumn("tick", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def every_for(rate_hz: float, ticks_per_second: int) -> int:
    """Ticks between readings, truncated; a rate over the clock is refused."""
    if rate_hz > ticks_per_second:
        raise ValueError("a sensor cannot be read more often than the clock ticks")
    return int(ticks_per_second / rate_hz)


def rate_filter(df: DataFrame, rate_hz: float, ticks_per_second: int = 30, tick: str = "tick") -> DataFrame:
    """The ticks on which a sensor of this rate reports; tick 0 is one."""
    return df.where(F.col(tick) % every_for(rate_hz, ticks_per_second) == 0)


def align(df: DataFrame, keys: list[str], sensor: str, value: str, sensors: list[str]) -> DataFrame:
    """One row for each key, sensors as columns; a sensor without a reading is null."""
    return df.groupBy(*keys).pivot(sensor, sensors).agg(F.avg(value))


def last_known(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it (an as-of join by one sort, without a range join).

    Right values at the same time as a left row count; of right rows at the same time the largest value is taken.
    """
    held = right.groupBy(by, at).agg(F.max(value).alias("__held")).withColumn("__side", F.lit(0))
    both = left.withColumn("__side", F.lit(1)).unionByName(held, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"last_{value}", F.last("__held", ignorenulls=True).over(w)).where("__side = 1").drop("__held", "__side")


def changes(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows at which a value differs from the one before (the first row too)."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("__before", before).where(~F.col(value).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")


def waterfall(df: DataFrame, order: str, last: int) -> DataFrame:
    """The last rows by order, as a top-k (no global sort)."""
    return df.orderBy(F.desc(order)).limit(last)
