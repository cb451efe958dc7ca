"""Places and running sums in order, for groups and runs of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.storage import settle


def in_parts(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df sorted by `by` and `order` (nulls first) over range partitions and settled, with `__at`: rows ascend by it, and
    its bits from the 33rd on name the partition.  Equal rows stay in the order of the input and are dealt over
    partitions like any others."""
    keys = [by, *order, "__tie"]
    spread = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settle(spread.drop("__tie").withColumn("__at", F.monotonically_increasing_id()))


def part() -> Column:
    """The partition of a row of in_parts()."""
    return F.shiftright("__at", 33)


def places(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with `__place`, the row's place (long, from 0) in its group, and the group's `__size`.

    No window holds a group: the rows before a partition are counted over one row for each group and partition.
    """
    spread = in_parts(df, by, order)
    parts = spread.groupBy(F.col(by).alias("__by"), part().alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("__by")
    before = F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = settle(parts.select("__by", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("__size")))
    met = spread.join(starts, (part() == F.col("__part")) & F.col(by).eqNullSafe(F.col("__by")))
    return met.select(*df.columns, (F.col("__at") + F.col("__shift")).alias("__place"), "__size")


def running_sums(df: DataFrame, by: str, order: list[str], values: dict[str, Column], twice: dict[str, str] | None = None) -> DataFrame:
    """df with the running sum of each value over a run's rows up to the row itself; `twice` names, for some of them, a
    column for the running sum of that running sum.

    In two levels: sums within a partition's share of the run, then offsets over one row for each run and partition, so
    that a run of any length is spread over tasks.  The second sum needs no second pass: a row's share of it is the sum
    within the partition plus the offset of the first sum for every row since the partition began.  Null values count as 0.
    """
    twice = twice or {}
    spread = in_parts(df.withColumns({n: F.coalesce(v, F.lit(0.0)) for n, v in values.items()}), by, order).withColumn("__part", part())
    upto = Window.partitionBy(by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inside = spread.withColumns({**{f"__{n}": F.sum(n).over(upto) for n in values}, "__k": F.row_number().over(upto)})
    inside = inside.withColumns({f"__{n}2": F.sum(f"__{n}").over(upto) for n in twice})

    last = F.max(F.struct("__k", *(f"__{n}" for n in values), *(f"__{n}2" for n in twice))).alias("__last")
    parts = inside.groupBy(by, "__part").agg(last)
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    starts = parts.withColumns({f"__{n}0": zero(F.sum(F.col(f"__last.__{n}")).over(before)) for n in values})
    starts = starts.withColumns({f"__{n}20": zero(F.sum(F.col(f"__last.__{n}2") + F.col("__last.__k") * F.col(f"__{n}0")).over(before)) for n in twice})
    starts = settle(starts.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), *(f"__{n}0" for n in values), *(f"__{n}20" for n in twice)))
    met = inside.join(starts, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")))
    sums = {n: F.col(f"__{n}0") + F.col(f"__{n}") for n in values} | {m: F.col(f"__{n}20") + F.col(f"__{n}2") + F.col("__k") * F.col(f"__{n}0") for n, m in twice.items()}
    return met.select(*(c for c in df.columns if c not in sums), *(c.alias(n) for n, c in sums.items()))
