"""Following waypoints, messages that take time, and events that a reading clears."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.runs import Recurrence


def follower(targets: list[tuple[float, ...]], reach: float) -> Recurrence:
    """Index of the waypoint a run is heading for, its distance, and the error on each axis.

    A position closer to the target than `reach` moves on to the next one and is not given out, nor is anything after the
    last target.  Positions with a null are not given out and reach nothing.
    """

    def step(state, *at):
        (index,) = state
        if index >= len(targets) or None in at:
            return state, None
        error = [t - v for t, v in zip(targets[index], at)]
        far = math.sqrt(sum(e * e for e in error))
        return ((index + 1,), None) if far < reach else (state, (index, far, *error))

    axes = ", ".join(f"error{k} double" for k in range(len(targets[0])))
    return Recurrence((0,), step, "waypoint int", f"waypoint int, distance double, {axes}")


def delivered(sent: DataFrame, to: str, tick: str, delay: Column, payload: str) -> DataFrame:
    """(to, tick, payload) at the ticks where a receiver's buffer changes: the message, `delay` ticks after it was sent, and
    null on the next tick, unless another message comes in then.

    A receiver waits for one message: a later one that is sent before or at the arrival takes its place.  Of several
    messages in one tick the largest payload counts.  Rows with a null receiver, tick or delay are left out.
    One window over a receiver's messages, none over ticks.
    """
    rows = sent.select(F.col(to), F.col(tick), (F.col(tick) + delay).alias("__at"), F.col(payload)).where(F.col(to).isNotNull() & F.col("__at").isNotNull())
    one = rows.groupBy(to, tick).agg(F.max(F.struct(payload, "__at")).alias("__m")).select(to, tick, f"__m.{payload}", "__m.__at")
    w = Window.partitionBy(to).orderBy(tick)
    came = one.withColumn("__next", F.lead(tick).over(w)).where("__next IS NULL OR __next > __at")
    came = came.withColumn("__then", F.lead("__at").over(Window.partitionBy(to).orderBy("__at")))
    full = F.struct(F.col("__at").alias(tick), F.col(payload))
    empty = F.struct((F.col("__at") + 1).alias(tick), F.lit(None).cast(sent.schema[payload].dataType).alias(payload))
    changes = F.when(F.col("__then") == F.col("__at") + 1, F.array(full)).otherwise(F.array(full, empty))
    return came.select(to, F.explode(changes).alias("__c")).select(to, f"__c.{tick}", f"__c.{payload}")


def latched(rows: DataFrame, by: str, order: list[str], read: Column, event: Column, value: Column) -> DataFrame:
    """by, order, `hit` (was there an event since the reading before), `n` of them and the `last` value, for every reading.

    A reading clears what it gives out; an event in the reading's own row counts for that reading.  Null conditions are false.
    """
    w = Window.partitionBy(by).orderBy(*order)
    marked = rows.select(by, *order, F.coalesce(read, F.lit(False)).alias("__read"), F.coalesce(event, F.lit(False)).alias("__event"), value.alias("__value"))
    # readings up to the row before: rows with the same number belong to one reading
    turn = F.coalesce(F.sum(F.col("__read").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.struct(*order)
    grouped = marked.withColumn("__turn", turn).groupBy(by, "__turn").agg(F.bool_or("__event").alias("hit"), F.sum(F.col("__event").cast("long")).alias("n"), F.max_by("__value", F.when(F.col("__event"), at)).alias("last"), F.max(F.when(F.col("__read"), at)).alias("__at"))
    return grouped.where("__at IS NOT NULL").select(by, *(F.col(f"__at.{c}").alias(c) for c in order), "hit", "n", "last")


def latch() -> Recurrence:
    """latched() as a recurrence over (read, event, value) rows; for streams."""

    def step(state, read, event, value):
        n, last = state
        if event:
            n, last = n + 1, value
        return ((0, None), (n > 0, n, last)) if read else ((n, last), None)

    return Recurrence((0, None), step, "n long, last double", "hit boolean, n long, last double")
