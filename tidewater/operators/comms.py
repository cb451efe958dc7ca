"""Acoustic and optical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SOUND_SPEED = 1500.0
# Which of azimuth and elevation, range and depth a message type exposes.
ANGLES = ["OWAYU", "MSG_REQU", "MSG_RESPU", "MSG_REQX", "MSG_RESPX"]
RANGES = ["MSG_RESPU", "MSG_RESPX"]
DEPTHS = ["MSG_REQX", "MSG_RESPX"]
# Shares of one net's rows that meet the other side in tasks of their own.
SALTS = 32


def delay_ticks(distance: Column, ticks_per_second: int, speed: float = SOUND_SPEED) -> Column:
    return F.round(distance * ticks_per_second / speed).cast("long")


def heard(messages: DataFrame, tick: str) -> DataFrame:
    """Messages on ticks with a single sender; all others collide and are lost."""
    return messages.withColumn("__n", F.count("*").over(Window.partitionBy(tick))).where("__n = 1").drop("__n")


def exposed(kind: Column, azimuth: Column, elevation: Column, distance: Column, depth: Column) -> list[Column]:
    """The fields of a message by type; those it does not carry are null."""
    return [
        F.when(kind.isin(ANGLES), azimuth).alias("azimuth"),
        F.when(kind.isin(ANGLES), elevation).alias("elevation"),
        F.when(kind.isin(RANGES), distance).alias("range"),
        F.when(kind.isin(DEPTHS), depth).alias("depth"),
    ]


def within_cone(ax: Column, ay: Column, dx: Column, dy: Column, half_angle: float) -> Column:
    """Whether (dx, dy) lies within half_angle degrees of the axis (ax, ay)."""
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(dx * dx + dy * dy)
    return F.when(size > 0, (ax * dx + ay * dy) / F.when(size > 0, size) >= F.cos(F.radians(F.lit(half_angle)))).otherwise(False)


def between_beams(start: list[Column], end: list[Column], ahead: list[Column], other_ahead: list[Column], half_angle: float, walls: list[tuple[list[float], list[float]]]) -> Column:
    """Whether two modems face each other, each within half_angle degrees (at most 90) of its own axis, with no wall (low and
    high corner of a box) on the straight line between them.  Modems at one spot, and axes of length 0, do not."""
    from tidewater.functions.geometry import segment_meets_box

    def within(axis: list[Column], way: list[Column]) -> Column:
        dot, a, w = (p[0] * q[0] + p[1] * q[1] + p[2] * q[2] for p, q in ((axis, way), (axis, axis), (way, way)))
        return (a > 0) & (w > 0) & (dot > F.cos(F.radians(F.lit(half_angle))) * F.sqrt(a) * F.sqrt(w))

    way = [b - a for a, b in zip(start, end)]
    seen = within(ahead, way) & within(other_ahead, [-c for c in way])
    for low, high in walls:
        seen = seen & ~segment_meets_box(start, end, low, high)
    return seen


def dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with `__salt` for a join by it and by keys: each row of the left has one, the right is there under all.

    The left is dealt by keys and salt to a fixed number of partitions before it grows, so that few keys, or a file of one
    split, are not the work of few tasks; by a merge join, since a broadcast would leave the other side as it lies.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    return salted.repartition(n, *keys, "__salt"), right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def sent_to(messages: DataFrame, sensors: DataFrame, net: str, sender: str, to: str, sensor: str, everyone: int = -1) -> DataFrame:
    """One row for each message and receiver: the sensor of the message's net that it names, or, for `everyone`, every other
    sensor of the net.  Messages to unknown names and to their own sender reach no one.

    Two equi joins; the second is as large as what it gives out, and starts from messages to everyone only, dealt so that a
    net is many tasks' work.
    """
    there = sensors.select(F.col(net).alias("__net"), F.col(sensor).alias("receiver")).distinct()
    same, other = F.col(net) == F.col("__net"), F.col(sender) != F.col("receiver")
    named = messages.where(F.col(to) != everyone).join(there, same & (F.col(to) == F.col("receiver")) & other)
    calls, there = dealt(messages.where(F.col(to) == everyone), there.withColumnRenamed("__net", net), [net])
    fanned = calls.join(there, [net, "__salt"]).where(other)
    return named.drop("__net").unionByName(fanned.drop("__salt"))


def in_reach(senders: DataFrame, others: DataFrame, by: str, other_by: str, axes: list[tuple[str, str]], reach: float) -> DataFrame:
    """Pairs of the same `by` within `reach` of each other, with `distance`; axes: a sender's column and the other's for each axis.

    An equi join on cells of that size: a sender looks into its own cell and the ones around it.  Senders are dealt, so that
    a crowded cell is many tasks' work.
    """
    cells = [F.floor(F.col(a) / reach) for a, _ in axes]
    around = senders
    for k, c in enumerate(cells):
        around = around.withColumn(f"__c{k}", F.explode(F.sequence(c - 1, c + 1)))
    there = others.select("*", *(F.floor(F.col(b) / reach).alias(f"__o{k}") for k, (_, b) in enumerate(axes)))
    on = F.col(by) == F.col(other_by)
    for k in range(len(axes)):
        on = on & (F.col(f"__c{k}") == F.col(f"__o{k}"))
    around, there = dealt(around, there, [by, *(f"__c{k}" for k in range(len(axes)))])
    there = there.withColumnRenamed("__salt", "__other").hint("merge")
    on = on & (F.col("__salt") == F.col("__other"))
    gap = F.sqrt(sum(((F.col(b) - F.col(a)) * (F.col(b) - F.col(a)) for a, b in axes[1:]), (F.col(axes[0][1]) - F.col(axes[0][0])) * (F.col(axes[0][1]) - F.col(axes[0][0]))))
    drop = [f"__{side}{k}" for side in "co" for k in range(len(axes))] + ["__salt", "__other"]
    return around.join(there, on).withColumn("distance", gap).where(F.col("distance") <= reach).drop(*drop)


def answered(messages: DataFrame, by: str, at: str, kind: str, replies: dict[str, str], tie: str | None = None) -> DataFrame:
    """Requests with the first reply of the right type after them on the same link, and how long it took.

    A sender is busy until its reply arrives: a request sent before that is dropped.  One sort, no range join: a reply
    closes the latest open request.  Messages at one time come in the order of `tie`.
    """
    want = F.create_map(*(F.lit(x) for kv in replies.items() for x in kv))
    order = [at, tie] if tie else [at]
    w = Window.partitionBy(by).orderBy(*order)
    told = messages.withColumn("__asks", F.col(kind).isin(list(replies))).withColumn("__gives", F.col(kind).isin(list(replies.values()))).where("__asks OR __gives")
    # a new stretch starts after each reply; its first request is the one that was accepted
    stretch = F.coalesce(F.sum(F.col("__gives").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = told.withColumn("__n", stretch)
    ask = told.groupBy(by, "__n").agg(F.min_by(F.struct(F.col(at).alias("at"), F.col(kind).alias("kind")), F.when(F.col("__asks"), F.struct(*order))).alias("ask"), F.max(F.when(F.col("__gives"), F.struct(F.col(at).alias("at"), F.col(kind).alias("kind")))).alias("reply"), F.bool_or("__asks").alias("any"))
    return ask.where("any AND reply IS NOT NULL").where(want[F.col("ask.kind")] == F.col("reply.kind")).select(by, F.col("ask.at").alias("asked_at"), F.col("ask.kind").alias("request"), F.col("reply.at").alias("answered_at"))
