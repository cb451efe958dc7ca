"""Stream twins of sequential operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewater.operators.navigation import Kalman
from tidewater.operators.runs import Recurrence


def kalman(stream: DataFrame, by: str, tick: str, a: str, z: str, dt: float, r: float = 5.0) -> DataFrame:
    """The filter of operators.navigation.kalman, with its state kept for each run between batches.

    Rows of a run must reach the stream in tick order from batch to batch; within a batch they are sorted.
    """
    kind = stream.schema[by].dataType.simpleString()

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k = Kalman(r)
        if state.exists:
            k.x, k.v, *k.p = state.get
        pdf = pd.concat(list(batches)).sort_values(tick)
        out = []
        for acc, seen in zip(pdf[a].tolist(), pdf[z].tolist()):
            k.predict(acc, dt)
            k.update(seen)
            out.append((k.x, k.v))
        state.update((k.x, k.v, *k.p))
        yield pdf[[by, tick]].assign(x=[o[0] for o in out], v=[o[1] for o in out])

    picked = stream.select(by, tick, a, z)
    return picked.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {tick} {stream.schema[tick].dataType.simpleString()}, x double, v double", "x double, v double, p0 double, p1 double, p2 double", "append", GroupStateTimeout.NoTimeout)


def windowed_means(stream: DataFrame, time: str, sensor: str, value: str, window: str, late: str) -> DataFrame:
    """Means by sensor and event-time window; readings later than the watermark are dropped."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", window), sensor).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), sensor, "mean", "n")


def waypoints(stream: DataFrame, by: str, tick: str, value: str, targets: list[float], reach: float) -> DataFrame:
    """Index of the waypoint each run is heading for; steps on which one is reached are not given out."""
    kind = stream.schema[by].dataType.simpleString()

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values(tick)
        keep, index = [], []
        for v in pdf[value].tolist():
            reached = at < len(targets) and abs(targets[at] - v) < reach
            at += reached
            keep.append(not reached and at < len(targets))
            index.append(at)
        state.update((at,))
        yield pdf[[by, tick]].assign(waypoint=index)[keep]

    return stream.select(by, tick, value).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {tick} {stream.schema[tick].dataType.simpleString()}, waypoint int", "at int", "append", GroupStateTimeout.NoTimeout)


# transformWithState keeps its state in this store
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rocks(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Walker(StatefulProcessor):
    """A recurrence with its state in a value state for each run."""

    def __init__(self, by: str, order: list[str], columns: list[str], rule: Recurrence):
        self.by, self.order, self.columns, self.rule = by, order, columns, rule
        # schemas are read here, since workers have no session
        self.state, self.names = StructType.fromDDL(rule.state), StructType.fromDDL(rule.out).fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.kept.get()) if self.kept.exists() else self.rule.start
        pdf = pd.concat(list(rows)).sort_values(self.order).astype(object)
        pdf = pdf.where(pdf.notna(), None)
        at, out = [], []
        for n, values in enumerate(zip(*(pdf[c].tolist() for c in self.columns))):
            state, given = self.rule.step(state, *values)
            if given is not None:
                at.append(n)
                out.append(given)
        self.kept.update(state)
        head = pdf[[self.by, *self.order]].iloc[at].reset_index(drop=True)
        yield pd.concat([head, pd.DataFrame(out, columns=self.names)], axis=1).infer_objects()


def walked(stream: DataFrame, by: str, order: list[str], columns: list[str], rule: Recurrence) -> DataFrame:
    """operators.runs.walk over a stream: a run's rows have to come in order from batch to batch; within one they are sorted."""
    _rocks(stream)
    schema = StructType([stream.schema[c] for c in [by, *order]] + list(StructType.fromDDL(rule.out)))
    return stream.select(by, *order, *columns).groupBy(by).transformWithStateInPandas(Walker(by, order, columns, rule), schema, "Append", "None")


class Post(StatefulProcessor):
    """The message each receiver waits for, and timers for its arrival and for clearing the buffer again.

    Event time is the tick in seconds.  A message that is due before the next one is sent has arrived, whether its timer
    has come or not, so what is given out does not depend on where batches end.
    """

    def __init__(self, to: str, tick: str, payload: str):
        self.to, self.tick, self.payload = to, tick, payload
        self.message, self.since = StructType.fromDDL("at long, payload double"), StructType.fromDDL("since long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", self.message)
        self.full = handle.getValueState("full", self.since)

    def _upto(self, tick: int) -> list[tuple]:
        """Changes of the buffer before or at `tick`."""
        out = []
        due = self.waiting.get() if self.waiting.exists() else None
        since = self.full.get()[0] if self.full.exists() else None
        if since is not None and since + 1 <= tick and not (due and due[0] <= since + 1):
            out.append((since + 1, None))
            self.full.clear()
        if due and due[0] <= tick:
            out.append(tuple(due))
            self.waiting.clear()
            if due[0] + 1 <= tick:
                out.append((due[0] + 1, None))
                self.full.clear()
            else:
                self.full.update((due[0],))
        return out

    def _given(self, key, changes: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *c) for c in changes], columns=[self.to, self.tick, self.payload])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        pdf = pd.concat(list(rows)).sort_values([self.tick, self.payload])
        for tick, due, payload in zip(pdf[self.tick].tolist(), pdf[f"{self.tick}_due"].tolist(), pdf[self.payload].tolist()):
            out += self._upto(tick - 1)
            self.waiting.update((due, payload))
            # one tick later than the change: rows of its own tick may still come
            for at in (due + 1, due + 2):
                self.handle.registerTimer(at * 1000)
        yield self._given(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._given(key, self._upto(expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1))


def delivered(stream: DataFrame, to: str, tick: str, delay: str, payload: str, late: str = "0 seconds") -> DataFrame:
    """operators.guidance.delivered over a stream of messages: (to, tick, payload) as buffers change, by event-time timers.

    `payload` is a double, `delay` a column of whole ticks, at least 1.  Nothing is kept for a tick without a message.
    """
    _rocks(stream)
    timed = stream.select(F.col(to), F.col(tick).cast("long").alias(tick), (F.col(tick) + F.col(delay)).cast("long").alias(f"{tick}_due"), F.col(payload).cast("double").alias(payload)).where(F.col(to).isNotNull() & F.col(f"{tick}_due").isNotNull())
    timed = timed.withColumn(f"{tick}_time", F.timestamp_seconds(tick)).withWatermark(f"{tick}_time", late)
    schema = StructType([stream.schema[to]] + list(StructType.fromDDL(f"{tick} long, {payload} double")))
    return timed.groupBy(to).transformWithStateInPandas(Post(to, tick, payload), schema, "Append", "EventTime")
