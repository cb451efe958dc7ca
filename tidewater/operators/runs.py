"""Recurrences over ordered runs: one step function, walked in batch here and in streams by streaming.stateful."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Recurrence(NamedTuple):
    """start: the state (a flat tuple) before the first row.  step(state, *values) gives the next state and the output tuple,
    or None where a row gives nothing.  `state` and `out` are their schemas as DDL."""

    start: tuple
    step: Callable
    state: str
    out: str


def walk(df: DataFrame, by: str, order: list[str], columns: list[str], rule: Recurrence) -> DataFrame:
    """by, order and the rule's outputs for every row of every run, in order.

    Runs are dealt by hash and sorted by Spark, which spills; a task streams through its runs in Arrow batches and holds one
    state and one batch, however long a run is.  A run is a chain, so it is one task's work.  Rows with equal order come in
    any order, so `order` has to tell them apart; null runs are one run; an empty table gives an empty table.
    """
    schema = StructType([df.schema[c] for c in [by, *order]] + list(StructType.fromDDL(rule.out)))
    arrow = to_arrow_schema(schema)
    kept = len(order) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), rule.start
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            at, rows = [], []
            for k, values in enumerate(zip(lists[0], *lists[kept:])):
                if values[0] != now:
                    now, state = values[0], rule.start
                state, out = rule.step(state, *values[1:])
                if out is not None:
                    at.append(k)
                    rows.append(out)
            head = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:kept]]
            tail = zip(*rows) if rows else [()] * (len(schema) - kept)
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(head, arrow)] + [pa.array(list(v), f.type) for v, f in zip(tail, list(arrow)[kept:])], schema=arrow)

    return df.select(by, *order, *columns).repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)
