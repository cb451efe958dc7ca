"""Rows that share keys: the keys that a first pass leaves open, and blocks in which their rows meet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import near_keys, settle


def open_keys(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """key, node, root, main (the root of most rows), most (rows of that root) and other (rows of other roots) of the rows of
    `shared` (key, at, lead: structs with a node) whose key is open: its rows but the first one, which has met all,
    are in several components of `joined` (node, root).

    Of keys that hold the same rows one is enough.
    """
    at = shared.select("key", F.col("at.node").alias("node"), (F.col("at") == F.col("lead")).alias("leads")).join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = at.groupBy("key", "root").agg(F.count("*").alias("k"), F.sum(F.when(F.col("leads"), 0).otherwise(1)).alias("met"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    per_key = per_root.groupBy("key").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("met") > 0, 1).otherwise(0)).alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("most"), F.sum("mark").alias("mark")).where("roots > 1")
    one = per_key.groupBy("n", "mark").agg(F.min(F.struct("key", "main", "most")).alias("g"))
    one = settle(one.select(F.col("g.key").alias("key"), F.col("g.main").alias("main"), F.col("g.most").alias("most"), (F.col("n") - F.col("g.most")).alias("other")))
    return settle(near_keys(at.select("key", "node", "root"), "key", one.select("key")).join(one, "key").distinct())


def in_cells(rows: DataFrame, block: int) -> DataFrame:
    """key, i, j, node, root and block: the rows of open_keys() dealt over cells (i, j), i <= j, of their key, so that any two
    rows of different roots meet in one cell, which holds at most about two blocks of `block` rows.

    Rows of the main root meet only the others, which are few where a key is hot.
    """
    # blocks of the others are numbered from 0, those of the main root follow
    sized = rows.withColumn("isMain", F.expr("root = main")).withColumn("bm", F.ceil(F.col("most") / block).cast("int")).withColumn("bo", F.ceil(F.col("other") / block).cast("int"))
    dealt = sized.withColumn("block", F.expr("cast(if(isMain, bo + pmod(xxhash64(node, 7), bm), pmod(xxhash64(node, 7), bo)) AS int)"))
    cells = F.expr("""CASE WHEN isMain THEN transform(sequence(0, bo - 1), i -> struct(i, block AS j))
        ELSE transform(sequence(0, bo + bm - 1), k -> struct(least(k, block) AS i, greatest(k, block) AS j)) END""")
    return dealt.select("key", "node", "root", "block", F.explode(cells).alias("cell")).select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "node", "root", "block")


def recounted(rows: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of open_keys() that stand in `left` (distinct key, node), with main, most and other as they are among these."""
    kept = settle(rows.select("key", "node", "root").join(left, ["key", "node"], "left_semi"))
    per_root = kept.groupBy("key", "root").agg(F.count("*").alias("k"))
    per_key = per_root.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("n")).where("n > most")
    return kept.join(per_key.select("key", "main", "most", (F.col("n") - F.col("most")).alias("other")), "key")


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (key, i, j) of batches that are sorted by cell; one cell is held at a time."""
    here, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        spots = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "i", "j")])
        edges = [0, *(np.flatnonzero((spots[:, 1:] != spots[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            cell = tuple(spots[:, a].tolist())
            if cell != here and held:
                yield pa.Table.from_batches(held)
                held = []
            here = cell
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def cell_links(rows: DataFrame, compare: Callable[[list[dict]], list[tuple]], node: str) -> DataFrame:
    """a, b: what compare() gives for the rows of each cell (key, i, j); a task holds one cell at a time."""

    def packed(links: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], kind), pa.array([x for _, x in links], kind)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]):
        here, held = None, []
        for batch in batches:
            links = []
            for r in batch.to_pylist():
                cell = (r["key"], r["i"], r["j"])
                if cell != here:
                    links += compare(held) if held else []
                    here, held = cell, []
                held.append(r)
            yield packed(links)
        yield packed(compare(held) if held else [])

    kind = {"bigint": pa.int64(), "string": pa.string()}[node]
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, f"a {node}, b {node}")
