"""Embedding near-duplicates by sorted projection passes.

Equal vectors are folded first.  Each pass orders the vectors that are left by a fresh string of random-hyperplane bits
(Ravichandran et al. 2005), so that close vectors, which share long prefixes in some pass, come to stand near each other;
every vector is compared with its next WINDOW neighbours, over partition edges too.  The number of passes follows the
number of vectors.  A pass moves vectors in 8 bits a component with their rounding error: pairs that the error leaves
open are verified on the vectors themselves.  A pass leaves a spanning forest, and distributed union-find joins the passes.
Windows bound the partners of a vector, so within each component all pairs are then compared in blocks, which makes
n_links whole for the pairs of that component without emitting them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, with_least
from .graph import components, spanning

PASSES, WINDOW, BITS, BLOCK, SEED = 24, 32, 63, 1024, 20
# Expected recall of a pair at the threshold that has no other close vectors around it.
RECALL = 0.98
# Rows of an equal group over this number are dealt over SALTS tasks in the last join.
HOT, SALTS = 1000, 64


def passes_for(rows: int, threshold: float) -> int:
    """Passes that bring a lone pair at the threshold into one window with chance RECALL, PASSES at least.

    A bit agrees with chance 1 - angle / pi, and among `rows` vectors about log2(rows / WINDOW) leading bits have to.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    meet = agree ** max(0.0, math.log2(max(1, rows) / WINDOW))
    return PASSES if meet >= 1 else max(PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def _packed(units: np.ndarray) -> list[bytes]:
    """Each unit vector as a scale and the length of its rounding error (float32), and one signed byte a component."""
    scale = (np.abs(units).max(1) / 127).astype(np.float32)
    q = np.clip(np.rint(units / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((units - q * scale[:, None].astype(np.float64)) ** 2).sum(1)) * 1.00001 + 1e-7
    head = np.stack([scale, error.astype(np.float32)], 1)
    raw = np.concatenate([head.view(np.int8).reshape(len(q), 8), q], 1).tobytes()
    size = 8 + units.shape[1]
    return [raw[k : k + size] for k in range(0, len(raw), size)]


def _close(ids: list, packed: list[bytes], threshold: float) -> tuple[list[tuple], list[tuple]]:
    """Pairs at most WINDOW places apart: those surely over the threshold as a spanning forest, and those left open."""
    if len(ids) < 2:
        return [], []
    both = np.frombuffer(b"".join(packed), dtype=np.int8).reshape(len(ids), -1)
    scale, error = np.ascontiguousarray(both[:, :8]).view(np.float32).T
    units = both[:, 8:].astype(np.float32) * scale[:, None]
    sure, open_pairs = [], []
    for off in range(1, min(WINDOW, len(ids) - 1) + 1):
        cosine = np.einsum("ij,ij->i", units[off:], units[:-off])
        # |uv - ab| <= |u - a| |v| + |a| |v - b|, and what single precision adds
        slack = error[off:] + error[:-off] + error[off:] * error[:-off] + 2e-5
        near = cosine - slack >= threshold
        sure += [(ids[k], ids[k + off]) for k in np.flatnonzero(near).tolist()]
        open_pairs += [(ids[k], ids[k + off]) for k in np.flatnonzero(~near & (cosine + slack >= threshold)).tolist()]
    forest = spanning(sure)
    if open_pairs:
        root = dict(forest)
        open_pairs = [(a, b) for a, b in open_pairs if root.get(a, a) != root.get(b, b)]
    return forest, open_pairs


def near_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept for every row.

    Links: pairs found whose cosine, in double precision, is at least `threshold`; equal vectors always link.
    component_id is the smallest id reachable over links, kept is whether it is the row's own.  Null, zero and empty vectors
    and vectors with null or non-finite components link with nothing, and vectors of different dimension never link.
    Rows that repeat an id are one node, with the smallest vector; each comes back.  A row without an id has no links
    and a null component_id.  Other columns are left out.  An empty table gives an empty table.
    """
    raw = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    # scaled by the largest component: squares neither overflow nor vanish
    scaled = raw.where(sound).groupBy("id").agg(F.min("v").alias("v")).selectExpr("id", "transform(v, x -> x / array_max(transform(v, y -> abs(y))) + 0D) AS v")
    # rep: the smallest id with an equal vector, same: how many there are
    folded = settle(with_least(settle(scaled), ["v"], "id", "rep", size="same").select("id", "rep", "same", F.when(F.col("id") == F.col("rep"), F.col("v")).alias("v")))
    vectors = folded.where("id = rep").select("id", F.size("v").alias("dim"), "v", "same")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    passes = passes_for(vectors.count(), threshold)

    def keys(batches):
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                units = _unit(_matrix(part.column(2)))
                packed = pa.array(_packed(units), pa.binary())
                for k in range(passes):
                    planes = np.random.default_rng([SEED, dim, k]).normal(size=(dim, BITS))
                    codes = (units @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k), pa.int32()), part.column(1), pa.array(codes, pa.int64()), part.column(0), packed], names=["pass", "dim", "code", "id", "v"])

    order = ["pass", "dim", "code", "id"]
    laid = vectors.select("id", "dim", "v").mapInArrow(keys, "pass int, dim int, code long, id long, v binary").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def windows(batches):
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        # the open run of one pass and dimension: its first WINDOW rows, and the last WINDOW rows so far
        open_run, first, ids, vs = None, ([], []), [], []

        def rows(n, at, later, a, b, v):
            run = open_run if at >= 0 else (0, 0)
            return pa.RecordBatch.from_arrays([pa.array([at] * n), pa.array([later] * n), pa.array([run[0]] * n, pa.int32()), pa.array([run[1]] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.binary())], schema=FOUND)

        def edge(side):
            (i, v), at = (first, here) if side else ((ids, vs), here + 1)
            if i:
                # the first rows of a partition meet the last ones of the partition before
                yield rows(len(i), at, bool(side), i, [None] * len(i), v)

        for batch in batches:
            marks = np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                run = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if run != open_run:
                    if open_run is not None:
                        yield from edge(1)
                    first, ids, vs, open_run = ([], []), [], [], run
                new_ids, new = batch.column(3).slice(a, b - a).to_pylist(), batch.column(4).slice(a, b - a).to_pylist()
                if len(first[0]) < WINDOW:
                    take = WINDOW - len(first[0])
                    first = (first[0] + new_ids[:take], first[1] + new[:take])
                ids, vs = ids + new_ids, vs + new
                for later, links in enumerate(_close(ids, vs, threshold)):
                    if links:
                        yield rows(len(links), -1, bool(later), [x for x, _ in links], [x for _, x in links], [None] * len(links))
                ids, vs = ids[-WINDOW:], vs[-WINDOW:]
        if open_run is not None:
            yield from edge(1)
            yield from edge(0)

    # at -1: links, and with `later` pairs left open; else rows at the edge before partition `at`
    found = settle(laid.mapInArrow(windows, "at long, later boolean, pass int, dim int, a long, b long, v binary"))

    def over_edge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pd.concat([pdf[~pdf.later], pdf[pdf.later]])
        sure, left = _close(pdf.a.tolist(), pdf.v.tolist(), threshold)
        return pd.DataFrame([(a, b, False) for a, b in sure] + [(a, b, True) for a, b in left], columns=["a", "b", "later"])

    # at most 2 * WINDOW rows for each edge, pass and dimension
    crossing = found.where("at >= 0").select("at", "pass", "dim", "later", "a", "v").groupBy("at", "pass", "dim").applyInPandas(over_edge, "a long, b long, later boolean")
    pairs = settle(found.where("at < 0").select("a", "b", "later").union(crossing).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "later").distinct())
    one, two = (vectors.select(F.col("id").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    exact = " / ".join([dot.format("va", "vb"), f"sqrt({dot.format('va', 'va')})", f"sqrt({dot.format('vb', 'vb')})"])
    verified = pairs.where("later").join(one, "a").join(two, "b").where(F.expr(exact) >= threshold).select("a", "b")
    joined = settle(components(pairs.where("NOT later").select("a", "b").union(verified)))

    # all pairs within each component, block by block
    sized = joined.join(joined.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "root")
    members = sized.join(vectors, F.col("node") == F.col("id")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")).select("root", "dim", "block", "id", "same", "v", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))

    def linked(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, same, units = pdf.id.to_numpy(), pdf.same.to_numpy(), _unit(np.array(pdf.v.tolist()))
        left, right = np.flatnonzero(pdf.block == key[2]), np.flatnonzero(pdf.block == key[3])
        hit = units[left] @ units[right].T >= threshold
        if key[2] == key[3]:
            np.fill_diagonal(hit, False)
        rows = [(ids[left], hit @ same[right])]
        if key[2] != key[3]:
            rows.append((ids[right], hit.T @ same[left]))
        return pd.DataFrame({"id": np.concatenate([r[0] for r in rows]), "n": np.concatenate([r[1] for r in rows])})

    counted = members.select("root", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "same", "v").groupBy("root", "dim", "i", "j").applyInPandas(linked, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))
    hot = F.col("same") > HOT
    spread = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    linked_reps = vectors.select("id", "same").join(joined, F.col("id") == F.col("node")).join(counted, "id").select(F.col("id").alias("rep"), "root", "n_links", spread)
    salted = folded.select("id", "rep", "same", F.when(hot, F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    both = salted.join(linked_reps, ["rep", "salt"], "left").select(F.col("id").alias("node"), F.coalesce("root", "rep").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("same") - 1).alias("n_links"))
    out = raw.select("id").join(both, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "id").alias("component_id"), F.coalesce(F.col("root") == F.col("id"), F.col("id").isNotNull()).alias("kept"))


FOUND = pa.schema([("at", pa.int64()), ("later", pa.bool_()), ("pass", pa.int32()), ("dim", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("v", pa.binary())])
