"""Exact top-k inner-product search by pivot tables.

With integer vectors, <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so a lower bound on the distance d bounds the score from
above, and the triangle inequality gives one for each pivot p: |d(q, p) - d(x, p)|.  Rows are dealt by
hash into blocks, with a table of their distances to all pivots; queries are dealt into blocks likewise, and each query
block meets each row block once.  A query takes the rows of a block in the order of their bounds, the largest over all
pivots, and stops when no bound left reaches its k-th best score.  The block winners meet in one more top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Vectors in a block of rows, queries in a block of queries, and pivots (each a bound on what a task holds).
ROWS, QUERIES, PIVOTS = 4096, 1024, 48
# Candidates that are evaluated between two looks at the bound.
STEP = 256


def whole(vector: str, scale: int = 1024) -> F.Column:
    """floor(scale * x) of each component, taken as double; null where a vector or component is null or not finite."""
    sound = f"`{vector}` IS NOT NULL AND forall(`{vector}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return F.expr(f"CASE WHEN {sound} THEN transform(`{vector}`, x -> floor(double({scale}) * double(x))) END")


def block_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, pivots: np.ndarray, k: int):
    """(query place, row place, score) of the k best rows of a block for each query, ties to smaller ids; not the query's own id."""
    f_rows, f_queries, f_pivots = rows.astype(np.float64), queries.astype(np.float64), pivots.astype(np.float64)

    def table(a):  # distances to the pivots
        gap = (a * a).sum(1)[:, None] + (f_pivots * f_pivots).sum(1)[None] - 2 * a @ f_pivots.T
        return np.sqrt(np.maximum(gap, 0))

    of_rows, of_queries = table(f_rows), table(f_queries)
    squares = (f_rows * f_rows).sum(1)
    # whole numbers are exact in double while every product sum stays below 2**53
    exact = np.abs(f_rows).max(initial=0) * np.abs(f_queries).max(initial=0) * max(1, rows.shape[1]) < 2**53
    for q in range(len(queries)):
        low = np.abs(of_rows - of_queries[q]).max(1) if len(pivots) else np.zeros(len(rows))
        size = f_queries[q] @ f_queries[q]
        top = (size + squares - low * low) / 2
        top += 1e-9 * (size + squares) + 1  # rounding never hides a candidate
        order = np.argsort(-top, kind="stable")
        order = order[row_ids[order] != query_ids[q]]
        best_at, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for since in range(0, len(order), STEP):
            if len(best) == k and top[order[since]] < best[-1]:
                break
            at = order[since : since + STEP]
            got = (f_rows[at] @ f_queries[q]).astype(np.int64) if exact else rows[at] @ queries[q]
            at, got = np.append(best_at, at), np.append(best, got)
            keep = np.lexsort((row_ids[at], -got))[:k]
            best_at, best = at[keep], got[keep]
        yield from zip([q] * len(best), best_at.tolist(), best.tolist())


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), id and score of the k rows with the highest integer inner product for each query.

    Queries: rows whose id is divisible by `every`; candidates: all rows but those with the query's own id, of the
    query's dimension.  Ties go to smaller ids; fewer candidates give fewer rows.  Null ids, null vectors and vectors with null or
    non-finite components take no part; of rows that repeat an id, the smallest vector counts.  Empty vectors
    score 0 with each other.  Other columns are left out.  An empty table gives an empty table.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("long").alias("id"), whole(vector_col, scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    counts = vectors.agg(F.count("*").alias("rows"), F.count(F.when(F.pmod("id", F.lit(every)) == 0, 1)).alias("queries")).first()
    row_blocks, query_blocks = max(1, -(-counts["rows"] // ROWS)), max(1, -(-counts["queries"] // QUERIES))
    # a fixed number of rows, spread by hash, serve as pivots
    pivots = spark.sparkContext.broadcast([(r.dim, r.v) for r in vectors.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(PIVOTS).select("dim", "v").toLocalIterator()])
    rows = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(row_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("asks", F.lit(False))
    asks = vectors.where(F.pmod("id", F.lit(every)) == 0).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks))).withColumn("asks", F.lit(True))
    columns = ["id", "v", "dim", F.col("b").cast("int").alias("b"), F.col("q").cast("int").alias("q"), "asks"]

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        def matrix(part):
            return np.array(part.v.tolist(), dtype=np.int64).reshape(len(part), key[0]), part.id.to_numpy()

        (q, q_ids), (r, r_ids) = matrix(pdf[pdf.asks]), matrix(pdf[~pdf.asks])
        mine = [v for d, v in pivots.value if d == key[0]]
        mine = np.array(mine, dtype=np.int64).reshape(len(mine), key[0])
        return pd.DataFrame([(q_ids[a], r_ids[b], s) for a, b, s in block_top(q, q_ids, r, r_ids, mine, k)], columns=["query_id", "id", "score"])

    found = rows.select(*columns).union(asks.select(*columns)).groupBy("dim", "q", "b").applyInPandas(meet, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
