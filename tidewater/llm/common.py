"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tidewater.storage import fresh_path, shared_dir

# Texts are handled in slices of about this many characters, so that memory stays bounded
# whatever the size of an Arrow batch.
SLICE_CHARS = 600_000


def settle(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again.

    The files stay until drop_settled() or drop_all_settled(), since results that are not written yet may read them.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, names) -> None:
    base = shared_dir(spark).rstrip("/")
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(*tables: DataFrame) -> None:
    """Removes the files of tables that settle() wrote and no one needs any more."""
    for df in tables:
        folders = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        _delete(df.sparkSession, (f for f in folders if f.startswith("tidewater-")))


def drop_all_settled(spark: SparkSession) -> None:
    """Removes all tables that settle() wrote in this application: for callers whose results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    _delete(spark, (n for n in names if n.startswith(f"tidewater-{spark.sparkContext.applicationId}-")))


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that each holds about SLICE_CHARS characters (or one long text); null is ''."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(column).fill_null(0))
        cut = np.cumsum(sizes) // SLICE_CHARS
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            yield part, [x or "" for x in column.slice(a, b - a).to_pylist()]


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        y = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        y ^= y >> np.uint64(30)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(27)
        y *= np.uint64(0x94D049BB133111EB)
        y ^= y >> np.uint64(31)
        return y


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique() without counts goes through a hash table, which is far slower on numbers."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of `width` words; fewer words make one run of all; none make none."""
    n = len(words)
    if n == 0:
        return words
    runs = max(1, n - width + 1)
    out = np.full(runs, min(n, width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(n, width)):
            out = mixed(out ^ words[j : j + runs], j)
    return out


# The bit map of near_keys() takes 8 MB at most.
MOST_BITS = 1 << 26


def _marked(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df with __near: whether `column` may stand in `keys`, by a broadcast bit map of bounded size."""
    from pyspark.sql import functions as F

    bits = 1 << 16
    rows = keys.count()
    while bits < min(16 * rows, MOST_BITS):
        bits *= 2
    spots = keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits)).alias("s"))
    words = spots.select((F.col("s") / 64).cast("int").alias("__word"), F.expr("shiftleft(1L, cast(s % 64 as int))").alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    spot = f"pmod(xxhash64(`{column}`), {bits}L)"
    hit = df.withColumn("__word", F.expr(f"cast({spot} / 64 as int)")).join(F.broadcast(words), "__word", "left")
    return hit.withColumn("__near", F.expr(f"coalesce(getbit(__bits, cast({spot} % 64 as int)) = 1, false)")).drop("__word", "__bits")


def near_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose `column` may stand in `keys` (one column of distinct values): all that do, and a few more.

    Most other rows go where they are read, before an exact join moves what is left.  With very many keys
    the bit map fills up and the join just moves more rows.
    """
    return _marked(df, column, keys).where("__near").drop("__near")


def told_apart(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose `column` may stand in `keys` (all that do, and a few more), and rows whose does not."""
    marked = _marked(df, column, keys)
    return marked.where("__near").drop("__near"), marked.where("NOT __near").drop("__near")


def without_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose `column` does not stand in `keys`; only rows that may stand there are moved."""
    perhaps, rest = told_apart(df, column, keys)
    return rest.union(perhaps.join(keys, perhaps[column] == keys[keys.columns[0]], "left_anti"))


def with_least(rows: DataFrame, keys: list[str], value: str, name: str, several: bool = False, size: str | None = None) -> DataFrame:
    """rows with the least `value` of their key group as `name`; with `several`, only rows of groups of two and more;
    with `size`, the number of rows of the group in a column of that name.

    The minimum is pre-aggregated where the rows are.  Groups of more than a 256th of all rows (so 256 at most, which
    are broadcast) are dealt over 64 salts before the join, so no task gets a hot group whole.
    """
    from pyspark.sql import functions as F

    if several:
        # counted first: most keys stand alone, and only rows of the others are handled any further
        more = settle(rows.groupBy(*keys).count().where("count > 1").select(*keys))
        rows = near_keys(rows, keys[0], more if len(keys) == 1 else more.select(keys[0]).distinct())
    least = rows.groupBy(*keys).agg(F.min(value).alias(name), F.count("*").alias("__n"))
    least = settle(least.where("__n > 1") if several else least)
    total = least.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(least.where(F.col("__n") > max(1000, total // 256)).select(*keys, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(value, F.lit(9)), F.lit(64))).otherwise(0).cast("int")
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
    spread = least.join(hot, keys, "left").select(*keys, name, *([F.col("__n").alias(size)] if size else []), F.explode_outer(salts).alias("__salt"))
    return rows.join(hot, keys, "left").withColumn("__salt", salt).join(spread, [*keys, "__salt"]).drop("__hot", "__salt")


def spread_join(rows: DataFrame, other: DataFrame, on: str, by: str, total: int) -> DataFrame:
    """rows joined with `other`, which has one row or a few for each value of the column `on`.

    Values that more than a 256th of all rows hold (so 256 at most, which are broadcast) are dealt over 64 salts by a hash of
    the column `by`, so no task gets the rows of a hot value whole.  total: how many rows there are.
    """
    from pyspark.sql import functions as F

    if total <= 1000:  # no value can be hot
        return rows.join(other, on)
    counts = rows.groupBy(on).agg(F.count("*").alias("__n"))
    hot = F.broadcast(counts.where(F.col("__n") > max(1000, total // 256)).select(on, F.lit(True).alias("__hot")))
    dealt = rows.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by, F.lit(9)), F.lit(64))).otherwise(0).cast("int"))
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
    spread = other.join(hot, on, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return dealt.join(spread, [on, "__salt"]).drop("__hot", "__salt")
