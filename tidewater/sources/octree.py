"""Octrees as tables: leaves with the Z-order code of their cell, read from nested JSON, stored by coarse cell, counted by roll-up."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tidewater.operators.spatial import z_code
from tidewater.storage import fresh_path

# The column of levels in the shared folder.
STEP = "tree_step"


def opened(trees: DataFrame, text: str, size: float, depth: int = 64) -> DataFrame:
    """All nodes of trees in JSON (keys p: centre, l: children, n: normal, m: material) with the other columns of their row:
    level, size (halved by level), x, y, z, normal, material and leaf (it has no children).

    Trees are opened level by level, up to `depth` levels below their roots.  A node's fields are taken once; what is handed on, as VARIANT
    values in the shared folder, is the children alone, so the text is read and parsed once, nothing is held in memory and a
    level costs no more than its nodes.  Null texts give no node; null fields stay null.
    """

    spark, kept = trees.sparkSession, [c for c in trees.columns if c != text]
    below, folder = f"children_{uuid.uuid4().hex}", fresh_path(trees.sparkSession)
    centre = F.try_variant_get("node", "$.p", "array<double>")
    fields = [*(F.get(centre, F.lit(k)).alias(c) for k, c in enumerate("xyz")), F.try_variant_get("node", "$.n", "array<double>").alias("normal"), F.try_variant_get("node", "$.m", "string").alias("material")]
    # not a filter: it would be pushed below the expression that makes the text, which would run twice
    given = trees.select(*kept, F.explode(F.filter(F.array(F.col(text)), lambda t: t.isNotNull())).alias("node"))
    nodes = given.select(*kept, F.parse_json("node").alias("node"))
    for level in range(depth + 1):
        opens = F.try_variant_get("node", "$.l", "array<variant>")
        now = nodes.select(*kept, *fields, F.when(F.size(opens) > 0, opens).alias(below))
        now.write.parquet(f"{folder}/{STEP}={level}")
        held = spark.read.schema(now.schema).parquet(f"{folder}/{STEP}={level}").where(F.col(below).isNotNull())
        if held.isEmpty():
            break
        nodes = held.select(*kept, F.explode(below).alias("node"))
    else:
        raise ValueError(f"a tree goes on below {depth} levels")
    every = spark.read.schema(now.schema.add(STEP, IntegerType())).parquet(folder)
    return every.select(*kept, F.col(STEP).alias("level"), (F.lit(float(size)) / F.pow(F.lit(2.0), STEP)).alias("size"), *"xyz", "normal", "material", F.col(below).isNull().alias("leaf"))


def leaves_of(spark: SparkSession, path: str, size: float, depth: int = 64) -> DataFrame:
    """Leaves of octree files, one tree a file, as x, y, z, size, normal and material."""
    return opened(spark.read.text(path, wholetext=True), "value", size, depth).where("leaf").select("x", "y", "z", "size", "normal", "material")


def cell_code(at: list[Column], corner: list[float], size: float, depth: int) -> Column:
    """The Z-order code of the cell of a cube that a point falls into at `depth`; null outside of the cube."""
    cells = [F.floor((a - c) / (size / (1 << depth))) for a, c in zip(at, corner)]
    inside = F.lit(True)
    for c in cells:
        inside = inside & c.between(0, (1 << depth) - 1)
    return F.when(inside, z_code(cells))


def above(code: Column | str, levels: int) -> Column:
    """The code of the cell so many levels up."""
    return F.shiftright(code, 3 * levels)


def store(leaves: DataFrame, path: str, code: str, depth: int, coarse: int) -> None:
    """Writes leaves by the cell that holds them at level `coarse`, sorted by code.  Rows are dealt by ranges of codes, so a
    crowded cell is several files and no task's work alone."""
    rows = leaves.withColumn("cell", above(code, depth - coarse))
    rows.repartitionByRange("cell", code).sortWithinPartitions("cell", code).write.partitionBy("cell").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Leaves that store() wrote; with bounds, only the files of coarse cells from `low` to `high` are read."""
    rows = spark.read.parquet(path).withColumn("cell", F.col("cell").cast("long"))
    return rows if low is None else rows.where(F.col("cell").between(low, high))


def node_counts(leaves: DataFrame, code: str, depth: int, coarse: int) -> DataFrame:
    """cell, nodes and leaves below each cell at level `coarse`, itself included, as a tree over the leaves would have them.

    Rolled up level by level: a step adds a node for each cell and hands on an eighth of the rows at best.  Equal codes are
    one leaf; null codes are outside.
    """
    now = leaves.where(F.col(code).isNotNull()).select(F.col(code).alias("cell")).distinct().select("cell", F.lit(1).cast("long").alias("nodes"), F.lit(1).cast("long").alias("leaves"))
    for _ in range(depth - coarse):
        now = now.groupBy(above("cell", 1).alias("cell")).agg((F.sum("nodes") + 1).alias("nodes"), F.sum("leaves").alias("leaves"))
    return now
