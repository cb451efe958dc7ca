"""A Merkle manifest of a dataset, with proofs from stored parent preimages.

Leaves are hashes of rows; every eight consecutive nodes of a group make a parent, up to the group's root, and the
groups' roots make the root of all.  What is stored of a parent is its preimage, the children's hashes one after
another.  A leaf's proof takes the preimages on its way up and cuts its own 64 characters out of each; a changed leaf is
folded up by splicing its hash in at that place instead.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.ordering import places

from .common import settle

FAN = 8
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<slot:int,preimage:string>>"


def encoded(column: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def parents(nodes: DataFrame) -> DataFrame:
    """The parents of the nodes (grp, n nodes in the group, node, hash) of groups that have several, with preimages."""
    up = nodes.where("n > 1").groupBy("grp", F.floor(F.col("node") / FAN).alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("kids"))
    joined = up.select("grp", F.ceil(F.col("n") / FAN).alias("n"), F.col("up").alias("node"), F.array_join(F.col("kids.hash"), "").alias("preimage"))
    return joined.withColumn("hash", F.sha2("preimage", 256))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of all groups' trees over leaves (grp, n, node, hash); an eighth as many rows each."""
    out, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(settle(parents(out[-1])))
        most = -(-most // FAN)
    return out


def with_paths(tree: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves of the trees with `path`, slot and preimage of every step up, and the other columns of `tops`, which has
    what comes after each group's root (grp, path, ...).  From the top down, every level joins the one above: at most
    eight rows to one."""
    more = [c for c in tops.columns if c not in ("grp", "path")]
    above = None
    for level in reversed(tree):
        below = level.where("n = 1").join(tops, "grp")
        if above is not None:
            higher = above.select("grp", F.col("node").alias("up"), F.col("preimage").alias("seen"), F.col("path").alias("rest"), *more)
            inner = level.where("n > 1").withColumn("up", F.floor(F.col("node") / FAN)).join(higher, ["grp", "up"])
            step = F.array(F.struct(F.pmod("node", F.lit(FAN)).cast("int").alias("slot"), F.col("seen").alias("preimage")))
            below = inner.withColumn("path", F.concat(step, "rest")).select(*below.columns).union(below)
        above = below
    return above


def siblings(step: Column) -> Column:
    """The preimage without the child's own slot."""
    return F.concat(*around(step))


def around(step: Column) -> tuple[Column, Column]:
    at = step["slot"] * HEX
    return F.substring(step["preimage"], F.lit(1), at), F.substring(step["preimage"], at + HEX + 1, F.length(step["preimage"]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to when its hash is spliced into the preimages."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(around(step)[0], h, around(step)[1]), 256))


def manifest(df: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang", text: str = "text", tampered: Column | None = None) -> DataFrame:
    """key, group, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf hashes `columns` as encoded() gives them.  Leaves of a group ascend by `key` (null first), equal keys by their
    hash; groups ascend bytewise, the null group first.  Where `tampered` is true, folded_root starts from the row with
    A-Z of `text` in lower case.  Repeated rows are leaves of their own; texts are hashed whole, where they are read, and
    empty, very long and null ones are like any other.  An empty table gives an empty table.
    """
    changed = [F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in columns]
    hashed = df.select(F.col(key).alias("key"), F.col(group).alias("of"), leaf_hash([F.col(c) for c in columns]).alias("leaf"), F.when(tampered, leaf_hash(changed)).alias("other") if tampered is not None else F.lit(None).cast("string").alias("other"))
    # the null group is '', which sorts first
    leaves = settle(hashed.withColumn("grp", F.coalesce(F.concat(F.lit("="), "of"), F.lit(""))))
    bare = F.lit(None).cast("string").alias("preimage")
    tree = levels(places(leaves, "grp", ["key", "leaf"]).select("key", "of", "leaf", "other", "grp", F.col("__size").alias("n"), F.col("__place").alias("node"), F.col("leaf").alias("hash"), bare))
    subroots = functools.reduce(DataFrame.union, (t.where("n = 1").select("grp", "hash") for t in tree))
    ends = places(subroots.withColumn("all", F.lit(0)), "all", ["grp"])
    top = levels(ends.select(F.col("all").alias("grp"), F.col("__size").alias("n"), F.col("__place").alias("node"), "hash", F.col("grp").alias("tree"), F.col("hash").alias("subroot"), bare))
    root = top[-1].where("n = 1").select("grp", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    tops = settle(with_paths(top, root).select(F.col("tree").alias("grp"), "subroot", "root", "path"))
    proof = F.sha2(F.array_join(F.transform("path", siblings), ""), 256)
    fold = folded(F.coalesce("other", "leaf"), F.col("path"))
    out = with_paths(tree, tops).select(F.col("key").alias(key), F.col("of").alias(group), "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
