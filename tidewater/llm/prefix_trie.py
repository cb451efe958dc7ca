"""The prefix trie of conversations, by partition refinement.

All conversations start in one class, the root.  Turn by turn, classes split by what their members say next.  A class that
a single sequence of turns is left in is retired: the rest of that sequence is a chain of nodes with one child each.
Equal conversations count as one sequence with several members.  A node is named by its smallest member and its depth, so
that the trie falls into one chain for each sequence, from the depth where it becomes the smallest of its class on; sums
over subtrees then are one sum over the sequences of a class, each with the total of its chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.ordering import places

from .common import drop_settled, settle

# A conversation's turns are handled in blocks of this many, and so is what belongs to them.
BLOCK = 4096
# Turns that one round of refinement looks at; it starts with one and doubles.
MOST = 512
# Ids in one string before it is hashed.
IDS = 500


def digest(*columns: Column) -> Column:
    """Each column with its length in front, so that no two rows of texts run together."""
    return F.unhex(F.sha2(F.concat(*(F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in columns)), 256))


def block(depth: Column | str) -> Column:
    return F.floor((F.col(depth) if isinstance(depth, str) else depth) / BLOCK)


def by_block(rows: DataFrame, size: str) -> DataFrame:
    """Each row once for each block of its `size` turns (at least one), so that a join on (conv, block) spreads long ones."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block(F.greatest(F.col(size) - 1, F.lit(0))))))


def ordered(conversations: DataFrame) -> DataFrame:
    """conv, place (from 0), size (turns of the conversation), key (digest of role and text), chars of every turn.

    Turns ascend, the null turn first; equal turns of a conversation come by role, then by the digest of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), digest(role, text).alias("key"), F.length(text).cast("long").alias("chars"))
    return places(said, "conv", ["turn", "role", "key"]).select("conv", F.col("__place").alias("place"), F.col("__size").alias("size"), "key", "chars")


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and turns (conv, depth from 1, key, chars) with their first turns taken from another one.

    The first h = crc32(conv) % heads turns of conversation c are those of conversation c - c % every (all of them if it
    has fewer, none if it is not there); c's own turns after its first h follow.
    """
    convs = turns.where("place = 0").select("conv", "size")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    lead = convs.select("conv", "size", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    bases = convs.select(F.col("conv").alias("base"), F.col("size").alias("there"))
    lead = lead.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).drop("there")
    lead = settle(lead.withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))))
    first = turns.where((F.col("place") < heads) & (F.col("conv") % every == 0)).select(F.col("conv").alias("base"), "place", "key", "chars")
    head = lead.where("taken > 0").select("conv", "base", "taken").join(first, "base").where("place < taken").select("conv", (F.col("place") + 1).alias("depth"), "key", "chars")
    own = turns.withColumn("block", block("place")).join(by_block(lead, "size").select("conv", "block", "h", "taken"), ["conv", "block"])
    tail = own.where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "key", "chars")
    return lead.select("conv", "length"), settle(head.union(tail))


def sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, length and rep, the smallest conversation with the same turns."""
    same = [F.bit_xor(F.xxhash64("depth", "key")).alias("a"), F.bit_xor(F.xxhash64("key", F.col("depth") + (1 << 40))).alias("b")]
    marks = convs.join(turns.groupBy("conv").agg(*same), "conv", "left").na.fill(0, ["a", "b"])
    least = marks.groupBy("length", "a", "b").agg(F.min("conv").alias("rep"), F.count("*").alias("__n"))
    return spread_join(marks, least, ["length", "a", "b"]).select("conv", "length", "rep")


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with `groups`, which has one row and the number __n of rows for each key.

    Groups of more than a 256th of all rows, so 256 at most, are broadcast; the others are joined by key.
    """
    groups = settle(groups)
    total = groups.agg(F.sum("__n")).first()[0] or 0
    hot = F.col("__n") > max(1000, total // 256)
    large = groups.where(hot)
    met = rows.join(F.broadcast(large), keys)
    return met.union(rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(groups.where(~hot), keys).select(*met.columns)).drop("__n")


def refined(reps: DataFrame, turns: DataFrame) -> DataFrame:
    """rep, depth, label (the smallest sequence of the class), members (conversations in it), chars (of its last turn) for
    every sequence at every depth where it shares its class with another one, and at the root.

    reps: rep, members, length.  Each round takes the sequences that still share a class and their next turns, names the
    classes after every one of these turns by digests of the class before and the turn, and keeps what is shared.
    """
    root = reps.agg(F.min("rep").alias("label"), F.sum("members").alias("all")).first()
    out = reps.select("rep", F.lit(0).cast("long").alias("depth"), F.lit(root["label"]).cast("long").alias("label"), F.lit(root["all"]).cast("long").alias("members"), F.lit(0).cast("long").alias("chars"))
    active = settle(reps.where("length > 0").select("rep", "members", "length", F.unhex(F.lit("00")).alias("class")))
    depth, width = 0, 1
    while not active.isEmpty():
        upto = depth + width
        coming = turns.where(F.col("depth").between(depth + 1, upto)).withColumnRenamed("conv", "rep")
        # at most `width` turns a sequence
        steps = coming.join(active.select("rep"), "rep").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("depth", "key", "chars"))).alias("steps"))
        name = lambda seen, s: F.array_append(seen, F.struct(s["depth"].alias("depth"), F.unhex(F.sha2(F.concat(F.element_at(seen, -1)["class"], s["key"]), 256)).alias("class"), s["chars"].alias("chars")))
        start = F.array(F.struct(F.lit(depth).cast("long").alias("depth"), F.col("class"), F.lit(0).cast("long").alias("chars")))
        named = active.join(steps, "rep").select("rep", "members", "length", F.explode(F.slice(F.aggregate("steps", start, name), 2, width)).alias("s")).select("rep", "members", "length", "s.*")
        named = settle(named)
        classes = named.groupBy("class").agg(F.min("rep").alias("label"), F.sum("members").alias("all"), F.count("*").alias("__n")).where("__n > 1")
        shared = settle(spread_join(named, classes, ["class"]))
        out = out.union(shared.select("rep", "depth", "label", F.col("all").alias("members"), "chars"))
        before, active = active, settle(shared.where((F.col("depth") == upto) & (F.col("length") > upto)).select("rep", "members", "length", "class"))
        drop_settled(before, named)
        depth, width = upto, min(2 * width, MOST)
    return out


def sums_below(nodes: DataFrame) -> DataFrame:
    """nodes (rep, depth, value, ...) with `below`: the sum of values at this and all larger depths of a rep; in two levels,
    so that a long chain is not one window."""
    cells = nodes.withColumn("block", block("depth"))
    later = Window.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy("rep", "block").agg(F.sum("value").alias("sum")).select("rep", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("after"))
    inside = Window.partitionBy("rep", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("inside", F.sum("value").over(inside)).join(totals, ["rep", "block"]).withColumn("below", F.col("inside") + F.col("after")).drop("inside", "after", "block", "value")


def member_hashes(members: DataFrame) -> DataFrame:
    """rep, ends: SHA-256 of the ascending conversation ids of each rep, as decimals with commas between.

    Ids are sorted by range over all tasks and joined to strings of some hundred ids there; a hash itself runs over
    its group's strings in order, one after another, and holds one batch of them at a time.
    """

    def joined(batches):
        import pyarrow as pa

        for b in batches:
            rep, conv = b.column(0).to_pylist(), b.column(1).to_pylist()
            at, out = 0, []
            while at < len(rep):
                end = at + 1
                while end < len(rep) and rep[end] == rep[at] and end - at < IDS:
                    end += 1
                out.append((rep[at], conv[at], ",".join(map(str, conv[at:end]))))
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["rep", "first", "ids"])

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        now, state = None, None
        for b in batches:
            reps, ends = [], []
            for rep, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if rep == now:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        reps.append(now)
                        ends.append(state.hexdigest())
                    now, state = rep, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ends, pa.string())], names=["rep", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends"])

    wide = members.select(F.col("rep").cast("long"), F.col("conv").cast("long"))
    strings = wide.repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(joined, "rep long, first long, ids string")
    return strings.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(hashed, "rep long, ends string")


EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def prefix_trie(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """One row for each node of the trie over the rebuilt conversations (see rebuilt()): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    conv_id is the smallest member; n_convs counts the members, n_leaves the childless nodes of the subtree; saved_tokens
    sums, over the subtree, (n_convs - 1) times the code points of the node's last text; ends_sha256 hashes the ids that
    end at the node.  Rows without a conv_id take no part.  Null roles and texts are empty; rows repeated as a whole are
    turns of their own; equal turns: see ordered().  No conversation, no node.
    """
    convs, turns = rebuilt(ordered(conversations), every, heads)
    members = settle(sequences(convs, turns))
    reps = settle(members.groupBy("rep").agg(F.count("*").alias("members"), F.max("length").alias("length")))
    shared = settle(refined(reps, turns))
    # how far each sequence is shared, and with whom at that depth
    known = reps.join(shared.groupBy("rep").agg(F.max("depth").alias("last"), F.max_by("label", "depth").alias("above")), "rep")
    known = settle(known)

    rest = turns.withColumnRenamed("conv", "rep").withColumn("block", block(F.col("depth") - 1)).join(by_block(known, "length").select("rep", "block", "members", "last"), ["rep", "block"]).where("depth > last")
    mine = shared.where("label = rep").select("rep", "depth", "members", "chars", F.lit(True).alias("common"))
    chain = mine.union(rest.select("rep", "depth", "members", "chars", F.lit(False)))
    chain = settle(sums_below(chain.withColumn("value", (F.col("members") - 1) * F.col("chars"))))
    # chains that hang below a class, by sequence
    totals = chain.groupBy("rep").agg(F.max("below").alias("total"))
    hung = shared.join(known.join(totals, "rep", "left").select("rep", F.coalesce("total", F.lit(0)).alias("total"), (F.col("length") > F.col("last")).cast("long").alias("leaf")), "rep")
    folded = hung.groupBy("label", "depth").agg(F.sum("leaf").alias("leaves"), F.sum(F.when(F.col("rep") == F.col("label"), 0).otherwise(F.col("total"))).alias("others"))
    # children: shared nodes below, and the first nodes of chains
    up = mine.select("rep", "depth").where("depth > 0").join(shared.select("rep", (F.col("depth") + 1).alias("depth"), F.col("label").alias("parent")), ["rep", "depth"])
    tops = known.where("length > last").select("rep", (F.col("last") + 1).alias("depth"), F.col("above").alias("parent"))
    parents = up.union(tops)
    children = parents.groupBy(F.col("parent").alias("label"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    about = folded.join(children, ["label", "depth"], "left").withColumnRenamed("label", "rep")
    ends = member_hashes(members).join(known.select("rep", "length", F.when(F.col("length") > F.col("last"), F.col("rep")).otherwise(F.col("above")).alias("at")), "rep").select(F.col("at").alias("rep"), F.col("length").alias("depth"), "ends")

    common = chain.where("common").join(about, ["rep", "depth"]).join(up, ["rep", "depth"], "left")
    common = common.select("rep", "depth", F.col("parent"), "members", F.coalesce("kids", F.lit(0)).alias("kids"), F.greatest("leaves", F.lit(1)).alias("leaves"), (F.col("below") + F.col("others")).alias("saved"))
    alone = chain.where("NOT common").withColumn("block", block(F.col("depth") - 1)).join(by_block(known, "length").select("rep", "block", "length", "last", "above"), ["rep", "block"])
    alone = alone.select("rep", "depth", F.when(F.col("depth") == F.col("last") + 1, F.col("above")).otherwise(F.col("rep")).alias("parent"), "members", F.when(F.col("depth") < F.col("length"), 1).otherwise(0).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.col("below").alias("saved"))
    nodes = common.union(alone).join(ends, ["rep", "depth"], "left")
    return nodes.select(F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
