"""Exact Jaccard self-join of word n-gram sets by prefix trees.

1. Equal sets fold into one representative, so copies cost nothing later.
2. Prefix filter: in one order of all members, rare ones first, two sets that reach the threshold share one of their first
   few members, so these are a set's keys.  A sketch of fixed size over all texts gives the order.  Any order keeps all
   links; at every size frequent members, such as those of passages that many documents share, come last.
3. The sets at a key are compared with the first one of it, that of the smallest id: in blocks, a prefix tree over a block's
   sets in one global order is descended by the first set, with a running overlap that all sets below a node share, and left
   where the overlap and what remains on either side cannot reach the threshold.
4. Where this leaves the sets of a key in several components, those of different components meet in blocks.
5. Before sets meet with their texts, in (3) and (4), only their tallies meet, in large blocks: how many members each of some
   quarter as many buckets holds.  Two sets have at least as many members apart as their tallies differ by, so tallies that
   differ by more than linked sets of these sizes can have apart rule a pair out.  Sets with a pair left meet with their texts.
   Only verified links join sets; nothing is compared because strangers chain.
6. Distributed union-find over the links gives the components.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import cell_links, cells_of, in_cells, open_keys, recounted
from .common import WordHash, distinct, mixed, near_keys, settle, shingle_hashes, slices, spread_join, with_least, without_keys
from .graph import components, spanning

# Counters of member_counts(): 32 MB whatever the input, moved in so many chunks.
COUNTERS, CHUNKS = 1 << 24, 256
# Sets in a block of a key, with their texts, and with their tallies alone; a task holds two blocks.
BLOCK, WIDE = 96, 1024
# Members for each bucket of a tally: from LOAD to 2 * LOAD.
LOAD = 4


class Ratio:
    """Similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the threshold lies over 0 and not over 1")
        self.num, self.den = num, den

    def least_overlap(self, total):
        """The least intersection of two sets with `total` members together: den * i >= num * (total - i)."""
        return -(-self.num * total // (self.num + self.den))

    def reach(self, a: str, b: str) -> str:
        """SQL: whether sets of sizes a and b can reach the similarity."""
        return f"{self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b})"

    def most_apart(self, total):
        """The most members that only one of two linked sets with `total` members together holds."""
        return total - 2 * self.least_overlap(total)

    def keys(self, members: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of the first members of a set in the common order, ascending: linked sets have one in common.

        A place is the member's count (see member_counts()), so that rare ones come first, then 48 bits of its hash.
        """
        n = len(members)
        places = (counts[members % np.uint64(len(counts))].astype(np.uint64) << np.uint64(48)) | (mixed(members, 14) >> np.uint64(16))
        return distinct(np.sort(places)[: n - -(-self.num * n // self.den) + 1]) if n else members


def members_of(text: str, width: int, table: WordHash) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text, lower-cased (A-Z) and cut at ASCII white space."""
    return distinct(shingle_hashes(table.of(text.encode().lower().split()), width))


def tally(members: np.ndarray) -> bytes:
    """How many members of a set fall into each of a power of two of buckets, 255 at most; the set's size gives their number."""
    buckets = 1 << max(4, (len(members) // LOAD).bit_length() - 1)
    places = mixed(members, 21) & np.uint64(buckets - 1)
    return np.minimum(np.bincount(places.astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def folded(tallies: list[np.ndarray], buckets: int) -> np.ndarray:
    """Tallies as rows of so many buckets, which is no more than any of them has."""
    return np.stack([t.reshape(-1, buckets).sum(0, dtype=np.int32) for t in tallies])


def member_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many rows hold members of each of COUNTERS slots (a member's hash modulo COUNTERS), over all of `texts`.

    Each task counts up to 255 a slot; so the sums may fall short for frequent members, but 1 means one row at most.
    """
    size = COUNTERS // CHUNKS

    def count(batches):
        table, sums = WordHash(), np.zeros(COUNTERS, dtype=np.uint8)
        for _, found in slices(batches, "text"):
            members = [members_of(t, width, table) for t in found]
            if members:
                slots, n = np.unique(np.concatenate(members) % np.uint64(COUNTERS), return_counts=True)
                slots = slots.astype(np.int64)
                sums[slots] = np.minimum(sums[slots] + n, 255)
        if sums.any():
            packed = [zlib.compress(part.tobytes(), 1) for part in sums.reshape(CHUNKS, size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(chunk, np.zeros(size, dtype=np.uint32))
                sums[chunk] += np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    out = np.zeros((CHUNKS, size), dtype=np.uint16)
    for row in texts.select("text").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], dtype=np.uint16)
    return out.reshape(-1)


class Trie:
    """A prefix tree with compressed edges over sorted sets, kept in flat arrays level by level."""

    def __init__(self, sets: list[np.ndarray]):
        self.tokens, back = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        coded = [back[e - len(s) : e] for s, e in zip(sets, ends)]
        order = sorted(range(len(sets)), key=lambda k: coded[k].tolist())
        rows = [coded[k] for k in order]
        self.size = np.array([len(r) for r in rows])
        self.order = np.array(order)
        common = [0] * (len(rows) + 1)
        for k in range(1, len(rows)):
            a, b = rows[k - 1], rows[k]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[k] = int(differ[0]) if len(differ) else n
        # A node: rows [lo, hi) that share tokens up to `to`; its edge holds tokens from the parent's `to` on.
        self.levels: list[dict[str, np.ndarray]] = []
        level = [(0, len(rows), 0, -1)]
        while level:
            node, following = {k: [] for k in ("lo", "hi", "to", "up", "first", "count", "short", "long", "next")}, []
            edge: list[np.ndarray] = []
            start = 0
            for lo, hi, since, up in level:
                to = len(rows[lo]) if hi == lo + 1 else min(common[lo + 1 : hi])
                part = rows[lo][since:to]
                sizes = self.size[lo:hi]
                for name, value in zip(node, (lo, hi, to, up, start, len(part), int(sizes.min()), int(sizes.max()), int(rows[lo][to - 1]) if to else -1)):
                    node[name].append(value)
                edge.append(part)
                start += len(part)
                if hi > lo + 1:
                    cuts = [lo, *(k for k in range(lo + 1, hi) if common[k] == to), hi]
                    following += [(a, b, to, len(node["lo"]) - 1) for a, b in zip(cuts, cuts[1:])]
            self.levels.append({k: np.array(v) for k, v in node.items()} | {"edge": np.concatenate(edge)})
            level = following

    def linked(self, members: np.ndarray, ratio: Ratio) -> np.ndarray:
        """Places (in the order given) of the sets that reach the threshold with `members`."""
        at = np.searchsorted(self.tokens, members)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == members)]
        mine = np.zeros(len(self.tokens), dtype=np.int64)
        mine[at] = 1
        n, out = len(members), []
        alive, overlap = None, None
        for level in self.levels:
            if alive is None:
                here, so_far = np.arange(len(level["lo"])), np.zeros(len(level["lo"]), dtype=np.int64)
            else:
                place = np.full(width, -1)
                place[alive] = np.arange(len(alive))
                up = place[level["up"]]
                here = np.flatnonzero(up >= 0)
                so_far = overlap[up[here]]
            if not len(here):
                break
            first, count = level["first"][here], level["count"][here]
            total = int(count.sum())
            if total:
                base = np.cumsum(count) - count
                hit = mine[level["edge"][np.repeat(first - base, count) + np.arange(total)]]
                run = np.append(0, np.cumsum(hit))
                so_far = so_far + run[base + count] - run[base]
            # what is still to come, below the node and in `members`
            below = level["long"][here] - level["to"][here]
            ahead = len(at) - np.searchsorted(at, level["next"][here], side="right")
            keep = so_far + np.minimum(below, ahead) >= ratio.least_overlap(n + level["short"][here])
            here, so_far = here[keep], so_far[keep]
            single = level["hi"][here] - level["lo"][here] == 1
            leaves = level["lo"][here[single]]
            out.append(leaves[so_far[single] >= ratio.least_overlap(n + self.size[leaves])])
            alive, overlap, width = here[~single], so_far[~single], len(level["lo"])
        return self.order[np.concatenate(out)] if out else np.zeros(0, dtype=np.int64)


def ngram_join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable over links, itself included) of every document.

    Two documents link when the Jaccard similarity of their sets of `width`-word shingles is num / den or more.
    A text with fewer words is one shingle of all; a null or blank text has an empty set and links with
    nothing.  Ids are whole numbers; rows that share an id come back each with its own n_shingles and are one node,
    and a row without an id comes back with component_id null.  Other columns are left out.  An empty table
    gives an empty table.  Shingles are compared by 64-bit hashes.
    """
    ratio = Ratio(num, den)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(member_counts(texts, width))  # COUNTERS numbers of two bytes

    def sets(batches):
        table, counts = WordHash(), sent.value
        for part, texts in slices(batches, "text"):
            found = [members_of(t, width, table) for t in texts]
            marks = [[int(mixed(s, k).sum(dtype=np.uint64).astype(np.int64)) for s in found] for k in (1, 2)]
            keys = [ratio.keys(s, counts).view(np.int64) for s in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), *(pa.array(m, pa.int64()) for m in marks), pa.array(keys, pa.list_(pa.int64())), pa.array([tally(s) for s in found], pa.binary())], names=["id", "n", "m1", "m2", "keys", "tally"])

    table = settle(texts.mapInArrow(sets, "id long, n long, m1 long, m2 long, keys array<long>, tally binary"))
    sized = table.where("n > 0 AND id IS NOT NULL")
    # (1) one representative for each distinct set
    copies = settle(with_least(sized.select("id", "n", "m1", "m2"), ["m1", "m2", "n"], "id", "rep", several=True).where("id <> rep").select("id", "rep", F.xxhash64("id", "m1").alias("set")).distinct())
    # (2) the sets at each key, and the first of them
    distinct_sets = settle(without_keys(sized.select("id", "n", "keys", "tally", F.xxhash64("id", "m1").alias("set")), "set", copies.select(F.col("set").alias("gone")).distinct()).drop("set"))
    shared = settle(with_least(distinct_sets.select(F.struct(F.col("id").alias("node"), "n").alias("at"), F.explode("keys").alias("key")), ["key"], "at", "lead", several=True))
    # (3) stars, dealt in blocks that hold their first set each
    stars = settle(shared.where("at.node <> lead.node").where(ratio.reach("at.n", "lead.n")).select(F.col("lead.node").alias("key"), F.col("at.node").alias("node")).distinct())
    stars = settle(_left(stars, _perhaps(_in_stars(stars, WIDE), distinct_sets, ratio)))
    near = settle(_met(_in_stars(stars, BLOCK), texts, ratio, width))
    # (4) sets of different components at a key
    opened = open_keys(shared, settle(components(near)))
    perhaps = settle(_perhaps(in_cells(opened, WIDE), distinct_sets, ratio))
    more = settle(_met(in_cells(settle(recounted(opened, perhaps)), BLOCK), texts, ratio, width))
    # (6)
    found = components(near.union(more).union(copies.select("id", "rep")))
    out = table.select("id", "n").join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    return out


def _left(stars: DataFrame, left: DataFrame) -> DataFrame:
    """The rows (key, node) of `stars` that stand in `left` too."""
    return stars.join(left, ["key", "node"], "left_semi")


def _in_stars(stars: DataFrame, block: int) -> DataFrame:
    """key, i, j, node, root and block: the nodes of each star dealt in blocks of about `block` rows, and its first set, the key, in each
    of them; all are roots of their own."""
    blocks = settle(stars.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    spot = F.expr("cast(pmod(xxhash64(node, 7), blocks) AS int)")
    dealt = spread_join(stars, blocks, "key", "node", stars.count()).select("key", spot.alias("i"), F.lit(-1).alias("j"), "node", F.col("node").alias("root"), spot.alias("block"))
    firsts = blocks.select("key", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), F.lit(-1).alias("j"), F.col("key").alias("node"), F.col("key").alias("root"), F.lit(-1).alias("block"))
    return dealt.union(firsts)


def apart(mine: np.ndarray, held: np.ndarray, starts: np.ndarray, lasts: np.ndarray, common: np.ndarray) -> np.ndarray:
    """How many keys only one of two sets has, up to the smaller of their last keys: `mine` against the runs of `held` that
    begin at `starts` and end with `lasts`; common: how many keys each run shares with `mine`.  Keys ascend and none is empty.

    No more than the members that only one of the sets holds: up to its last key, a set's keys are all of its places.
    """
    return np.add.reduceat((held <= mine[-1]).astype(np.int64), starts) + np.searchsorted(mine, lasts, side="right") - 2 * common


def _perhaps(cells: DataFrame, sets: DataFrame, ratio: Ratio) -> DataFrame:
    """key, node of the rows of cells that may link with a row of another root in a cell of theirs, by sizes and tallies alone.

    sets: id, n and tally of all sets.
    """
    cells = settle(cells)
    held = near_keys(sets.select("id", "n", "tally"), "id", settle(cells.select("node").distinct())).join(cells, F.col("id") == F.col("node")).select("key", "i", "j", "block", "root", "node", "n", "tally")

    def compare(cell: pa.Table) -> np.ndarray:
        """Which rows of a cell have a partner."""
        i, j = cell["i"][0].as_py(), cell["j"][0].as_py()
        block, root, n = (cell[c].to_numpy() for c in ("block", "root", "n"))
        tallies = [np.frombuffer(x, dtype=np.uint8) for x in cell["tally"].to_pylist()]
        buckets = np.array([len(x) for x in tallies])
        index, probes, found = np.flatnonzero(block == i), np.flatnonzero(block == j), np.zeros(len(n), dtype=bool)
        # two tallies are compared in as many buckets as the smaller one has
        for size in distinct(buckets).tolist():
            here, there = index[buckets[index] >= size], probes[buckets[probes] >= size]
            if not len(here) or not len(there):
                continue
            rows = folded([tallies[k] for k in here], size)
            for k in there:
                small, large = np.minimum(n[here], n[k]), np.maximum(n[here], n[k])
                some = np.flatnonzero((np.minimum(buckets[here], buckets[k]) == size) & (root[here] != root[k]) & (ratio.den * small >= ratio.num * large))
                if len(some):
                    differ = np.abs(rows[some] - folded([tallies[k]], size)).sum(1)
                    good = differ <= ratio.most_apart(n[here[some]] + n[k])
                    found[here[some[good]]] = True
                    found[k] |= good.any()
        return found

    def run(batches):
        for cell in cells_of(batches):
            yield from cell.filter(pa.array(compare(cell))).select(["key", "node"]).combine_chunks().to_batches()

    dealt = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "key long, node long").distinct()


def _met(cells: DataFrame, texts: DataFrame, ratio: Ratio, width: int) -> DataFrame:
    """Links (a, b), as forests, within the cells (key, i, j) of rows key, i, j, node, root, block.

    In each cell the sets of block i form a prefix tree that those of block j descend; links of equal roots are left out.
    """
    cells = settle(cells)
    held = near_keys(texts, "id", settle(cells.select("node").distinct())).join(cells, F.col("id") == F.col("node")).select("key", "i", "j", "block", "root", "id", "text")
    words = WordHash()

    def compare(rows: list[dict]) -> list[tuple]:
        found = [members_of(r["text"] or "", width, words) for r in rows]
        # an id that stands on several rows: only rows with a set count
        index = [k for k, r in enumerate(rows) if r["block"] == r["i"] and len(found[k])]
        probe = [k for k, r in enumerate(rows) if r["block"] == r["j"] and len(found[k])]
        if not index or not probe:
            return []
        trie, links = Trie([found[k] for k in index]), []
        for k in probe:
            a, root = rows[k]["id"], rows[k]["root"]
            for x in trie.linked(found[k], ratio).tolist():
                b = rows[index[x]]
                if a != b["id"] and (root is None or root != b["root"]):
                    links.append((a, b["id"]))
        return spanning(links)

    return cell_links(held, compare, "bigint")


def keep_first(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one document, that of the smallest id, of each component of ngram_join(); rows without an id stay."""
    found = ngram_join(docs, width, num, den, id_col, text_col)
    gone = settle(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("gone")).distinct())
    return without_keys(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id")), "id", gone).select("row.*")
