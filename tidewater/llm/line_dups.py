"""Fuzzy line deduplication by MinHash.

Lines (lower-cased, trimmed) that are equal fold first.  Each distinct line gets bands of a one-permutation MinHash over
its character 5-grams: the BOTTOM next hashes after each of BANDS points make a key, so a pair of similarity J shares one with
a chance of about 1 - (1 - J ** BOTTOM) ** BANDS.  Lines that share a key are compared with the first of that key; the lines
of keys that this leaves in several components meet in blocks, and those of keys with very many lines by an exact prefix
filter (Chaudhuri et al. 2006).  Candidates are verified by the exact Jaccard similarity of their sets of
character 5-grams, and distributed union-find keeps the first line of each component.

Shingles are hashed and compared in numpy on Arrow batches; everything else is DataFrame operations.  The README has the
figures of the form without Python that this replaces.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import cell_links, in_cells, open_keys
from .common import distinct, drop_settled, mixed, near_keys, settle, spread_join, told_apart, with_least, without_keys
from .graph import components, spanning

WIDTH, BANDS, BOTTOM, SIMILARITY = 5, 18, 6, 0.8
# Lines of up to SHORT 5-grams have keys of FEW hashes, for lack of longer runs in common; a line that may be close to one of
# more than SHORT has keys of BOTTOM hashes (too), so close lines always have a kind in common.
SHORT, FEW = 60, 3
# Lines in a block of comparisons; keys of more lines than LARGE go through the prefix filter.
BLOCK, LARGE = 128, 4096
# Counters that order 5-grams by how rare they are; a fixed size, since any order keeps all pairs.
SLOTS = 1 << 16
# Characters that are handled at once.
PIECE = 100_000
# What is cut off either end of a line, and makes a line blank.
BLANKS = " \t\r\x0b\x0c"
_FACTORS = mixed(np.arange(WIDTH, dtype=np.uint64), 31) | np.uint64(1)
_POINTS = np.arange(BANDS, dtype=np.uint64) * np.uint64((1 << 40) // BANDS)


def gram_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of WIDTH characters, line after line, and how many each line has."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    counts = np.maximum(sizes - WIDTH + 1, 0)
    if not counts.sum():
        return np.zeros(0, dtype=np.uint64), counts
    with np.errstate(over="ignore"):
        h = chars[: len(chars) - WIDTH + 1] * _FACTORS[0]
        for k in range(1, WIDTH):
            h += chars[k : len(chars) - WIDTH + 1 + k] * _FACTORS[k]
    # runs that begin in the last characters of a line reach into the next one
    starts = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts)
    return mixed(h[starts + np.arange(len(starts))]), counts


def gram_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct 5-gram hashes of each line."""
    h, counts = gram_hashes(lines)
    return [distinct(x) for x in np.split(h, np.cumsum(counts)[:-1])] if lines else []


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct 5-grams each line has, how many distinct keys, and the keys of all lines in a row."""
    h, counts = gram_hashes(lines)
    top = np.uint64(40)
    ring = distinct((np.repeat(np.arange(len(lines), dtype=np.uint64), counts) << top) | (h >> np.uint64(24)))
    n = np.bincount((ring >> top).astype(np.int64), minlength=len(lines))
    start = np.cumsum(n) - n
    out, used = np.zeros((len(lines), 2, BANDS), dtype=np.uint64), np.zeros((len(lines), 2, BANDS), dtype=bool)
    some = np.flatnonzero(n)
    # the first hash after each point, going round
    at = np.searchsorted(ring, (some.astype(np.uint64)[:, None] << top) | _POINTS) - start[some][:, None]
    for kind, run in enumerate((BOTTOM, FEW)):
        key = np.full(at.shape, run, dtype=np.uint64)
        for j in range(run):
            key = mixed(key ^ (ring[start[some][:, None] + (at + j) % n[some][:, None]] & np.uint64((1 << 40) - 1)), j)
        key.sort(1)
        out[some, kind] = key
        used[some, kind, 1:] = key[:, 1:] != key[:, :-1]
        used[some, kind, 0] = True
    used[:, 0] &= (n > int(SHORT * SIMILARITY))[:, None]
    used[:, 1] &= (n <= SHORT)[:, None]
    return n, used.sum((1, 2)), out[used]


def _pieces(lines: list[str]):
    """Begin and end of stretches of about PIECE characters."""
    cut = np.cumsum([len(x) for x in lines]) // PIECE
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(lines)]
    yield from zip(edges, edges[1:])


def close(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with `both` common members reach SIMILARITY (8 to 10), in whole numbers."""
    return (a > 0) & (b > 0) & (18 * both >= 8 * (a + b))


def linked_lines(left: list[np.ndarray], right: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of the pairs (left, right) of 5-gram sets that reach SIMILARITY, by an array of marks for each set of `left`."""
    if not left or not right:
        return []
    sizes = np.array([len(x) for x in right])
    known, coded = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    out = []
    for i, x in enumerate(left):
        if not len(x) or not len(known):
            continue
        at = np.searchsorted(known, x)
        at = at[known[np.minimum(at, len(known) - 1)] == x] if len(known) else at[:0]
        mark = np.zeros(len(known), dtype=np.int64)
        mark[at[at < len(known)]] = 1
        both = np.add.reduceat(mark[coded], starts[some])
        out += [(i, j) for j in some[close(len(x), sizes[some], both)].tolist()]
    return out


def with_keys(lines: DataFrame) -> DataFrame:
    """node, n (distinct 5-grams) and keys of lines (node, line); lines of fewer than WIDTH characters are left out."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _pieces(texts):
                n, sizes, keys = line_keys(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(keys.view(np.int64)))], names=["node", "n", "keys"])

    node = lines.schema["node"].dataType.simpleString()
    return lines.select("node", "line").where(f"length(line) >= {WIDTH}").mapInArrow(run, f"node {node}, n int, keys array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, copy, text of the rows that have both; copy tells texts of one id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    seen = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (seen or 0) > 1:
        return rows.withColumn("copy", F.xxhash64("text")).dropDuplicates(["id", "copy"])
    return rows.withColumn("copy", F.lit(0).cast("long"))


def _lines(rows: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], list[Column]]:
    """What gives node and line of every line that is not blank of such rows, and how to read id, copy and line_no from a node.

    A node is one number where ids and line counts leave room for it, else a struct; either sorts by id first.
    """
    most = rows.agg(F.min("id"), F.max("id"), F.max(F.length("text") - F.length(F.replace("text", F.lit("\n")))), F.max(F.abs("copy"))).first()
    bits = int(most[2] or 0).bit_length()
    if most[0] is not None and most[0] >= 0 and most[1] < 1 << (62 - bits) and not most[3]:
        node = F.shiftleft("id", bits) + F.col("line_no")
        fields = [F.shiftright("node", bits).alias("id"), F.lit(0).cast("long").alias("copy"), F.col("node").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("line_no")]
    else:
        node, fields = F.struct("id", "copy", "line_no"), [F.col("node.id"), F.col("node.copy"), F.col("node.line_no")]

    def cut(some: DataFrame) -> DataFrame:
        each = some.select("id", "copy", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw"))  # outer: or the split is made twice, for a filter too
        return each.select(node.alias("node"), F.lower(F.expr(f"trim(BOTH '{BLANKS}' FROM raw)")).alias("line")).where("line <> ''")

    return cut, fields


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, copy and line_no of every line that a line before it makes superfluous.

    Lines are what newlines separate, numbered from 0, lower-cased and trimmed for comparison; blank ones are never
    duplicates.  Lines of one component of the pairs found with a Jaccard similarity of SIMILARITY or more over
    character 5-grams (shorter lines: only equal ones) keep the smallest (id, copy, line_no).  Null ids and texts take
    no part.  Rows that repeat an id and the text are one; copy is 0 unless ids repeat, then the hash of the text.
    """
    rows = _rows(docs, id_col, text_col)
    cut, fields = _lines(rows)
    lines = cut(rows)
    hashed = settle(lines.select("node", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    exact = settle(with_least(hashed, ["h1", "h2"], "node", "keeper", several=True).where(F.col("node") != F.col("keeper")).select("node"))
    drop_settled(hashed)

    def lines_of(nodes: DataFrame) -> DataFrame:
        """The lines of the documents that nodes (a column node) stand in; only their texts are split."""
        return cut(near_keys(rows, "id", settle(nodes.select(fields[0]).distinct())))

    keyed = settle(with_keys(without_keys(lines, "node", exact)))
    placed = keyed.select(F.struct("node", "n").alias("at"), F.explode("keys").alias("key"))
    shared = settle(with_least(placed, ["key"], "at", "lead", several=True))
    drop_settled(keyed)
    drawn = shared.where("at <> lead").where(_sizes("at.n", "lead.n")).select(F.col("at.node").alias("b"), F.col("lead.node").alias("a")).distinct()
    drawn = settle(drawn)
    linked = settle(verified(drawn, lines_of(drawn.select(F.explode(F.array("a", "b")).alias("node")))))
    opened = open_keys(shared, settle(components(linked)))
    large = F.col("most") + F.col("other") > LARGE
    few, many = opened.where(~large), opened.where(large)
    lines = lines_of(opened)
    groups = components(linked.union(_in_blocks(few, lines)).union(verified(_by_prefix(many, lines), lines)))
    return exact.union(groups.where("node <> root").select("node")).select(*fields)


def _sizes(a: str, b: str) -> str:
    """Whether sets of sizes a and b can reach SIMILARITY."""
    return f"least({a}, {b}) >= {SIMILARITY} * greatest({a}, {b}) - 1e-9"


def _in_blocks(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The linked pairs (a, b), as forests, of lines of different roots that share a key; rows: see open_keys()."""
    text = near_keys(lines, "node", settle(rows.select("node").distinct()))
    met = in_cells(rows, BLOCK).join(text, "node").select("key", "i", "j", "node", "root", "block", "line")
    kind = met.schema["node"].dataType.simpleString()
    named = met.select("key", "i", "j", F.to_json(F.struct("node")).alias("name"), "root", "block", "line") if kind.startswith("struct") else met.withColumnRenamed("node", "name")
    code = "string" if kind.startswith("struct") else kind

    def compare(rows: list[dict]) -> list[tuple]:
        sets = gram_sets([r["line"] for r in rows])
        left, right = ([k for k, r in enumerate(rows) if r["block"] == r[side]] for side in "ij")
        pairs = [(rows[left[x]], rows[right[y]]) for x, y in linked_lines([sets[k] for k in left], [sets[k] for k in right])]
        return spanning((x["name"], y["name"]) for x, y in pairs if x["root"] != y["root"])

    found = cell_links(named, compare, code)
    if kind.startswith("struct"):
        found = found.select(*(F.from_json(c, f"node {kind}").getField("node").alias(c) for c in "ab"))
    return settle(found)


def _by_prefix(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines of different components that can be similar; rows: see open_keys().

    With 5-grams in one order for all lines, rare ones first, the first one that two similar lines share has enough of
    either line behind it; so pairs meet at the head of their lines, where a passage that many lines hold does not stand.
    Every pair of similar lines comes; those of a 5-gram's largest component meet only the other ones.
    """
    ends = settle(rows.select("node", "root").distinct())
    node, root = (ends.schema[c].dataType.simpleString() for c in ("node", "root"))
    held = settle(near_keys(lines, "node", ends.select("node")).join(ends, "node").select("node", "root", "line"))

    def grams(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _pieces(texts):
                slots = [x % np.uint64(SLOTS) for x in gram_sets(texts[a:b])]
                slot, n = np.unique(np.concatenate(slots), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n, pa.int64())], names=["slot", "n"])

    rarity = np.zeros(SLOTS, dtype=np.int64)
    for r in held.select("line").mapInArrow(grams, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS rows at most
        rarity[r["slot"]] = int(8 * math.log2(r["n"]))

    def heads(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _pieces(texts):
                sets = gram_sets(texts[a:b])
                first = [x[np.lexsort((x, rarity[x % np.uint64(SLOTS)]))][: len(x) - (8 * len(x) + 9) // 10 + 1].view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(x) for x in sets], pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=["node", "root", "n", "head"])

    found = settle(held.mapInArrow(heads, f"node {node}, root {root}, n int, head array<long>").where("n > 0"))
    drop_settled(held)
    rows = found.select("node", "root", "n", F.posexplode("head").alias("pos", "gram"))
    spots = rows.groupBy("gram", "root").agg(F.count("*").alias("k")).groupBy("gram").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("k"), F.count("*").alias("roots"))
    spots = settle(spots.where("roots > 1").select("gram", "main", F.ceil(F.col("k") / 1024).cast("int").alias("blocks")))
    met = settle(near_keys(rows, "gram", spots.select("gram")).join(spots, "gram"))
    drop_settled(found)
    one = met.where("root <> main").select("gram", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    two = met.select("gram", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.expr("cast(pmod(xxhash64(node, 7), blocks) AS int)").alias("block"))
    enough = F.expr(f"ra <> rb AND least(na - pa, nb - pb) * {1 + SIMILARITY} >= {SIMILARITY} * (na + nb) - 1e-9")
    pairs = one.join(two, ["gram", "block"]).where(enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return settle(pairs.distinct())


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines whose 5-gram sets reach SIMILARITY."""
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    near = near_keys(lines, "node", ends)
    # a line that leads very many others is dealt over salts
    a = spread_join(pairs, near.select(F.col("node").alias("a"), F.col("line").alias("la")), "a", "b", pairs.count())
    both = a.join(near.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b").select("a", "b", "la", "lb")
    node = both.schema["a"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in _pieces([x + y for x, y in zip(left, right)]):
                pairs = zip(gram_sets(left[a:b]), gram_sets(right[a:b]))
                good = [bool(close(len(x), len(y), len(x) + len(y) - len(distinct(np.concatenate([x, y]))))) for x, y in pairs]
                yield batch.select([0, 1]).slice(a, b - a).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, f"a {node}, b {node}")


def removed_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines and removed (sorted numbers of superfluous lines) of each document.

    Null texts have 0 lines, null ids come back as they are; rows that repeat an id and its text come back once for each row.
    """
    gone = duplicate_lines(docs, id_col, text_col).groupBy("id", "copy").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n"))).alias("n_lines"), F.xxhash64(text_col).alias("mark"))
    one = gone.where("copy = 0").select("id", "removed")
    told = gone.where("copy <> 0").select(F.col("id").alias("i2"), F.col("copy").alias("mark2"), F.col("removed").alias("r2"))
    joined = rows.join(one, "id", "left").join(told, (F.col("id") == F.col("i2")) & (F.col("mark") == F.col("mark2")), "left")
    return joined.select(F.col("id").alias(id_col), "n_lines", F.coalesce("removed", "r2", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with superfluous lines cut out of its texts; texts of which nothing but blank lines is left go.

    Rows without an id or text stay as they are.  Only rows of documents that lose lines are moved.
    """
    gone = settle(duplicate_lines(docs, id_col, text_col).groupBy("id", "copy").agg(F.collect_list("line_no").alias("gone")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    touched, rest = told_apart(rows, "id", gone.select("id").distinct())
    marked = touched.join(gone, (touched["id"] == gone["id"]) & ((gone["copy"] == 0) | (gone["copy"] == F.xxhash64("text"))), "left").select("text", "row", "gone")
    # the numbers that stay, and the lines at them: nested lambdas name the split text once
    left = "array_join(transform(array(split(text, '\\n')), x -> transform(array_except(sequence(0, size(x) - 1), gone), i -> x[i]))[0], '\\n')"
    cut = marked.select("row", F.col("gone").isNull().alias("whole"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr(left)).alias("text"))
    cut = cut.where(F.col("whole") | F.col("text").rlike("[^\\s]"))
    kept = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cut.select(*kept).union(rest.select("row.*"))
