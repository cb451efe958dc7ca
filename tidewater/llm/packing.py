"""Packing of tokenised documents into sequences of fixed length: shortest pack first, over the histogram of lengths.

A document's ids are cut into full sequences and a remainder.  How many remainders there are of each length decides
everything (the histogram of Krell et al., "Efficient Sequence Packing without Cross-contamination", 2021): lengths are
placed longest first, each into the pattern with the most room, and a pattern counts how many sequences look like it.
Once what is left to place would just fill the room in open patterns, no pattern is opened any more and a length that
fits nowhere whole is cut at the room of the emptiest pattern; its rest is placed in its turn.  Documents then find
their patterns by their rank among the documents of their length.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, slices

END = "<|endoftext|>"
# Texts are encoded in runs of about this many characters that end where no token can cross.
RUN = 200_000


class Encoder:
    """Ids of a byte-level BPE: the ranks in one library, since they are the same and it is three times as fast; what
    its regular expressions cannot hold (very long runs of blanks) goes through the other library, which reads the
    vocabulary file itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.slow = Tokenizer.from_file(json_path)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END: self.slow.token_to_id(END)})

    def _ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """The ids and a final 0.  A long text is cut before single blanks between two letters, which start a token."""
        parts, at = [], 0
        while at < len(text):
            end = at + RUN
            while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
                end += 1
            parts.append(self._ids(text[at:end]))
            at = end
        return np.concatenate([*parts, [0]]).astype("<u4")


@functools.lru_cache(maxsize=1)
def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(json_path, ranks_path, pattern)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """Patterns for `histogram`, the number of items of each length under `size`.

    A pattern is how many sequences look like it, and its pieces: (length of the item, rank of the first item of that
    length, where in the item the piece starts, its length); the k-th sequence takes the k-th next ranks.  The number of
    patterns follows the number of lengths, not of items.
    """
    waiting = defaultdict(list)  # by length: (item length, first rank, start, count)
    for length, count in histogram.items():
        if count:
            waiting[length].append((length, 0, 0, count))
    lengths = [-x for x in waiting]
    heapq.heapify(lengths)
    open_, done = defaultdict(list), []  # open patterns by room
    rooms: list[int] = []
    left = sum(length * count for length, count in histogram.items())
    space = 0

    def put(room, count, pieces):
        if room:
            if not open_[room]:
                heapq.heappush(rooms, -room)
            open_[room].append((count, pieces))
        else:
            done.append((count, pieces))

    while lengths:
        length = -heapq.heappop(lengths)
        for whole, rank, start, count in waiting.pop(length):
            while count:
                while rooms and not open_[-rooms[0]]:
                    heapq.heappop(rooms)
                room = -rooms[0] if rooms else 0
                if room >= length or (room and space >= left):
                    many, pieces = open_[room].pop()
                    n, piece = min(many, count), min(room, length)
                    if n < many:
                        open_[room].append((many - n, [(w, r + n, s, p) for w, r, s, p in pieces]))
                    put(room - piece, n, [*pieces, (whole, rank, start, piece)])
                    space -= n * piece
                    if piece < length:
                        if not waiting[length - piece]:
                            heapq.heappush(lengths, piece - length)
                        waiting[length - piece].append((whole, rank, start + piece, n))
                else:
                    # as many new sequences as it takes until the room in them suffices for all that is left
                    piece = length
                    n = count if size == length else min(count, max(1, -(-(left - space) // size)))
                    put(size - length, n, [(whole, rank, start, length)])
                    space += n * (size - length)
                left -= n * piece
                rank, count = rank + n, count - n
    return done + [p for found in open_.values() for p in found]


def segments(patterns: list[tuple[int, list[tuple[int, int, int, int]]]]) -> list[tuple]:
    """(item length, first rank, one past the last rank, pieces of these items) where every item of a range has the same
    pieces: (start, length, sequence of an item of rank 0, offset)."""
    pieces = defaultdict(list)
    first = 0
    for count, inside in patterns:
        offset = 0
        for whole, rank, start, length in inside:
            pieces[whole].append((rank, rank + count, (start, length, first - rank, offset)))
            offset += length
        first += count
    out = []
    for whole, found in pieces.items():
        edges = sorted({e for a, b, _ in found for e in (a, b)})
        at = {e: k for k, e in enumerate(edges)}
        inside = [[] for _ in edges]
        for a, b, piece in found:
            for k in range(at[a], at[b]):
                inside[k].append(piece)
        out += [(whole, a, b, sorted(p)) for a, b, p in zip(edges, edges[1:], inside) if p]
    return out


def tokens(df: DataFrame, encoder_args: tuple[str, str, str], size: int, id_col: str, text_col: str) -> DataFrame:
    """id, part, length n, rest = n % size, the row's place among the part's rows of that rest, the number of full sequences
    in the part's rows before it, and the ids as little-endian unsigned 32-bit numbers."""

    def run(batches):
        enc, seen, full, part = encoder(*encoder_args), np.zeros(size, dtype=np.int64), 0, TaskContext.get().partitionId()
        for rows, texts in slices(batches, "text"):
            ids = [enc.ids(t) for t in texts]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            rest = n % size
            place = np.empty(len(n), dtype=np.int64)
            for k, r in enumerate(rest.tolist()):
                place[k] = seen[r]
                seen[r] += 1
            before = full + np.cumsum(n // size) - n // size
            full += int((n // size).sum())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(n), part, dtype=np.int64)), *map(pa.array, (n, rest, place, before)), pa.array([x.tobytes() for x in ids], pa.binary())], names=["id", "part", "n", "rest", "place", "before", "ids"])

    picked = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, part long, n long, rest long, place long, before long, ids binary")


PIECE = "array<struct<start:bigint,length:bigint,sequence:bigint,offset:bigint>>"


def pack(df: DataFrame, encoder_args: tuple[str, str, str], size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id and
    offset, the place in its sequence.

    A document is its ids and a final 0; a null or empty text is that 0 alone.  The remainders' sequences are numbered
    from 0, the full ones follow, without gaps.  Repeated rows and null ids are documents of their own; texts are never
    shortened; an empty table gives an empty table.  Texts are encoded once.  The histogram (at most size - 1
    counts) and the patterns that follow from it are all that the driver sees, and what is broadcast.
    """
    coded = settle(tokens(df, encoder_args, size, id_col, text_col))
    narrow = settle(coded.groupBy("part", "rest").agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("n") / size)).alias("full")))
    by_rest = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = narrow.select("part", "rest", F.coalesce(F.sum("rows").over(by_rest), F.lit(0)).alias("rank0"))
    # one row for each part of the input
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fulls = narrow.groupBy("part").agg(F.sum("full").alias("full")).select("part", F.coalesce(F.sum("full").over(by_part), F.lit(0)).alias("full0"))
    starts = settle(ranks.join(fulls, "part"))

    histogram = {r["rest"]: r["rows"] for r in narrow.groupBy("rest").agg(F.sum("rows").alias("rows")).collect()}
    patterns = shortest_pack_first({k: v for k, v in histogram.items() if k}, size)
    packs = sum(count for count, _ in patterns)
    found = defaultdict(lambda: ([], []))
    for rest, low, _, pieces in segments(patterns):
        found[rest][0].append(low)
        found[rest][1].append(pieces)
    table = df.sparkSession.createDataFrame([(k, *v) for k, v in found.items()], f"rest long, lows array<bigint>, inside array<{PIECE}>")

    met = coded.join(starts, ["part", "rest"]).withColumn("rank", F.col("rank0") + F.col("place")).join(F.broadcast(table), "rest", "left")
    # the last range that starts at or before the rank, by halving
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(max((len(v[0]) for v in found.values()), default=1).bit_length()))))
    at = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("lows", at + step) <= F.col("rank"), at + step).otherwise(at))
    met = met.withColumn("pieces", F.get("inside", at))
    full = F.floor(F.col("n") / size)
    own = F.transform(F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<bigint>")), lambda k: F.struct((k * size).alias("start"), F.lit(size).cast("long").alias("length"), (packs + F.col("full0") + F.col("before") + k).alias("sequence"), F.lit(0).cast("long").alias("offset")))
    tail = F.transform(F.coalesce("pieces", F.array().cast(PIECE)), lambda p: F.struct((full * size + p["start"]).alias("start"), p["length"].alias("length"), (p["sequence"] + F.col("rank")).alias("sequence"), p["offset"].alias("offset")))
    # the ids are cut before rows are multiplied, so that a long document is not copied for each of its pieces
    cut = F.transform(F.concat(own, tail), lambda p: F.struct(p["start"], p["length"], F.substring("ids", (4 * p["start"] + 1).cast("int"), (4 * p["length"]).cast("int")).alias("ids"), p["sequence"], p["offset"]))
    return met.select("id", "n", F.explode(cut).alias("p")).select(F.col("id").alias(id_col), "p.start", "p.length", "p.ids", F.col("n").alias("doc_tokens"), F.col("p.sequence").alias("sequence_id"), "p.offset")
