"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a slice of texts lie one after another in flat numpy arrays.  Each round finds
every sequence's lowest-rank pair (leftmost among equals) with one segmented minimum and merges all of
them at once; sequences without a pair leave.  What survives is counted: one for a piece, one for each
UTF-8 byte of a character that the vocabulary lacks.
"""

from __future__ import annotations

import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .pieces import PieceVocab, vocab

NONE = np.int64(2**62)


class RankMerger:
    # Longer pre-tokens take the same merges one by one from a heap: a round for each would be quadratic.
    LONG = 200
    BATCH = 60_000

    def __init__(self, v: PieceVocab):
        self.v = v
        keys = np.array([a * 65536 + b for a, b in v.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        values = np.array(list(v.pairs.values()), dtype=np.int64).reshape(-1, 2)[order]
        self.ranks, self.made = np.append(values[:, 0], 0), np.append(values[:, 1], 0).astype(np.int32)

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair; NONE where it does not merge."""
        want = left.astype(np.int64) * 65536 + right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.ranks[at], NONE), self.made[at]

    def symbols(self, word: str) -> tuple[list[int], int]:
        """Ids of the characters; unknown ones as unk, and how many bytes more than one token each they take."""
        try:
            return [*map(self.v.ids.__getitem__, word)], 0
        except KeyError:
            ids = [self.v.ids.get(c, -1) for c in word]
        return [self.v.unk if i < 0 else i for i in ids], sum(len(c.encode()) - 1 for c, i in zip(word, ids) if i < 0)

    def counts(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for k in range(0, len(words), self.BATCH):
            out += self._batch(words[k : k + self.BATCH])
        return out

    def _batch(self, words: list[str]) -> list[int]:
        got = [self.symbols(w) for w in words]
        result = np.array([extra for _, extra in got], dtype=np.int64)
        long = [k for k, (ids, _) in enumerate(got) if len(ids) > self.LONG]
        for k in long:
            result[k] += self._by_heap(got[k][0])
        short = [k for k, (ids, _) in enumerate(got) if 0 < len(ids) <= self.LONG]
        if short:
            sizes = np.array([len(got[k][0]) for k in short])
            flat = np.fromiter(itertools.chain.from_iterable(got[k][0] for k in short), dtype=np.int32, count=int(sizes.sum()))
            result[short] += self._rounds(flat, sizes)
        return result.tolist()

    def _rounds(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence."""
        left, who = sizes.copy(), np.arange(len(sizes))
        ranks, made = self._pairs(flat, sizes)
        while len(who):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(ranks, starts)
            going = best < NONE
            left[who[~going]] = sizes[~going]
            if not going.any():
                break
            # the leftmost pair of that rank in each sequence
            hits = np.flatnonzero(ranks == np.repeat(np.where(going, best, -1), sizes))
            owner = np.searchsorted(starts, hits, side="right") - 1
            at = hits[np.append(True, owner[1:] != owner[:-1])]
            flat[at] = made[at]
            keep = np.repeat(going, sizes)
            keep[at + 1] = False
            # pairs change at the merged symbol and just before it
            first = np.zeros(len(flat), dtype=bool)
            first[starts] = True
            before = at[~first[at]] - 1
            moved = np.cumsum(keep) - 1
            flat, ranks, made = flat[keep], ranks[keep], made[keep]
            who, sizes = who[going], sizes[going] - 1
            last = np.zeros(len(flat), dtype=bool)
            last[np.cumsum(sizes) - 1] = True
            change = moved[np.concatenate([at, before])]
            ranks[last] = NONE
            change = change[~last[change]]
            ranks[change], made[change] = self.looked_up(flat[change], flat[change + 1])
        return left

    def _pairs(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranks, made = self.looked_up(flat, np.append(flat[1:], 0))
        ranks[np.cumsum(sizes) - 1] = NONE
        return ranks, made

    def _by_heap(self, ids: list[int]) -> int:
        pairs, n = self.v.pairs, len(ids)
        ids, after, prev = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        alive = n
        while heap:
            _, k, a, b = heapq.heappop(heap)
            r = after[k]
            if ids[k] != a or r >= n or ids[r] != b:
                continue
            ids[k], ids[r] = pairs[a, b][1], -1
            alive -= 1
            after[k] = after[r]
            if after[k] < n:
                prev[after[k]] = k
                if (ids[k], ids[after[k]]) in pairs:
                    heapq.heappush(heap, (pairs[ids[k], ids[after[k]]][0], k, ids[k], ids[after[k]]))
            p = prev[k]
            if p >= 0 and (ids[p], ids[k]) in pairs:
                heapq.heappush(heap, (pairs[ids[p], ids[k]][0], p, ids[p], ids[k]))
        return alive


class CachedCounts(dict):
    """Counts of pre-tokens seen before, up to a bound."""

    BOUND = 500_000

    def __init__(self, v: PieceVocab):
        self.merger = RankMerger(v)

    def of(self, texts: list[str]) -> list[int]:
        parts = [self.merger.v.segments(t) for t in texts]
        new = [s for s in set().union(*parts) if s not in self]
        if len(self) + len(new) > self.BOUND:
            self.clear()
            new = list(set().union(*parts))
        self.update(zip(new, self.merger.counts(new)))
        return [sum(map(self.__getitem__, p)) for p in parts]


@functools.lru_cache(maxsize=1)
def counts_of(path: str) -> CachedCounts:
    """One table for each worker process."""
    return CachedCounts(vocab(path))


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every text, as the sentencepiece model at model_path counts them.

    No begin, end or added special tokens; strings that look like special tokens are plain text.  Null and
    empty texts have 0 bytes and 0 tokens.  Rows come back one for one: repeated ids and texts stay, null
    ids stay null, other columns are left out.  An empty table gives an empty table.
    """

    def run(batches):
        counts = counts_of(model_path)
        for part, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts.of(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    picked = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
