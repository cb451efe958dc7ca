"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training follows McMahan et al., "Ad Click Prediction" (2013): per-coordinate rates and L1 sparsity, and only
features that several training rows share.  Features are hashed side by side; one task then learns from a bounded
sample of labelled rows.  What is left is a sparse vector of at most 2**BITS weights, small enough to broadcast.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, distinct, mixed, slices

BITS = 20
# The bound on labelled rows to learn from.
TRAIN_ROWS = 16_000
# Rates of the learner; a positive row counts POSITIVE times, and a feature must stand in MIN_ROWS rows.
# EPOCHS and L1 are for TRAIN_ROWS rows; fewer rows are read more often and shrink less, by one smooth rule.
EPOCHS, ALPHA, BETA, L1, L2, POSITIVE, MIN_ROWS = 6, 2.0, 1.0, 8.0, 1.0, 2.0, 2

# White space and ASCII punctuation separate words.
_APART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(text: str, table: WordHash) -> np.ndarray:
    """Slots of all words, word pairs, and pairs with one word skipped, with repeats."""
    h = table.of(text.lower().encode().translate(_APART).split())
    with np.errstate(over="ignore"):
        right = mixed(h, 7)
        parts = [h, mixed(h[:-1] ^ right[1:], 1), mixed(h[:-2] ^ right[2:], 2)]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def packed_rows(column: pa.Array) -> list[np.ndarray]:
    """The numbers in each row of a binary column, as views of its buffer."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1] // 4
    flat = np.frombuffer(data, dtype="<i4", count=int(ends[-1])) if data is not None else np.zeros(0, dtype="<i4")
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


class Ftrl:
    """The last slot is the constant term; it has no L1 penalty."""

    def __init__(self, l1: float = L1, slots: int = 1 << BITS):
        self.z, self.n, self.l1 = np.zeros(slots + 1), np.zeros(slots + 1), l1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label) * (POSITIVE if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the non-zero weights (slot 2**BITS: the constant term).

    usable: which rows of `labels` to learn from, over its columns.  Of more than TRAIN_ROWS such rows, those with the
    smallest hashes of the id are taken (about TRAIN_ROWS of them).  Null ids or labels are not used; an id that is
    labelled twice is positive if any of its labels is.  Nothing to learn from: no weights.
    """
    known = labels.where(usable).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    rows = known.count()
    if rows > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / rows))
    # at most about TRAIN_ROWS pairs of numbers: this is what is broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "text", "y")

    def hashed(batches):
        table = WordHash()
        for part, texts in slices(batches, "text"):
            slots = [np.append(distinct(features(t, table)), 1 << BITS).astype("<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array(slots, pa.binary()), part.column(2)], names=["id", "slots", "y"])

    def train(batches):
        # slots stay in the Arrow buffers they came in, then in one array: a Python object for each row would stay with the worker
        ids, labels, held = [], [], []
        shared = np.zeros((1 << BITS) + 1, dtype=np.int64)
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(2).to_pylist()
            held += packed_rows(b.column(1))
        for at in held:
            shared[at] += 1
        order = sorted(range(len(ids)), key=lambda k: (ids[k], held[k].tobytes() if twice[ids[k]] > 1 else b"", labels[k])) if (twice := Counter(ids)) else []
        often = shared >= MIN_ROWS
        ends = np.cumsum([0, *(int(np.count_nonzero(often[held[k]])) for k in order)])
        flat = np.empty(ends[-1], dtype=np.int32)
        seen = []
        for k, a, b in zip(order, ends, ends[1:]):
            flat[a:b] = held[k][often[held[k]]]
            seen.append((flat[a:b], labels[k]))
        del held
        pa.default_memory_pool().release_unused()
        share = len(seen) / TRAIN_ROWS
        model, deal = Ftrl(L1 * math.sqrt(share)), np.random.default_rng(0)
        for _ in range(math.ceil(EPOCHS / math.sqrt(share)) if seen else 0):
            for k in deal.permutation(len(seen)).tolist():
                model.learn(*seen[k])
        w = model.weights(np.arange(len(model.z)))
        slot = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(w[slot], pa.float64())], names=["slot", "w"])

    learned = sample.mapInArrow(hashed, "id string, slots binary, y int").repartition(1).mapInArrow(train, "slot int, w double").toArrow()
    return learned["slot"].to_numpy(), learned["w"].to_numpy()


class Scorer:
    def __init__(self, slot: np.ndarray, value: np.ndarray):
        self.dense = np.zeros((1 << BITS) + 1, dtype=np.float32)
        self.dense[slot] = value
        self.table = WordHash()

    def __call__(self, text: str) -> float:
        at = features(text, self.table)
        at = distinct(at[self.dense[at] != 0])
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, float(self.dense[at].sum()) + float(self.dense[-1])))))


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1; higher: likelier toxic) of every text; each feature of a text counts once.

    Null and empty texts get the score of the constant term.  Rows come back one for one, repeated or null
    ids too; other columns are left out.  An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        scorer = Scorer(*sent.value)
        for part, texts in slices(batches, "text"):
            out = [scorer(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], names=["id", "score"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of the table whose score is under the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        scorer = Scorer(*sent.value)
        for part, texts in slices(batches, text_col):
            yield part.filter(pa.array([scorer(t) < threshold for t in texts]))

    return docs.mapInArrow(run, docs.schema)


def crc_rest(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo `mod`."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels whose id's crc32 mod 3 is not 1."""
    scored = score(docs, fit(docs, labels, crc_rest("doc_id", 3) != 1))
    return scored.select("doc_id", (crc_rest("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
