"""Language-model scores of texts: a causal self-attention model trained in numpy on subword ids, and a unigram base.

A text is its lower-cased words and an end.  Words become subword ids of a given vocabulary; the model predicts the class of
the next id from the ids before it, and the id within its class by its share in training texts.  Training runs where the
data are: in each round every partition takes steps from the same weights on its share of spans and the weights are averaged.
Scoring lays overlapping windows over a text; each id is scored once, by the window in which it has most context.
The attention model's probability is the lower order of discounted counts of the ids that follow one and two ids: frequent counts
are broadcast, all others are joined to the ids that ask for them.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, slices

# Window, stride (new ids in each window after the first), width, classes, and ids with an embedding of their own.
LENGTH, STRIDE, WIDTH, CLASSES, OWN = 16, 8, 16, 192, 1024
# Passes over all training texts, each made in SPANS rounds at least; in each round another share of the runs of SPAN_WORDS words is read.
ROUNDS, SPANS, SPAN_WORDS, BATCH, RATE = 1, 2, 24, 128, 0.01
# Followers of one and of two ids whose counts are broadcast: at most so many of each, the most frequent ones (the others come by joins);
# taken off each count.
FOLLOWERS, DISCOUNT = 1 << 20, 0.75
# Words whose counts are broadcast: at most so many, the most frequent ones.
COMMON = 1 << 17
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_UPPER).split()


class Subwords(dict):
    """Subword ids of words, remembered up to a bound."""

    BOUND = 300_000

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.last = self.sp.vocab_size(), struct.pack("i", self.sp.eos_id())

    def __missing__(self, word: bytes) -> bytes:
        out = self[word] = np.array(self.sp.encode(word.decode()), dtype=np.int32).tobytes()
        return out

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encodes the words of some texts that are new, all at once."""
        new = [w for w in set().union(*texts) if w not in self]
        if len(self) + len(new) > self.BOUND:
            self.clear()
            new = list(set().union(*texts))
        for word, ids in zip(new, self.sp.encode([w.decode() for w in new], num_threads=1)):
            self[word] = struct.pack(f"{len(ids)}i", *ids)

    def ids(self, words: list[bytes], end: bool = True) -> np.ndarray:
        packed = b"".join(map(self.__getitem__, words))
        return np.frombuffer(packed + self.last if end else packed, dtype=np.int32)


@functools.lru_cache(maxsize=1)
def subwords(path: str) -> Subwords:
    """One for each worker process."""
    return Subwords(path)


class Coding:
    """Classes of ids, shares within classes and input symbols, from the ids' counts in training texts."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray):
        """starts: whether an id begins a word."""
        size = len(counts)
        order = np.lexsort((np.arange(size), -counts))
        place = np.empty(size, dtype=np.int64)
        place[order] = np.arange(size)
        alone = CLASSES - 32
        # the most frequent ids are classes by themselves; the others fall into bands of equal logarithmic rank
        band = np.clip((np.log(np.maximum(place, alone) / alone) / np.log(max(2.0, size / alone)) * 16).astype(np.int64), 0, 15)
        self.of = np.where(place < alone, place, alone + 2 * band + starts).astype(np.int32)
        weight = counts + 0.5
        total = np.bincount(self.of, weight, CLASSES)
        self.share = np.log(weight / total[self.of]).astype(np.float32)
        self.bias = np.log((total + 1e-3) / total.sum()).astype(np.float32)
        self.symbol = np.where(place < OWN, place, OWN + self.of).astype(np.int32)
        self.start = OWN + CLASSES  # stands before the first id

    @property
    def symbols(self) -> int:
        return self.start + 1


SHAPES = {"E": (OWN + CLASSES + 1, WIDTH), "P": (LENGTH, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "O": (WIDTH, WIDTH), "A": (WIDTH, 2 * WIDTH), "a": (2 * WIDTH,), "B": (2 * WIDTH, WIDTH), "C": (WIDTH, CLASSES), "c": (CLASSES,)}


def first_weights(coding: Coding) -> dict[str, np.ndarray]:
    deal = np.random.default_rng(0)
    w = {k: (deal.normal(size=s) * (0.3 if k == "E" else 0.1 if k == "P" else 1 / math.sqrt(s[0]) if len(s) > 1 else 0)).astype(np.float32) for k, s in SHAPES.items()}
    w["C"] *= 0.1
    w["c"] = coding.bias.copy()
    return w


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


MASK = np.where(np.tri(LENGTH, dtype=bool), 0, -1e9).astype(np.float32)


def times(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """a @ m as one product of two matrices (not one for each window)."""
    return (a.reshape(-1, a.shape[-1]) @ m).reshape(*a.shape[:-1], m.shape[1])


def hidden(w, x: np.ndarray, since: int = 0) -> tuple:
    """States of windows of symbols (n x LENGTH) from place `since` on, with what the backward pass needs."""
    e = w["E"][x]
    e += w["P"]
    k, v = (times(e, w[n]) for n in "KV")
    own = np.ascontiguousarray(e[:, since:]) if since else e
    q = times(own, w["Q"])
    s = q @ k.transpose(0, 2, 1)
    s *= 1 / math.sqrt(WIDTH)
    s += MASK[since:]
    s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(2, keepdims=True)
    c = s @ v
    h = times(c, w["O"])
    h += own
    u = times(h, w["A"])
    u += w["a"]
    np.maximum(u, 0, out=u)
    g = times(u, w["B"])
    g += h
    return g, (e, q, k, v, s, c, h, u)


@functools.lru_cache(maxsize=4)
def room(rows: int, columns: int, kind: str) -> np.ndarray:
    """Memory that is used again: new memory costs as much as the numbers in it."""
    return np.empty((rows, columns), dtype=kind)


def gradients(w, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over live places, and its slopes.  y: classes to predict."""
    g, (e, q, k, v, s, c, h, u) = hidden(w, x)
    # classes are worked out at live places alone; a last column of ones carries the bias along
    here, n = np.flatnonzero(live.ravel()), max(1, int(live.sum()))
    state = np.ones((len(here), WIDTH + 1), dtype=g.dtype)
    state[:, :WIDTH] = g.reshape(-1, WIDTH)[here]
    d = np.matmul(state, np.vstack([w["C"], w["c"]]), out=room(live.size, CLASSES, state.dtype.char)[: len(here)])
    d -= d.max(1, keepdims=True)
    want = (np.arange(len(here)), y.ravel()[here])
    got = d[want]
    np.exp(d, out=d)
    total = d.sum(1)
    loss = -float((got - np.log(total)).sum()) / n
    d *= (1 / (n * total))[:, None].astype(d.dtype)
    d[want] -= d.dtype.type(1 / n)
    flat2 = lambda a: a.reshape(-1, a.shape[-1])
    slopes = state.T @ d
    out = {"C": slopes[:WIDTH], "c": slopes[WIDTH]}
    dg = np.zeros_like(g)
    flat2(dg)[here] = d @ w["C"].T
    out["B"] = flat2(u).T @ flat2(dg)
    du = times(dg, w["B"].T)
    du *= u > 0
    out["A"], out["a"] = flat2(h).T @ flat2(du), flat2(du).sum(0)
    dh = dg + times(du, w["A"].T)
    out["O"] = flat2(c).T @ flat2(dh)
    dc = times(dh, w["O"].T)
    ds = dc @ v.transpose(0, 2, 1)
    dv = s.transpose(0, 2, 1) @ dc
    ds = s * (ds - (ds * s).sum(2, keepdims=True)) / math.sqrt(WIDTH)
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    de = dh
    for name, slope in (("Q", dq), ("K", dk), ("V", dv)):
        de = de + times(slope, w[name].T)
        out[name] = flat2(e).T @ flat2(slope)
    out["P"] = de.sum(0)
    out["E"] = np.zeros_like(w["E"])
    order = np.argsort(x, axis=None, kind="stable")
    symbols, first = np.unique(x.ravel()[order], return_index=True)
    out["E"][symbols] = np.add.reduceat(flat2(de)[order], first, axis=0)
    return loss, out


class Adam:
    def __init__(self, w):
        self.w, self.t = w, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, slopes) -> None:
        self.t += 1
        for k, g in slopes.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.w[k] -= RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def windows(ids: list[np.ndarray], coding: Coding, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (n x LENGTH), ids to predict, which places count, and the text of each window; every id counts once."""
    sizes = np.array([len(s) for s in ids], dtype=np.int64)
    rows = 1 + np.maximum(0, -(-(sizes - LENGTH) // stride))
    ends, room = np.cumsum(rows), (rows - 1) * stride + LENGTH  # of each text, with places to fill its last window
    starts = np.cumsum(room) - room
    flat_ids = np.concatenate(ids)
    at = np.arange(len(flat_ids)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    targets = np.full(int(room.sum()), -1, dtype=np.int32)
    targets[at] = flat_ids
    inputs = np.zeros(len(targets) + 1, dtype=np.int32)
    inputs[at + 1] = coding.symbol[flat_ids]
    inputs[(starts + sizes)[sizes > 0]] = 0  # a last id stands before none
    inputs[starts] = coding.start
    who = np.repeat(np.arange(len(ids)), rows)
    turn = np.arange(len(who)) - (ends - rows)[who]
    places = (starts[who] + turn * stride)[:, None] + np.arange(LENGTH)
    y = targets[places]
    live = (y >= 0) & (np.arange(LENGTH) >= np.where(turn > 0, LENGTH - stride, 0)[:, None])
    return inputs[places], np.maximum(y, 0), live, who


class Table:
    """Rows of numbers by key, in slots: a key has one of PROBES slots, and where they are taken the more frequent keys have them."""

    BITS, PROBES = 21, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.bits = self.BITS
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        left = keys[np.lexsort((-keys, n))]
        for probe in self.PROBES:
            at = self.slot(left, probe)
            free = self.keys[at] < 0
            self.keys[at[free]] = left[free]
            left = left[self.keys[at] != left]
        self.held = self.place(keys)[1]

    def slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(probe) >> np.uint64(64 - self.bits)).astype(np.int64)

    def column(self, keys: np.ndarray, x: np.ndarray, other: float) -> np.ndarray:
        out = np.full(1 << self.bits, other, dtype=np.float32)
        out[self.place(keys[self.held])[0]] = x[self.held]
        return out

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.slot(keys, self.PROBES[0])
        there = self.keys[at] == keys
        for probe in self.PROBES[1:]:
            miss = np.flatnonzero(~there)
            if not len(miss):
                break
            at[miss] = self.slot(keys[miss], probe)
            there[miss] = self.keys[at[miss]] == keys[miss]
        return at, there


def triples(ids: list[np.ndarray], size: int) -> np.ndarray:
    """A key for each id of the sequences and the two before it; `size` stands before the first one."""
    lead = np.full(2, size, dtype=np.int64)
    x = np.concatenate([y for s in ids for y in (lead, s)])
    key = (x[:-2] * (size + 1) + x[1:-1]) * (size + 1) + x[2:]
    return key[x[2:] != size]


class Followers:
    """Discounted shares of the ids that follow one id and two ids; what they leave goes to the next lower order, so that the
    probabilities of all ids after a context sum to 1.

    The counts given are all there are, unless `left` tells what all followers of each id, and of each given pair, leave, and
    `kinds` how many pairs and triples there are: then places whose counts are not at hand are open, see looked_up().
    """

    def __init__(self, counts: np.ndarray, texts: int, pairs: tuple[np.ndarray, np.ndarray], threes: tuple[np.ndarray, np.ndarray], left: tuple[np.ndarray, np.ndarray] | None = None, kinds: tuple[int, int] = (0, 0)):
        self.size = size = len(counts)
        keys, n = pairs
        self.two, total = Table(keys, n), np.append(counts, texts)
        share = np.where(self.two.held, (n - DISCOUNT) / np.maximum(total[keys // (size + 1)], 1), 0)
        self.share2 = self.two.column(keys, share, 0)
        # how often two ids stand before a third: as often as they follow each other, since only the end has no follower
        self.times2 = self.two.column(keys, n, 1)
        order = np.argsort(keys)
        key3, n3 = threes
        before = key3 // (size + 1)
        at = np.minimum(np.searchsorted(keys[order], before), max(0, len(keys) - 1))
        known = (keys[order][at] == before) & self.two.held[order][at] if len(keys) else np.zeros(len(key3), dtype=bool)
        if left is not None:  # a triple counts as at hand only with the pair before it
            key3, n3, at, known = key3[known], n3[known], at[known], known[known]
        self.three = Table(key3, n3)
        share3 = np.where(self.three.held & known, (n3 - DISCOUNT) / np.maximum(n[order][at], 1) if len(keys) else 0.0, 0)
        self.share3 = self.three.column(key3, share3, 0)
        if left is None:
            self.left1 = (1 - np.bincount(keys // (size + 1), share, size + 1)).astype(np.float32)
            self.left2 = self.two.column(keys, 1 - np.bincount(order[at[known]], share3[known], len(keys)), 1) if len(keys) else np.ones_like(self.share2)
            self.whole2 = self.whole3 = True
        else:
            self.left1, self.left2 = left[0].astype(np.float32), self.two.column(keys, left[1], 1)
            self.whole2, self.whole3 = (int(t.held.sum()) == k for t, k in zip((self.two, self.three), kinds))

    def looked_up(self, ids: list[np.ndarray], low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all ids of some sequences, from their probabilities of the lower order: the probability by the counts at hand, the key
        of triples(), whether the triple's count is open (not at hand, and not known to be none), and by how much a count less DISCOUNT is
        to be divided to give what it adds to the probability, as a share of it; not a number where pairs are not at hand either."""
        base = self.size + 1
        key = triples(ids, self.size)
        last = key // base % base
        at, there = self.two.place(key % (base * base))
        out = self.left1[last] * low
        out += self.share2[at] * there
        at, before = self.two.place(key // base)
        out *= np.where(before, self.left2[at], 1)
        parts = out * self.times2[at]
        at, there3 = self.three.place(key)
        out += self.share3[at] * there3
        # the first id of a sequence has no pair before it, and no triple
        begins = last == self.size
        lost = (~there | (~before & ~begins)) & (not self.whole2)
        more = ~there3 & ~begins & (before | (not self.whole2)) & (not self.whole3)
        parts[lost] = np.nan
        return out, key, lost | more, parts

    def mixed(self, ids: list[np.ndarray], low: np.ndarray) -> np.ndarray:
        """Probabilities of all ids of some sequences, from those of the lower order and the counts at hand."""
        return self.looked_up(ids, low)[0]


def scored(ids: list[np.ndarray], w, coding: Coding, chunk: int = 256) -> list[np.ndarray]:
    """Natural log probability of each id of each sequence by the attention model."""
    x, y, live, who = windows(ids, coding)
    rank = np.cumsum(live.ravel()).reshape(live.shape) - 1  # windows stand in order and score each id once: the order of the ids
    out = np.empty(sum(map(len, ids)), dtype=np.float32)
    head = np.diff(who, prepend=-1) > 0
    # a last column of ones carries the bias along
    out_of, ones = np.vstack([w["C"], w["c"]]), np.ones(CLASSES, dtype=np.float32)
    state, held = np.ones((chunk * LENGTH, WIDTH + 1), dtype=np.float32), room(chunk * LENGTH, CLASSES, "f")
    # only a text's first window scores its first places
    for skip, rows in ((0, np.flatnonzero(head)), (LENGTH - STRIDE, np.flatnonzero(~head))):
        for k in range(0, len(rows), chunk):
            here = rows[k : k + chunk]
            mark, want = live[here, skip:], y[here, skip:]
            g, _ = hidden(w, x[here], skip)
            g, want = g[mark], want[mark]  # texts end within windows
            state[: len(g), :WIDTH] = g
            z = np.matmul(state[: len(g)], out_of, out=held[: len(g)])
            if not np.abs(g).max(initial=0) < 1e3:  # far from anything that training gives
                np.clip(z, -60, 60, out=z)
            got = z[np.arange(len(want)), coding.of[want]]
            got -= np.log(np.exp(z, out=z) @ ones)
            got += coding.share[want]
            out[rank[here, skip:][mark]] = got
    return np.split(out, np.cumsum([len(s) for s in ids])[:-1])


def frequent(counts: DataFrame, bound: int) -> pa.Table:
    """The most frequent rows, `bound` at most: all with a count n over the least one that keeps within the bound."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count("*").alias("kinds"), F.min("n").alias("n")).orderBy(F.desc("k")).collect()
    least, sofar = None, 0
    for r in steps:
        sofar += r["kinds"]
        if sofar > bound:
            break
        least = r["n"]
    return counts.where(F.lit(False) if least is None else F.col("n") >= least).toArrow()


def turns(runs: int, words: int, turn: int, rounds: int) -> range:
    """Which of the runs of words of a text are read in round `turn`; `rounds` rounds in a row give each run once."""
    return range((turn + words) % rounds, runs, rounds)


def spans(words: list[bytes], turn: int, rounds: int) -> list[tuple[int, int]]:
    """Begin and end of the runs of SPAN_WORDS words that a text gives in round `turn`."""
    runs = max(1, -(-len(words) // SPAN_WORDS))
    return [(k * SPAN_WORDS, min((k + 1) * SPAN_WORDS, len(words))) for k in turns(runs, len(words), turn, rounds)]


def id_slices(batches, columns: list[str], most: int = 1 << 18):
    """Batches of encode() cut so that each holds about `most` ids (or one long text), with the numbers in each binary column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        held = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        cut = np.cumsum(np.asarray(pc.binary_length(held[0]))) // (most * IDS.itemsize)
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a), *([np.frombuffer(x, dtype=IDS).astype(np.int32) for x in h.slice(a, b - a).to_pylist()] for h in held)


# How ids, and the numbers of ids in runs of words, are written.
IDS = np.dtype("<u2")


def encode(docs: DataFrame, model_path: str, logs: Broadcast) -> DataFrame:
    """Each row of docs (id, row, learn, text) with its ids, the ids in each run of SPAN_WORDS words (a run of more than IDS holds is cut), and what its
    words give by `logs`, log10 shares of the words at hand: n_tokens, n_known, base and the other words with their times.

    Texts are encoded here alone; counts, training and scores read the ids.
    """

    def run(batches):
        sub, logs_of = subwords(model_path), logs.value
        if sub.size > 1 << 8 * IDS.itemsize:
            raise ValueError("a vocabulary of more ids than two bytes tell apart")
        for part, texts in slices(batches, "text"):
            n_tokens, n_known, base, rest, ids, runs = [], [], [], [], [], []
            split = [words_of(t) for t in texts]
            sub.learn(split)
            for words in split:
                found = [x for x in map(logs_of.get, words) if x is not None]
                seldom: dict[bytes, int] = {}
                if len(found) < len(words):
                    for x in words:
                        if x not in logs_of:
                            seldom[x] = seldom.get(x, 0) + 1
                if b"" in logs_of:
                    found.append(logs_of[b""])
                else:
                    seldom[b""] = 1
                n_tokens.append(len(words) + 1)
                n_known.append(len(found))
                base.append(math.fsum(found))
                rest.append(list(seldom.items()))
                got = sub.ids(words)
                sizes = np.fromiter(map(len, map(sub.__getitem__, words)), dtype=np.int64, count=len(words)) // got.itemsize
                sizes = np.add.reduceat(sizes, np.arange(0, len(words), SPAN_WORDS)) if words else np.zeros(1, dtype=np.int64)
                sizes[-1] += 1  # the end
                most = np.iinfo(IDS).max
                if sizes.max() > most:
                    sizes = np.array([min(most, int(n) - k) for n in sizes for k in range(0, max(1, int(n)), most)])
                ids.append(got.astype(IDS).tobytes())
                runs.append(sizes.astype(IDS).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in ("id", "row", "learn")), *(pa.array(x) for x in (n_tokens, n_known, base)), pa.array(rest, pa.map_(pa.binary(), pa.int64())), pa.array(ids, pa.binary()), pa.array(runs, pa.binary())],
                names=["id", "row", "learn", "n_tokens", "n_known", "base", "rest", "ids", "runs"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return settle(docs.mapInArrow(run, f"id {kind}, row long, learn boolean, n_tokens long, n_known long, base double, rest map<binary, bigint>, ids binary, runs binary"))


def train(docs: DataFrame, model_path: str, text_col: str = "text") -> tuple[Coding, dict[str, np.ndarray], Followers]:
    """Encodes the given texts and learns from all of them."""
    rows = docs.select(F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("row"), F.lit(True).alias("learn"), F.col(text_col).alias("text"))
    return fit(encode(rows, model_path, docs.sparkSession.sparkContext.broadcast({})), model_path)[:3]


def fit(known: DataFrame, model_path: str) -> tuple[Coding, dict[str, np.ndarray], Followers, tuple[DataFrame, DataFrame, DataFrame]]:
    """Counts every subword id of texts by encode() with the two before it, then trains on spans of all of them.  Comes with all counts:
    of triples (key, n), of pairs (key, n, left) and by the first id of a pair (last, total, left)."""
    sub = subwords(model_path)
    size, base = sub.size, sub.size + 1

    def count(batches):
        held = False
        for _, ids in id_slices(batches, ["ids"], 1 << 20):
            keys, n = np.unique(triples(ids, size), return_counts=True)
            held = True
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], names=["key", "n"])
        # key -1 counts the partitions that hold texts
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([int(held)], pa.int64())], names=["key", "n"])

    found = settle(known.select("ids").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    counts, parts = np.zeros(size), 0
    for r in found.groupBy(F.when(F.col("key") >= 0, F.col("key") % base).otherwise(-1).alias("id")).agg(F.sum("n").alias("n")).collect():  # at most one row for each id of the vocabulary
        if r["id"] < 0:
            parts = r["n"]
        else:
            counts[r["id"]] = r["n"]
    threes = found.where("key >= 0")
    after = threes.groupBy(F.expr(f"key DIV {base}").alias("key")).agg(F.count("*").alias("kinds"))
    twos = threes.groupBy((F.col("key") % (base * base)).alias("key")).agg(F.sum("n").alias("n")).join(after, "key", "left")
    twos = settle(twos.select("key", "n", F.coalesce(F.lit(DISCOUNT) * F.col("kinds") / F.col("n"), F.lit(1.0)).alias("left")))
    ones = settle(twos.groupBy(F.expr(f"key DIV {base}").alias("last")).agg(F.sum("n").alias("total"), (F.lit(DISCOUNT) * F.count("*") / F.sum("n")).alias("left")))
    left1 = np.ones(base)
    for r in ones.collect():  # at most one row for each id of the vocabulary
        left1[r["last"]] = r["left"]
    pairs, triple = frequent(twos, FOLLOWERS), frequent(threes, FOLLOWERS)
    at_hand = [tuple(t[c].to_numpy() for c in ("key", "n")) for t in (pairs, triple)]
    # the first id of a text has no pair before it, and its triple is not asked for
    kinds = (twos.count(), threes.where(f"key DIV {base} <> {size * base + size}").count())
    followers = Followers(counts, int(counts[sub.sp.eos_id()]), *at_hand, left=(left1, pairs["left"].to_numpy()), kinds=kinds)
    coding = Coding(counts, np.array([sub.sp.id_to_piece(i).startswith("▁") for i in range(size)], dtype=np.int64))
    weights = first_weights(coding)
    context = known.sparkSession.sparkContext
    # averaged more often the more partitions take steps apart from each other
    rounds = SPANS * max(1, math.ceil(math.log2(max(1, parts)) / 4))
    for turn in range(ROUNDS * rounds):
        sent = context.broadcast((coding, flat(weights)))

        def learn(batches, sent=sent, turn=turn):
            coding, start = sent.value
            adam = Adam(shaped(start.copy()))
            queue, seen = [], 0

            def take(ids):
                nonlocal seen
                x, y, live, _ = windows(ids, coding, LENGTH)
                for k in range(0, len(x), BATCH):
                    _, slopes = gradients(adam.w, x[k : k + BATCH], coding.of[y[k : k + BATCH]], live[k : k + BATCH])
                    adam.step(slopes)
                seen += int(live.sum())

            for part, texts, runs in id_slices(batches, ["ids", "runs"]):
                for ids, sizes, words in zip(texts, runs, part.column(part.schema.get_field_index("n_tokens")).to_pylist()):
                    ends = np.cumsum(sizes)
                    for k in turns(len(sizes), words - 1, turn, rounds):
                        if sizes[k]:
                            queue.append(ids[ends[k] - sizes[k] : ends[k]])
                        if len(queue) >= 4 * BATCH:
                            take(queue)
                            queue = []
            if queue:
                take(queue)
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([flat(adam.w).tolist()], pa.list_(pa.float32()))], names=["n", "w"])

        learned = known.select("ids", "runs", "n_tokens").mapInArrow(learn, "n double, w array<float>").where("n > 0").select("n", F.posexplode("w").alias("at", "x")).groupBy("at").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x")).orderBy("at").toArrow()
        if learned.num_rows:
            weights = shaped(learned["x"].to_numpy())
    return coding, weights, followers, (threes, twos, ones)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n over all texts; the end of a text is the empty word."""

    def count(batches):
        from collections import Counter

        for _, texts in slices(batches, "text"):
            found: Counter = Counter()
            for t in texts:
                found.update(words_of(t))
            found[b""] += len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lm_scores(docs: DataFrame, model_path: str, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score and attention_score of every text, learned from the rows where `learn` holds.

    Tokens are words, cut at ASCII white space and lower-cased (A-Z), and one end.  base_score sums log10 of smoothed unigram
    shares, score is the log10 probability of the text's subwords by the attention model under discounted counts of followers,
    attention_score that of the attention model alone.  Null and empty texts are the end
    alone.  Rows come back one for one, repeated and null ids too; other columns are left out.  Nothing
    to learn from: counts are 0.  An empty table gives an empty table.
    """
    context = docs.sparkSession.sparkContext
    counts = settle(word_counts(docs.where(learn), text_col))
    total, kinds = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    common = frequent(counts, COMMON)
    down = total + 0.5 * (kinds + 1)
    logs = context.broadcast({k: math.log10((n + 0.5) / down) for k, n in zip(common["word"].to_pylist(), common["n"].to_pylist())})
    picked = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    first = encode(picked, model_path, logs)
    coding, weights, followers, every = fit(first.where("learn"), model_path)
    sent = context.broadcast((coding, flat(weights), followers))

    def run(batches):
        coding, start, followers = sent.value
        w = shaped(start)
        for part, ids in id_slices(batches, ["ids"]):
            rows = part.column(part.schema.get_field_index("row")).to_numpy()
            ln = np.concatenate(scored(ids, w, coding)).astype(float)
            who = np.repeat(np.arange(len(ids)), [len(s) for s in ids])
            low = np.exp(ln)
            p, key, later, parts = followers.looked_up(ids, low)
            lost = later & np.isnan(parts)
            score = np.bincount(who, np.where(lost, 0, np.log10(np.maximum(p, 1e-300))), len(ids))
            alone, at = np.bincount(who, ln, len(ids)) / math.log(10), np.flatnonzero(later)
            real = lambda x: pa.array(x[at].astype(np.float32), from_pandas=True)
            names = ["row", "score", "attention_score", "key", "low", "parts"]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(score), pa.array(alone), pa.array(-1 - rows), *(pa.nulls(len(ids), pa.float32()) for _ in range(2))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(rows[who[at]]), *(pa.nulls(len(at), pa.float64()) for _ in range(2)), pa.array(key[at]), real(np.where(lost, low, np.nan)), real(parts)], names=names)

    # a row for each text, its key below 0, and one for each id whose counts are not at hand
    scores = whole(first.select("row", "ids").mapInArrow(run, "row long, score double, attention_score double, key long, low float, parts float"), followers, every)
    seldom = first.select("row", F.explode("rest").alias("word", "times")).join(counts, "word", "left")
    more = seldom.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(down)))).alias("rest_score"))
    return first.drop("rest", "ids", "runs", "learn").join(scores, "row").join(more, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest_score", F.lit(0.0))).alias("base_score"), "score", "attention_score"
    )


def whole(scores: DataFrame, followers: Followers, every: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """row, score and attention_score of each text, from rows with a text's scores by the counts at hand (key below 0) and rows of ids that
    looked_up() leaves open, by all counts of fit()."""
    threes, twos, ones = every
    base = followers.size + 1
    if followers.whole2 and followers.whole3:
        return scores.select("row", "score", "attention_score")
    rows = scores.select("row", "key", "parts", "score", "attention_score")
    if not followers.whole2:
        # ids that miss a pair: the lower orders come by joins too, and the score of their texts does not hold them yet
        scores = settle(scores)
        far = scores.where("low IS NOT NULL").select("row", "key", "low", F.expr(f"key DIV {base}").alias("before"), F.expr(f"key % {base * base}").alias("pair"), F.expr(f"key DIV {base} % {base}").alias("last"))
        far = far.join(F.broadcast(ones.select("last", "total", F.col("left").alias("left1"))), "last", "left")
        far = far.join(twos.select(F.col("key").alias("pair"), F.col("n").alias("n2")), "pair", "left").join(twos.select(F.col("key").alias("before"), F.col("n").alias("times"), "left"), "before", "left")
        below = F.coalesce("left", F.lit(1.0)) * (F.coalesce("left1", F.lit(1.0)) * F.col("low") + F.coalesce((F.col("n2") - DISCOUNT) / F.col("total"), F.lit(0.0)))
        far = far.select("row", "key", (below * F.col("times")).cast("float").alias("parts"), F.log10(F.greatest(below, F.lit(1e-300))).alias("score"), F.lit(0.0).alias("attention_score"))
        rows = scores.where("low IS NULL").select(*far.columns).union(far)
    # a pair that never stands before an id adds no triple (parts is null)
    adds = F.log10(1 + (F.col("n") - DISCOUNT) / F.col("parts"))
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce(adds, F.lit(0.0))
    return rows.join(threes, "key", "left").groupBy("row").agg(F.sum(score).alias("score"), F.sum(F.coalesce("attention_score", F.lit(0.0))).alias("attention_score"))
