"""Exact encoding by backtracking, and decoding, with a merge-type SentencePiece model.

One Aho-Corasick pass over a pre-token lists the pieces that start at each position, longest first.  The
encoder takes the longest one that fits the piece before it, and steps back where none does.  Two pieces fit
if merging the characters of both again gives just these two; a sequence whose neighbours all fit is
what the merges give for the whole, so the first complete one is the answer.  Positions from which nothing
led to the end are marked in a bit field: a prefix has one encoding only, so they never need another try.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import SPACE, PieceVocab, vocab


class Codec(dict):
    """Encodes and decodes; as a dict it remembers the packed ids of pre-tokens, up to a bound."""

    BOUND, PAIRS = 400_000, 800_000

    def __init__(self, v: PieceVocab):
        import ahocorasick

        self.v, self.fits = v, {}
        self.chars = {p: [v.ids[c] for c in p] for p in v.ids}
        # a piece that its own merges miss never comes out
        self.whole = {p: i for p, i in v.ids.items() if v.remerged(self.chars[p]) == [i]}
        self.single = {p: (0, i) for p, i in self.whole.items() if len(p) == 1}
        self.known = set(self.single)
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.whole.items():
            if len(piece) > 1:
                self.matcher.add_word(piece, (len(piece) - 1, i))
        self.matcher.make_automaton()
        # bytes of each id when decoded; control ids give none
        self.raw = [b""] * v.size
        for piece, i in v.ids.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(v.byte_ids.tolist()):
            self.raw[i] = bytes([b])
        self.raw[v.unk] = " ⁇ ".encode()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.BOUND:
            self.clear()
        ids = self.encoded(word)
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces again gives just these two."""
        if (a, b) in self.v.pairs:
            known = False  # were both made, they would merge
        else:
            text = self.v.text
            known = self.v.remerged(self.chars[text[a]] + self.chars[text[b]]) == [a, b]
        if len(self.fits) >= self.PAIRS:
            self.fits.clear()
        self.fits[a << 16 | b] = known
        return known

    def encoded(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        if self.known.issuperset(word):
            return self._run(word)
        ids, out, run = self.v.ids, [], ""
        for c in word:
            if c in ids:
                run += c
            else:
                out += self._run(run) if run else []
                out += self.v.byte_ids[list(c.encode())].tolist()
                run = ""
        return out + self._run(run) if run else out

    def _run(self, s: str) -> list[int]:
        whole = self.whole.get(s)
        if whole is not None:
            return [whole]
        n, fits, single = len(s), self.fits, self.single
        starts = [[single[c]] for c in s]
        for end, found in self.matcher.iter(s):
            starts[end - found[0]].append(found)  # shorter ones first
        failed = bytearray(n // 8 + 1)
        path: list[int] = []  # ids
        left: list[int] = []  # how many matches are still to be tried at each step's start
        at, last, here = 0, -1, starts[0]
        k = len(here)
        while True:
            while k:
                k -= 1
                before, i = here[k]
                to = at + before + 1
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                if last >= 0:
                    good = fits.get(last << 16 | i)
                    if not (self.fit(last, i) if good is None else good):
                        continue
                path.append(i)
                if to == n:
                    return path
                left.append(k)
                at, last, here = to, i, starts[to]
                k = len(here)
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(self.v.text[path.pop()])
                k, here, last = left.pop(), starts[at], path[-1] if path else -1

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers, with begin and end ids if `ends`."""
        body = b"".join(map(self.__getitem__, self.v.segments(text)))
        return np.array([self.v.bos], "<u4").tobytes() + body + np.array([self.v.eos], "<u4").tobytes() if ends else body

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; the dummy prefix goes, and bytes that are no UTF-8 become U+FFFD one by one."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """One codec for each worker process, with what it remembers."""
    return Codec(vocab(path))


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """id, ids_le (packed ids) and decoded (the text that these ids give) of every text.

    A null text counts as empty; an empty text has the begin and end ids only (none without `ends`) and
    decodes to ''.  Rows come back one for one: repeated ids and texts stay, null ids stay null, other columns
    are left out.  An empty table gives an empty table.
    """

    def run(batches):
        codec = codec_of(model_path)
        for part, texts in slices(batches, "text"):
            packed = [codec.encode(t, ends) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array([codec.decode(p) for p in packed], pa.string())], names=["id", "ids_le", "decoded"])

    picked = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, ids_le binary, decoded string").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and SHA-256 digests of the outputs of encode_decode()."""
    return coded.select(
        id_col,
        F.expr("octet_length(ids_le) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
