"""The vocabulary of a merge-type (BPE) SentencePiece model, read through the sentencepiece library.

Covers models with the identity normaliser, a dummy prefix, kept white space and byte fallback;
any other model is refused.
"""

from __future__ import annotations

import functools
import re

import numpy as np

SPACE = "▁"


def _fields(data: bytes):
    """(field number, value) of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class PieceVocab:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        top = dict(_fields(sp.serialized_model_proto()))
        trainer, norm = dict(_fields(top[2])), dict(_fields(top[3]))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(1) != b"identity" or norm.get(3, 1) != 1 or norm.get(4, 1) != 0:
            raise ValueError("only BPE models with byte fallback, identity normaliser and kept white space are handled")
        n = sp.vocab_size()
        self.size, self.unk, self.bos, self.eos = n, sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.text[i][3:5], 16)] = i
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in normal):
            raise ValueError("unused pieces are not handled")
        self.ids = {self.text[i]: i for i in normal}
        chars = {c for p in self.ids for c in p}
        if chars - self.ids.keys() or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces must start a word or lie inside it, and be made of known characters")
        # Equal scores share a rank: then the leftmost pair goes first.
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.rank = {i: order[sp.get_score(i)] for i in normal}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = self.rank[i], i
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(f"\\x{c:02x}" for c in range(32) if chr(c) not in joined)  # no merge reaches these
        self.segment = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def segments(self, text: str) -> list[str]:
        """The parts of a text that merges never cross, with the dummy prefix: words with the blanks before them."""
        return self.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def remerged(self, symbols: list[int]) -> list[int]:
        """Merges symbols by rank, leftmost first, by plain search (for short lists)."""
        symbols, pairs = list(symbols), self.pairs
        while len(symbols) > 1:
            best = min(((*pairs[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in pairs), key=lambda x: (x[0], x[2]), default=None)
            if best is None:
                break
            symbols[best[2] : best[2] + 2] = [best[1]]
        return symbols


@functools.lru_cache(maxsize=2)
def vocab(path: str) -> PieceVocab:
    """One vocabulary for each worker process."""
    return PieceVocab(path)
