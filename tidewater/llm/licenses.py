"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates of about the same length share a window of 2 * half shingles, where half is the next power of two over their
length and a quarter more; from a text's first shingle on, every half shingles a new one starts.  So an occurrence with up to
a quarter of words inserted always lies whole in one, whatever stands before the text.  The number of bands of each
window size follows from the least Jaccard similarity that a match can have with such a window, so that a match collides
with a chance of at least 1 - MISS.  Templates are few and fixed; they travel with the code, and no rows move.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, distinct, mixed, shingle_hashes, slices
from .toxicity import _APART

WIDTH, CONTAINMENT, MISS = 5, 0.8, 1e-6

# Notices to look for, as published with each license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def shingles(text: str, table: WordHash) -> np.ndarray:
    return shingle_hashes(table.of(text.lower().encode().translate(_APART).split()), WIDTH)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.table = WordHash()
        self.names = list(templates)
        self.sets = [distinct(shingles(templates[n], self.table)) for n in self.names]
        self.halves: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                self.halves.setdefault(1 << (len(s) + len(s) // 4 - 1).bit_length(), []).append(k)
        self.bands = {half: max(self._bands(len(self.sets[k]), half) for k in ks) for half, ks in self.halves.items()}
        self.factors = mixed(np.arange(max(self.bands.values(), default=0), dtype=np.uint64), 21) | np.uint64(1)
        with np.errstate(over="ignore"):
            self.minima = {half: [np.array([(self.sets[k] * self.factors[b]).min() for k in ks]) for b in range(self.bands[half])] for half, ks in self.halves.items()}

    @staticmethod
    def _bands(size: int, half: int) -> int:
        """Bands, of one hash each, for a template: the least similarity of a match in a full window sets them."""
        common = math.ceil(CONTAINMENT * size)
        return math.ceil(math.log(MISS) / math.log(1 - common / (2 * half + size - common)))

    def scan(self, texts: list[str]) -> list[tuple[int, int, int, float]]:
        """(text, template, first shingle, containment) of the best window of each match; overlapping matches of a template are one."""
        parts = [shingles(t, self.table) for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        h = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        if not len(h):
            return []
        found = []
        for half, ks in self.halves.items():
            # blocks of half a window, from each text's first shingle on; a window is a block and the next one of its text
            sizes = np.array([len(p) for p in parts])
            rows = -(-sizes // half)
            text = np.repeat(np.arange(len(parts)), rows)
            start = (ends - sizes)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)) * half
            alone = np.append(text[1:] != text[:-1], True)
            hits = []
            for b in range(self.bands[half]):
                with np.errstate(over="ignore"):
                    block = np.minimum.reduceat(h * self.factors[b], start)
                window = np.where(alone, block, np.minimum(block, np.append(block[1:], block[-1:])))
                least = self.minima[half][b]
                order = np.argsort(least)
                at = np.minimum(np.searchsorted(least[order], window), len(ks) - 1)
                same = np.flatnonzero(least[order][at] == window)
                if len(same):
                    for j in range(len(ks)):
                        hits.append(np.stack([same[window[same] == least[j]], np.full(int((window[same] == least[j]).sum()), j)], 1))
            if not hits:
                continue
            for i, j in np.unique(np.concatenate(hits), axis=0).tolist():
                d = int(text[i])
                lo, hi = int(start[i]), min(int(start[i]) + 2 * half, int(ends[d]))
                inside = np.isin(h[lo:hi], self.sets[ks[j]])
                share = len(distinct(h[lo:hi][inside])) / len(self.sets[ks[j]])
                if share >= CONTAINMENT:
                    found.append((d, ks[j], lo + int(np.argmax(inside)) - (int(ends[d]) - len(parts[d])), share, half))
        found.sort()
        out: list[list] = []
        for d, k, at, share, half in found:
            if out and out[-1][:2] == [d, k] and at < out[-1][4]:
                if share > out[-1][3]:
                    out[-1][2:4] = [at, share]
            else:
                out.append([d, k, at, share, at + half])
        return [tuple(x[:4]) for x in out]


def scan(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, first_word (from 0) and containment of every place where a text holds a template.

    Words are runs of letters and digits, lower-cased; a place matches when its window holds CONTAINMENT of the template's
    distinct five-word shingles or more.  Null and empty texts, and texts without a match, give no rows; rows with repeated or null
    ids each give their own.  An empty table or no templates give an empty table.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(templates)
        for part, texts in slices(batches, "text"):
            got = scanner.scan(texts) if scanner.sets else []
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([scanner.names[g[1]] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.float64())],
                names=["id", "license", "first_word", "containment"],
            )

    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, license string, first_word long, containment double").withColumnRenamed("id", id_col)
