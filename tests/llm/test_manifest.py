import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.llm.manifest import manifest
from tidewater.llm.toxicity import crc_rest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def steps(levels, i):
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        yield run[: i % 8], run[i % 8 + 1 :]
        i //= 8


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        groups[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, h(*map(enc, r))))
    trees = [tree([h(*map(enc, r)) for r in groups[x]]) for x in langs]
    top = tree([t[-1][0] for t in trees]) if langs else None
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            way, leaf = [*steps(trees[k], i), *steps(top, k)], trees[k][0][i]
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = h(*map(enc, (*r[:4], r[4] and r[4].translate(LOW))))
            for a, b in way:
                now = h(*a, now, *b)
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], h(*("".join(a + b) for a, b in way)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def run(df):
    got = manifest(df, COLUMNS, tampered=crc_rest("doc_id", 3) == 0)
    assert got.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.drop("lang").collect()), key=repr)


def odd_rows(n):
    draw = random.Random(5)
    ids = [None, *range(40)]
    return [(draw.choice(ids), draw.choice([None, "s", ""]), draw.choice([None, "", "en", "é"]), draw.choice([None, 3]), draw.choice([None, "", "A b", "ÀB" * 9])) for _ in range(n)] + [(1, "s", "alone", 1, "T" * 300_000)]


# clashing names: the columns that the operator makes for itself
CLASHES = ["node", "grp", "hash", "place", "size", "key", "path", "leaf", "__at"]


@pytest.mark.parametrize("n", [0, 7, 8, 9, 700])
def test_equals_brute_force_on_nulls_ties_repeats_and_long_texts(spark, n):
    rows = odd_rows(n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in CLASHES})
    assert run(df) == brute(rows)


def test_many_equal_rows_in_one_group(spark):
    rows = [(5, "s", "en", 1, "copy")] * 600 + [(i, "s", "en", 1, f"Text {i}") for i in range(100)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
