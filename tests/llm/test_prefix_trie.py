import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def key(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    both = f"{len(role)}:{role}{len(text)}:{text}"
    return (turn is not None, turn or 0, role, hashlib.sha256(both.encode()).digest())


def brute(rows, every=100, heads=6):
    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - c % every, [])[:h] + said[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    saved, leaves = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own_saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own_saved + sum(saved[k] for k in kids[path])
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
    out = []
    for path, inside in members.items():
        ends = ",".join(str(c) for c in sorted(inside) if len(built[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(inside), len(path), parent, len(inside), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **args):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("conv", "place", "size", "rep", "depth", "label", "block")})
    got = trie.prefix_trie(df, **args)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def odd_rows(seed, n):
    """Few different turns, so that prefixes are shared deeply; nulls, equal turns, repeated rows, missing bases."""
    draw = random.Random(seed)
    rows = []
    for c in draw.sample([*range(1, 400)], n):
        for t in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, draw.choice([None, t, t, t]), draw.choice(["user", "user", None]), draw.choice(["a", "a", "a", "bé😀", "", None])))
    return rows + rows[:5] + [(None, 1, "user", "nobody's"), (100, 0, "user", "base"), (100, 1, "x", "y" * 200_000)]


@pytest.mark.parametrize(("seed", "n"), [(1, 3), (2, 150)])
def test_equals_brute_force(spark, seed, n):
    rows = odd_rows(seed, n)
    assert run(spark, rows) == brute(rows)


def test_long_conversations_in_blocks_and_a_hot_class(spark, monkeypatch):
    """Copies of one long conversation, one that leaves it late, and many equal short ones."""
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "MOST", 4)
    monkeypatch.setattr(trie, "IDS", 3)
    long = [f"t{k}" for k in range(30)]
    said = {1: long, 2: long, 3: [*long[:25], "other", "x"], 4: long[:12], **{c: ["same", "words"] for c in range(10, 60)}, 60: ["same"]}
    rows = [(c, k, "user", t) for c, s in said.items() for k, t in enumerate(s)]
    assert run(spark, rows, heads=1) == brute(rows, heads=1)


def test_one_conversation_and_none(spark):
    for rows in ([(7, 0, "user", "x")], [(0, 0, "user", "x"), (100, 1, "a", "b")], [(None, 0, "user", "x")], []):
        assert run(spark, rows) == brute(rows)


def test_turnless_conversations(spark):
    """A base that is not there leaves conversations shorter than their h without a turn."""
    turnless = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 >= 2]
    rows = [(c, 0, "user", "x") for c in turnless]
    assert run(spark, rows) == brute(rows)
    rows += [(300, 0, "user", "z")]
    assert run(spark, rows) == brute(rows)
