import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.packing import encoder, pack, segments, shortest_pack_first

ARGS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
ODD = [
    "hello world", "  two  spaces ", "a\nb\t c\r\n", "", None, "<|endoftext|>x<|endoftext|> <|endoftext", "é日本語😀\x00", " ", "'S don't 's",
    "the" * 700, "=-" * 500, "日本" * 300, "naïve façade " * 5000, "a" * 30_000, "\n" * 50, "word " * 90_000 + "x", "hello world", " " * 1_200_000 + "é",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(ARGS[0])


def want_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def random_histogram(seed, items, size=1024):
    draw = random.Random(seed)
    return Counter(draw.randrange(1, size) for _ in range(items))


CASES = [random_histogram(1, n) for n in (1, 5, 300, 20_000)] + [{600: 10**7}, {1: 10**7}, {1023: 10**6}, {1000: 5 * 10**6, 900: 10**5}, {k: 10**8 // k for k in range(1, 1024)}, {}]


@pytest.mark.parametrize("histogram", CASES)
def test_every_item_is_covered_once_with_little_padding(histogram):
    patterns = shortest_pack_first(histogram, 1024)
    for count, pieces in patterns:
        assert count > 0 and 0 < sum(p[3] for p in pieces) <= 1024
    covered = Counter()
    for whole, low, high, pieces in segments(patterns):
        covered[whole] += high - low
        assert [s for s, *_ in pieces] == list(np.cumsum([0, *(n for _, n, *_ in pieces)])[:-1]) and sum(n for _, n, *_ in pieces) == whole
    assert covered == Counter(histogram)
    # no more sequences than the tokens need, so less than one sequence of padding in all
    assert sum(c for c, _ in patterns) == -(-sum(k * v for k, v in histogram.items()) // 1024)
    assert len(patterns) <= 4 * 1024


def test_patterns_follow_lengths_not_items():
    few, many = ({k: v * n for k, v in random_histogram(2, 5000).items()} for n in (1, 100_000))
    assert len(shortest_pack_first(many, 1024)) < 2 * len(shortest_pack_first(few, 1024))


def test_shortest_pack_takes_the_longest_length():
    # 700 and 600 open a pattern each, 300 goes to the shorter one
    assert sorted(shortest_pack_first({700: 1, 600: 1, 300: 1, 424: 1}, 1024)) == [(1, [(600, 0, 0, 600), (424, 0, 0, 424)]), (1, [(700, 0, 0, 700), (300, 0, 0, 300)])]


def test_ids_equal_the_library(library):
    enc = encoder(*ARGS)
    for t in ODD:
        assert enc.ids(t or "").tolist() == want_ids(library, t)


def test_code_points_encode_alike(library):
    """The two libraries split texts by regular expressions of their own: every 16th code point between letters, digits and blanks."""
    enc = encoder(*ARGS)
    points = [c for c in range(0, 0x30000, 16) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 400):
        text = "".join(f"a{chr(c)}b1{chr(c)}2 {chr(c)}. {chr(c)}{chr(c)} x  {chr(c)}\n" for c in points[k : k + 400])
        assert enc.ids(text).tolist() == want_ids(library, text)


def verify(got, rows, library, size):
    """Brute force: pieces give every document's ids back, and sequences have no gaps."""
    docs, sequences = defaultdict(Counter), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        docs[i][tuple(want_ids(library, t))] += 1
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= -(-sum(len(i) * n for d in docs.values() for i, n in d.items()) // size)
    for i, d in docs.items():
        mine = [r for r in got if r.doc_id == i]
        assert sum(r.length for r in mine) == sum(len(x) * n for x, n in d.items())
        if sum(d.values()) == 1:
            (ids,) = d
            mine.sort(key=lambda r: r.start)
            assert [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1])
            for r in mine:
                raw = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
                assert (bytes(r.ids), r.doc_tokens) == (raw, len(ids)) and r.crc == zlib.crc32(raw)


@pytest.mark.parametrize("size", [1024, 16])
def test_packs_odd_texts(spark, library, size):
    draw = random.Random(3)
    rows = [*enumerate(ODD[:-1]), (None, "x y"), (None, None), (0, "again"), *((100 + k, "word " * draw.randrange(0, 900)) for k in range(120)), *((1000 + k, "") for k in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("id", "part", "rest", "rank", "ids", "n", "pieces", "place", "full0")})
    got = pack(df, ARGS, size=size).withColumn("crc", F.crc32("ids")).collect()
    verify(got, rows, library, size)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), ARGS).collect() == []
