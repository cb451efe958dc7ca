import itertools

import numpy as np
import pytest

from tidewater.llm import ngram_join as N
from tidewater.llm.common import WordHash

WORDS = [f"w{k}" for k in range(400)]


def family(deal, n, copies, edits):
    base = deal.choice(WORDS, n).tolist()
    for _ in range(copies):
        words = list(base)
        for _ in range(int(deal.integers(0, edits + 1))):
            words[int(deal.integers(0, n))] = "x" + str(deal.integers(0, 10**6))
        yield " ".join(words)


@pytest.fixture(scope="module")
def texts():
    deal = np.random.default_rng(5)
    out = ["", None, "  \n", "one", "ONE", "one two", "one two three", "One\tTwo Three", "one two three four", "é é é", "É É É", "the " * 5000, "the " * 9000]
    for n in (5, 12, 30, 60, 120, 400):
        for _ in range(4):
            out += family(deal, n, 8, 1 + n // 40)
    out += family(deal, 100, 60, 4)
    out += [deal.choice(out[13:]) for _ in range(40)]
    passage = " ".join(deal.choice(WORDS, 60))
    out += [" ".join(deal.choice(WORDS, 40)) + " " + passage for _ in range(60)]
    return out


def brute(texts, num, den, width=3):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("num", "den", "block"), [(90, 100, 16), (80, 100, 512)])
def test_equals_brute_force(spark, texts, monkeypatch, num, den, block):
    monkeypatch.setattr(N, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, root string, n int")
    got = sorted(map(tuple, N.ngram_join(docs, num=num, den=den).collect()))
    assert got == brute(texts, num, den)


def test_trie_equals_sets():
    deal = np.random.default_rng(2)
    ratio = N.Ratio(7, 10)
    base = deal.integers(0, 300, 40)
    sets = [np.unique(np.append(deal.choice(base, int(deal.integers(1, 40))), deal.integers(0, 60, int(deal.integers(1, 6))))).astype(np.uint64) for _ in range(300)]
    trie = N.Trie(sets)
    for s in sets:
        want = [k for k, t in enumerate(sets) if 10 * len(np.intersect1d(s, t)) >= 7 * len(np.union1d(s, t))]
        assert sorted(trie.linked(s, ratio).tolist()) == want


@pytest.mark.parametrize("num", [90, 80])
def test_linked_sets_share_a_key(num):
    deal = np.random.default_rng(4)
    ratio, counts = N.Ratio(num, 100), deal.integers(0, 5, 1 << 12).astype(np.uint16)
    for n in [*range(1, 60), 200, 250, 256, 257, 300, 320, 330, 1000, 5000]:
        base = deal.integers(0, 2**63, n).astype(np.uint64)
        for gone in range(0, n // (5 if num == 80 else 10) + 1, max(1, n // 50)):
            for more in range(0, n // (4 if num == 80 else 9) + 1, max(1, n // 30)):
                other = np.append(base[gone:], deal.integers(0, 2**63, more).astype(np.uint64))
                if 100 * (n - gone) >= num * (n + more):
                    assert set(ratio.keys(np.unique(base), counts).tolist()) & set(ratio.keys(np.unique(other), counts).tolist())


@pytest.mark.parametrize("num", [90, 80])
def test_keys_rule_out_no_linked_pair(num):
    """Any two sets, linked ones above all: the keys of one only are no more than the members of one only."""
    deal = np.random.default_rng(8)
    ratio, counts = N.Ratio(num, 100), deal.integers(0, 4, 1 << 10).astype(np.uint16)
    ruled_out = 0
    for _ in range(400):
        n = int(deal.integers(2, 300))
        base = deal.integers(0, 2**63, n).astype(np.uint64)
        gone, more = (int(deal.integers(0, max(2, n // int(deal.choice([1, 2, 12]))))) for _ in range(2))
        a, b = np.unique(base), np.unique(np.append(base[gone:], deal.integers(0, 2**63, more).astype(np.uint64)))
        x, y = ratio.keys(a, counts), ratio.keys(b, counts)
        found = int(N.apart(x, y, np.array([0]), y[-1:], np.array([len(np.intersect1d(x, y))]))[0])
        both = len(np.intersect1d(a, b))
        assert 0 <= found <= len(a) + len(b) - 2 * both
        far = found > ratio.most_apart(len(a) + len(b))
        assert not (far and 100 * both >= num * len(np.union1d(a, b)))
        ruled_out += far
    assert ruled_out > 50


def test_form_letters(spark, monkeypatch):
    """Texts of one form that differ by too much to link, pairs of them that do, and a passage that all hold."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "WIDE", 16)
    deal = np.random.default_rng(9)
    form, passage, out = deal.choice(WORDS, 150).tolist(), " ".join(deal.choice(WORDS, 60)), []
    for k in range(50):
        own = [w if deal.random() > 0.06 else f"v{deal.integers(0, 10**6)}" for w in form]
        out += [" ".join(own), " ".join([*own[:75], f"z{k}", *own[76:]]), " ".join(deal.choice(WORDS, 40)) + " " + passage]
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    assert sorted(map(tuple, N.ngram_join(docs).collect())) == brute(out, 90, 100)


def test_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "p q r s t"), (None, "a b c d"), (2, "A B C D"), (3, "p q r s t")]
    got = N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == [("1", 2), ("1", 2), ("1", 3), ("2", 2), ("3", 3), ("None", 2)]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by == {1: {1}, 2: {1}, 3: {1}, None: {None}}
    assert N.ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert len(N.members_of("x y", 3, WordHash())) == 1


@pytest.mark.parametrize("num", [80, 90])
def test_tallies_keep_linked_sets_and_rule_strangers_out(num):
    """Two sets have no fewer members apart than their tallies differ by, whatever their sizes; strangers that share half differ by more."""
    deal, ratio, ruled, strangers = np.random.default_rng(8), N.Ratio(num, 100), 0, 0
    for n in [1, 3, 40, 63, 65, 129, 500, 520, 4000, 9000] * 6:
        a = np.unique(deal.integers(0, 1 << 62, n).astype(np.uint64))
        for share in (0.5, 0.97):
            b = np.unique(np.concatenate([a[deal.random(len(a)) < share], deal.integers(0, 1 << 62, int(n * (1.05 - share))).astype(np.uint64)]))
            tallies = [np.frombuffer(N.tally(x), dtype=np.uint8) for x in (a, b)]
            x, y = N.folded(tallies[:1], min(map(len, tallies))), N.folded(tallies[1:], min(map(len, tallies)))
            differ = int(np.abs(x - y).sum())
            assert differ <= len(np.setxor1d(a, b))
            if share == 0.5 and n >= 40:
                strangers += 1
                ruled += differ > ratio.most_apart(len(a) + len(b))
    assert ruled >= 0.95 * strangers


def test_texts_move_only_for_stars_that_may_link(spark, monkeypatch):
    """Strangers that share rare shingles: their texts were sent to be compared with the first one of their key."""
    words = [f"v{k}" for k in range(9000)]
    deal, moved = np.random.default_rng(9), []
    rows = [(k, " ".join(deal.choice(words, 150)) + f" rare{k // 10} passage{k // 10} here{k // 10} " + " ".join(deal.choice(words, 150))) for k in range(200)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(20)]
    met = N._met
    monkeypatch.setattr(N, "_met", lambda cells, *rest: (moved.append(cells.count()), met(cells, *rest))[1])
    got = N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % 1000 if k < 1020 and k >= 1000 else k for k, _ in rows}
    assert moved[0] <= 60
