import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidewater.llm import attention_lm as A
from tidewater.llm.toxicity import crc_rest

PATH = public_tokenizers.path("piece_bpe_32k.model")


def coding():
    deal = np.random.default_rng(0)
    return A.Coding(deal.integers(0, 1000, 32000) // np.arange(1, 32001), deal.integers(0, 2, 32000))


def test_gradients_are_slopes():
    deal = np.random.default_rng(1)
    w = {k: deal.normal(size=s) * 0.3 for k, s in A.SHAPES.items()}
    x, y = deal.integers(0, 50, (3, A.LENGTH)), deal.integers(0, A.CLASSES, (3, A.LENGTH))
    live = deal.integers(0, 2, (3, A.LENGTH))
    _, slopes = A.gradients(w, x, y, live)
    for name in w:
        for _ in range(6):
            at = tuple(deal.integers(0, n) for n in w[name].shape) if name != "E" else (int(deal.choice(x.ravel())), int(deal.integers(0, A.WIDTH)))
            was = w[name][at]
            w[name][at] = was + 1e-5
            up, _ = A.gradients(w, x, y, live)
            w[name][at] = was - 1e-5
            down, _ = A.gradients(w, x, y, live)
            w[name][at] = was
            assert slopes[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_windows_score_each_id_once_and_sum_to_one():
    code = coding()
    w = A.first_weights(code)
    ids = [np.arange(n, dtype=np.int32) for n in (1, 2, A.LENGTH, A.LENGTH + 1, 100, 1001)]
    x, y, live, who = A.windows(ids, code)
    assert [sorted(y[who == k][live[who == k]].tolist()) for k in range(len(ids))] == [s.tolist() for s in ids]
    # probabilities of all possible single ids sum to 1
    every = A.scored([np.array([k], dtype=np.int32) for k in range(32000)], w, code)
    assert np.exp(np.concatenate(every)).sum() == pytest.approx(1, rel=1e-3)
    # the future does not matter
    a, b = np.array([5, 6, 7, 8], dtype=np.int32), np.array([5, 6, 7], dtype=np.int32)
    g, _ = A.hidden(w, A.windows([a, b], code)[0])
    assert np.allclose(g[0, :3], g[1, :3], atol=1e-6)


@pytest.fixture(scope="module")
def docs(spark):
    deal = np.random.default_rng(2)
    words = ["the", "tide", "rises", "over", "harbour", "walls", "and", "boats", "Drift", "é"]
    rows = []
    for i in range(200):
        out, at = [], int(deal.integers(0, 10))
        for _ in range(int(deal.integers(5, 80))):
            at = (at + 1) % 10 if deal.random() < 0.9 else int(deal.integers(0, 10))
            out.append(words[at])
        rows.append((i, " ".join(out), "x", 1))
    return [*rows, (300, None, "x", 1), (301, "", "x", 1), (302, "rare" * 3000, "x", 1), (303, "the " * 30000, "x", 1), (7, "the tide", "x", 1), (None, "the\x0btide\x1crises", "x", 1)]


@pytest.mark.parametrize("common", [A.COMMON, 4])
def test_base_scores_and_learning(spark, docs, monkeypatch, common):
    monkeypatch.setattr(A, "COMMON", common)
    df = spark.createDataFrame(docs, "doc_id long, text string, row string, n_tokens int")
    learn = crc_rest("doc_id", 5) != 1
    got = A.lm_scores(df, PATH, learn).collect()
    assert len(got) == len(docs)
    split = lambda t: (t or "").encode().translate(A._UPPER).split()
    train = [t for i, t, *_ in docs if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in [*split(t), b""])
    total, down = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = sorted((str(i), len(split(t)) + 1, sum(counts[w] > 0 for w in [*split(t), b""]), total) for i, t, *_ in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    by = {r.doc_id: r for r in got}
    for i, t, *_ in docs:
        if i is not None and i != 7:
            assert by[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / down) for w in [*split(t), b""]), rel=1e-9)
    if common > 4:
        held = [r for r in got if r.doc_id is not None and r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
        assert all(r.score < 0 and r.attention_score < 0 for r in got)
        # with the constants of the queries
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nothing_to_learn_from(spark, docs):
    df = spark.createDataFrame(docs[:5], "doc_id long, text string, row string, n_tokens int")
    assert {(r.n_known, r.train_tokens) for r in A.lm_scores(df, PATH, crc_rest("doc_id", 5) > 9).collect()} == {(0, 0)}
    assert A.lm_scores(df.where("false"), PATH, crc_rest("doc_id", 5) != 1).collect() == []


def test_every_word_is_trained_on(spark):
    for n in (0, 1, 23, 24, 25, 100, 5000):
        for rounds in (1, 2, 6):
            read = sorted(x for turn in range(rounds) for x in A.spans([b"x"] * n, turn, rounds))
            assert [k for a, b in read for k in range(a, b)] == list(range(n)) and read[-1][1] == n
    # a text shorter than every offset but the first teaches too
    texts = spark.createDataFrame([(f"tide harbour {k}",) for k in range(40)], "text string").coalesce(1)
    code, w, _ = A.train(texts, PATH)
    symbols = code.symbol[A.subwords(PATH).ids([b"tide", b"harbour", *(str(k).encode() for k in range(40))], False)]
    assert (w["E"][symbols[:-1]] != A.first_weights(code)["E"][symbols[:-1]]).any(1).all()


def test_scored_ids_have_context():
    _, _, live, who = A.windows([np.arange(1000, dtype=np.int32)], coding())
    assert len(who) > 1 and live[1:].argmax(1).min() >= A.LENGTH // 2
    assert (A.WIDTH, A.CLASSES) >= (16, 192)


def test_scoring_works_out_only_the_places_that_it_scores(monkeypatch):
    code = coding()
    w = A.first_weights(code)
    ids = [np.arange(k, k + n, dtype=np.int32) for k, n in ((3, 1), (50, 1001), (7, A.LENGTH), (9, 530))]
    x, y, live, _ = A.windows(ids, code)
    g, _ = A.hidden(w, x)
    z = A.times(g, w["C"]) + w["c"]
    plain = np.take_along_axis(z - np.log(np.exp(z).sum(-1, keepdims=True)), code.of[y][..., None], 2)[..., 0] + code.share[y]
    states, hidden = [], A.hidden
    monkeypatch.setattr(A, "hidden", lambda *a: states.append(hidden(*a)) or states[-1])
    got = A.scored(ids, w, code, 64)
    assert [len(s) for s in got] == [len(s) for s in ids] and np.allclose(np.concatenate(got), plain[live], atol=1e-5)
    assert sum(s[0].shape[0] * s[0].shape[1] for s in states) <= sum(map(len, ids)) + len(ids) * A.LENGTH


@pytest.mark.parametrize("bits", [21, 4])
def test_followers_are_discounted_counts_that_sum_to_one(monkeypatch, bits):
    monkeypatch.setattr(A.Table, "BITS", bits)
    deal, size, end = np.random.default_rng(4), 6, 5
    ids = [np.append(deal.integers(0, end, deal.integers(0, 30)), end).astype(np.int32) for _ in range(20)]
    key, n = np.unique(A.triples(ids, size), return_counts=True)
    assert n.sum() == sum(map(len, ids))
    base = size + 1
    pair, at = np.unique(key % base**2, return_inverse=True)
    n2 = np.bincount(at, n).astype(int)
    counts = np.bincount(np.concatenate(ids), minlength=size)
    keep = n > 1 if bits == 21 else n > 0
    made = A.Followers(counts.astype(float), len(ids), (pair, n2), (key[keep], n[keep]))
    low = deal.dirichlet(np.ones(size))
    three, two, one = Counter(), Counter(), Counter()
    for s in ids:
        x = [size, size, *s.tolist()]
        for a, b, c in zip(x, x[1:], x[2:]):
            three[a, b, c] += 1
            two[b, c] += 1
            one[b] += 1
    for a in range(base):
        for b in range(base):
            if b == end or a == end or (b == size and a != size):
                continue
            # the last id of a sequence that begins with a, b is the one that the context predicts
            start = [x for x in (a, b) if x != size]
            if a == size or bits == 21:
                got = [made.mixed([np.array([*start, c], dtype=np.int32)], np.full(len(start) + 1, low[c]))[-1] for c in range(size)]
                assert sum(got) == pytest.approx(1, abs=1e-5)
            if bits == 21:
                f2 = [(max(two[b, c] - A.DISCOUNT, 0)) / max(one[b], 1) for c in range(size)]
                p2 = [f + (1 - sum(f2)) * low[c] for c, f in enumerate(f2)]
                total = sum(three[a, b, c] for c in range(size))
                f3 = [(three[a, b, c] - A.DISCOUNT) / total if three[a, b, c] > 1 and b < size else 0.0 for c in range(size)]  # at the start there is one context only
                assert got == pytest.approx([f + (1 - sum(f3)) * p2[c] for c, f in enumerate(f3)], abs=1e-5)


@pytest.mark.parametrize("bound, bits", [(1 << 20, 6), (30, 21), (3, 2), (0, 21)])
def test_counts_that_are_not_broadcast_count_too(spark, docs, monkeypatch, bound, bits):
    df = spark.createDataFrame(docs, "doc_id long, text string, row string, n_tokens int").where("doc_id IS NOT NULL AND doc_id <> 7").coalesce(2)
    learn = crc_rest("doc_id", 5) != 1
    want = {r.doc_id: r.score for r in A.lm_scores(df, PATH, learn).collect()}
    monkeypatch.setattr(A, "FOLLOWERS", bound)
    monkeypatch.setattr(A.Table, "BITS", bits)
    got = {r.doc_id: r.score for r in A.lm_scores(df, PATH, learn).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-4) for k in want)
