import numpy as np
import pytest

from tidewater.llm import topk as K


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            v = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
            ok[i] = min(ok.get(i, v), v)
    out = []
    for q in (i for i in ok if i % every == 0):
        got = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(got[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024, 48), (50, 3, 7), (50, 3, 0)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(K, "ROWS", blocks[0])
    monkeypatch.setattr(K, "QUERIES", blocks[1])
    monkeypatch.setattr(K, "PIVOTS", max(1, blocks[2]))
    deal = np.random.default_rng(0)
    base = deal.normal(size=(6, 8))
    rows = [(int(i), [float(x) for x in base[i % 6] * (1 + i % 3) + (deal.normal(size=8) * 0.01 if i % 2 else 0)]) for i in range(300)]
    rows += [(400, None), (401, [float("nan")] * 8), (402, [None] + [0.5] * 7), (403, [float("inf")] * 8), (500, [3e5] * 8), (501, [-4e5] * 8), (600, [0.0] * 8), (600, [-1.0] * 8), (None, [1.0] * 8), (700, [1.0, 2.0]), (701, [2.0, 2.0]), (800, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    assert sorted(map(tuple, K.top_k(df, 5, 20).collect())) == brute(rows, 5, 20)


def test_pivots_prune():
    deal = np.random.default_rng(1)
    centres = deal.integers(-900, 900, (40, 16))
    rows = np.repeat(centres, 100, 0) + deal.integers(-3, 4, (4000, 16))
    ids = np.arange(4000)
    got = list(K.block_top(rows[:5], ids[:5], rows, ids, centres, 10))
    score = rows[:5] @ rows.T
    for q in range(5):
        want = sorted((-score[q, i], i) for i in range(4000) if i != q)[:10]
        assert [(-s, r) for a, r, s in got if a == q] == want


def test_empty_table(spark):
    assert K.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
