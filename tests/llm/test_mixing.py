import numpy as np
import pytest

from tidewater.llm import mixing as M

DOMAINS = {"clean": 0.8, "low": 0.15, "toxic": 0.05}


@pytest.fixture(scope="module")
def tables(spark):
    deal = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("sal", "tor", "min", "vel") for b in ("an", "os", "it", "ur", "em")]
    docs, labels = [], []
    for i in range(300):
        kind = ("clean", "low", "toxic")[(i % 10 > 5) + (i % 10 > 8)]
        words = deal.choice(plain, int(deal.integers(20, 200))).tolist()
        if kind == "low":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            words = [w if k % 3 else "scoundrel" for k, w in enumerate(words)]
        docs.append((i, " ".join(words), kind))
        if i < 200:
            labels.append((i, kind))
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame([*labels, (None, "low"), (5, None), (6, "other")], "doc_id long, domain string")


def test_targets_are_met(tables):
    docs, labels = tables
    rows = M.mix(docs, labels, DOMAINS, "clean").collect()
    truth = {r.doc_id: r.rate for r in docs.collect()}
    assert np.mean([r.domain == truth[r.doc_id] for r in rows if r.doc_id >= 200]) >= 0.95
    assert all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in rows)
    got = np.sum([r.rate * r.tokens * np.array(r.p) for r in rows], axis=0)
    full = np.sum([r.tokens * np.array(r.p) for r in rows], axis=0)
    assert np.allclose(got, [full[0] / 0.8 * w for w in DOMAINS.values()], rtol=0.001)


def test_equals_dense_descent(tables):
    """The same problem by plain projected descent with small steps: no lower loss."""
    docs, labels = tables
    weights = {"clean": 0.5, "low": 0.1, "toxic": 0.4}  # more of the toxic domain than there is
    rows = M.mix(docs, labels, weights, "clean", 0.0, 1.5).collect()
    n, p = np.array([r.tokens for r in rows], float), np.array([r.p for r in rows])
    full = n @ p
    want = full[0] / 0.5 * np.array([0.5, 0.1, 0.4])
    loss = lambda r: (((r * n) @ p - want) ** 2 / full).sum() / n.sum()
    r = np.ones(len(n))
    for _ in range(20000):
        r = np.clip(r - 0.2 * p @ (((r * n) @ p - want) / full), 0, 1.5)
    assert loss(np.array([x.rate for x in rows])) <= loss(r) + 1e-4


def test_kept_domain_and_odd_rows(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, "sal tor", "x"), (7, None, "x"), (8, "", "x"), (9, "w " * 100_000, "x")], docs.schema)
    rows = M.mix(docs.union(odd), labels, DOMAINS, "clean", high=1.0, keep="clean").collect()
    assert len(rows) == 304 and all(r.rate == 1 for r in rows if r.domain == "clean")
    assert {r.tokens for r in rows if r.doc_id in (7, 8)} >= {0}


def test_empty_tables(tables):
    docs, labels = tables
    assert M.mix(docs.where("false"), labels, DOMAINS, "clean").collect() == []
    assert {round(sum(r.p), 9) for r in M.mix(docs, labels.where("false"), DOMAINS, "clean").collect()} == {1.0}


def test_refuses_odd_weights(tables):
    with pytest.raises(ValueError):
        M.mix(*tables, {"clean": 0.0, "low": 1.0}, "clean")


def test_targets_beyond_the_supply(tables):
    """Rates over 1 reach a target of more than there is; the reached totals say so."""
    docs, labels = tables
    weights = {"clean": 0.5, "low": 0.1, "toxic": 0.4}
    rows = M.mix(docs, labels, weights, "clean")
    got = {r.domain: r.tokens for r in M.reached(rows, list(weights)).collect()}
    assert all(got[d] / sum(got.values()) == pytest.approx(w, rel=0.001) for d, w in weights.items())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shares_on_the_corpus(spark, sf):
    from tidewater.llm import queries

    rows = queries.op8_mixing(spark, f"/root/testdata/{sf}")
    got = {r.domain: r.tokens for r in M.reached(rows, list(queries.MIX_WEIGHTS)).collect()}
    assert all(got[d] / sum(got.values()) == pytest.approx(w, rel=0.01) for d, w in queries.MIX_WEIGHTS.items())
