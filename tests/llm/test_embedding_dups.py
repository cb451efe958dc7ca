import numpy as np

from tidewater.llm import embedding_dups as E


def brute(rows, threshold):
    live = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            live[i] = min(live.get(i, v), v)
    ids = sorted(live)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and len(live[a]) == len(live[b]):
                x, y = np.array(live[a]), np.array(live[b])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return links, root


def test_recall_and_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 40)
    deal = np.random.default_rng(0)
    rows, at = [], 0
    for size, noise in [(1, 0.1)] * 700 + [(2, 0.05)] * 60 + [(5, 0.03)] * 20 + [(150, 0.02), (90, 0.0)]:
        centre = deal.normal(size=32) / np.sqrt(32)
        for _ in range(size):
            rows.append((at, [float(x) for x in centre + deal.normal(size=32) * noise]))
            at += 1
    order = deal.permutation(len(rows))
    rows = [(int(order[i]), v) for i, v in rows]
    odd = [(5000, None), (5001, [float("nan")] * 32), (5002, [0.0] * 32), (5003, [None] * 32), (5004, []), (5005, [1.0, 2.0]), (5006, [2.0, 4.0]), (5007, [1e30, 2e30]), (None, [1.0, 2.0]), (5008, [1e-30] * 32), (5008, [1e-30] * 32)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, root int, v string")
    got = E.near_duplicates(df, 0.9).collect()
    assert len(got) == len(rows) + len(odd)
    links, root = brute(rows + odd, 0.9)
    found = sum(r.n_links for r in got)
    assert 0.97 <= found / sum(map(len, links.values())) <= 1
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
            continue
        assert r.n_links <= len(links.get(r.vec_id, ())) and r.kept == (r.vec_id == r.component_id)
        assert root.get(r.component_id, r.component_id) == root.get(r.vec_id, r.vec_id)
    same = sum(r.component_id == root.get(r.vec_id, r.vec_id) for r in got)
    assert same >= 0.98 * len(got)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_passes_follow_the_number_of_vectors():
    assert [E.passes_for(n, 0.9) for n in (0, 1, 32, 1000, 50_000)] == [E.PASSES] * 5
    assert E.PASSES < E.passes_for(10**6, 0.9) < E.passes_for(10**9, 0.9) < 250


def test_packed_vectors_keep_within_their_error():
    deal = np.random.default_rng(1)
    units = E._unit(np.concatenate([deal.normal(size=(50, 7)), np.eye(7)]))
    for u, packed in zip(units, E._packed(units)):
        scale, error = np.frombuffer(packed[:8], np.float32)
        assert np.linalg.norm(u - np.frombuffer(packed[8:], np.int8) * float(scale)) <= error < 0.02


def test_recall_of_lone_pairs_just_over_the_threshold(spark):
    deal = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x, y = deal.normal(size=(2, 32))
        x /= np.linalg.norm(x)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        for j, c in ((0, 1.0), (1, 0.903)):
            rows.append((2 * i + j, (c * x + np.sqrt(1 - c * c) * y if j else x).tolist()))
    rows += [(600 + i, v.tolist()) for i, v in enumerate(deal.normal(size=(6000, 32)))]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).where("vec_id < 600").collect()
    assert sum(r.component_id == r.vec_id - r.vec_id % 2 for r in got) >= 0.95 * 600


def test_many_equal_vectors_count_as_links_of_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(E, "HOT", 100)
    rows = [(i, [1.0, 0.0, -0.0]) for i in range(10, 400)] + [(i, [2.0, 0.2, 0.0]) for i in range(400, 410)] + [(500, [0.0, 1.0, 0.0]), (501, [0.0, 3.0, 0.0])]
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    assert {(r.n_links, r.component_id) for i, r in got.items() if i < 410} == {(399, 10)}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (500, 501)] == [(1, 500, True), (1, 500, False)]
