import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewater.llm.graph import components


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def check(spark, pairs):
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    want = {k: v for k, v in brute([p for p in pairs if None not in p]).items()}
    alone = {a for a, b in pairs if a == b} - {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert {r.node: r.root for r in got} == {k: v for k, v in want.items() if k not in alone}


def test_shapes(spark):
    deal = np.random.default_rng(1)
    order = deal.permutation(60).tolist()
    path = list(zip(order, order[1:]))
    check(spark, path + [(1000, k) for k in range(1001, 1100)] + [(None, 1), (5, None), (7, 7), (70, 70), (1000, 1001)])
    check(spark, [])


def test_hot_node(spark):
    """A star of more edges than go unsalted, with tails on some of its leaves."""
    check(spark, [(7, k) for k in range(10, 2600)] + [(k, k + 10000) for k in range(10, 60)] + [(3, 2599), (20000, 20001)])


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_random(spark, pairs):
    check(spark, pairs)
