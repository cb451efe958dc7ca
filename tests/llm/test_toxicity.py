import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import toxicity as T

WORDS = ["tide", "harbour", "keel", "buoy", "chart", "anchor", "mast", "rope", "sail", "wave"]


@pytest.fixture(scope="module")
def tables(spark):
    deal = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = deal.choice(WORDS, 30).tolist()
        if bad:
            words[5:7] = ["rotten", "scoundrel"]
        rows.append((i, " ".join(words).title(), "clash", 7))
        if i < 300:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, "", 0), (1001, "", "", 0), (1002, "Rotten, scoundrel! " * 20000, "", 0), (8, rows[8][1], "", 0), (None, "tide", "", 0)]
    labels += [(None, 1, 1), (2, 1, None), (0, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, y int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_odd_rows(tables):
    got = T.toxicity(*tables).collect()
    assert len(got) == 405
    by = {r.doc_id: r for r in got}
    for i in range(400):
        assert by[i].predicted in (0, int(i % 4 == 0))
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert min(r.score for r in held if r.doc_id % 4 == 0) > max(r.score for r in held if r.doc_id % 4)
    assert by[1000].score == by[1001].score < 0.5 and by[1002].predicted == 1 and 0 <= by[None].score <= 1


def test_labels_of_held_out_rows_are_not_used(tables):
    docs, labels = tables
    other = labels.withColumn("toxic", F.when(T.crc_rest("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, T.toxicity(docs, labels).collect())) == sorted(map(str, T.toxicity(docs, other).collect()))


def test_nothing_to_learn_from(tables):
    docs, labels = tables
    assert {r.score for r in T.toxicity(docs, labels.where("false")).collect()} == {0.5}
    assert T.toxicity(docs.where("false"), labels).collect() == []


def test_ftrl_equals_a_plain_loop():
    """Sums, squares and weights of every coordinate, one at a time, as McMahan et al. (2013) write them."""
    deal = np.random.default_rng(9)
    model, z, n = T.Ftrl(l1=0.3, slots=40), [0.0] * 41, [0.0] * 41

    def weight(i):
        l1 = 0.0 if i == 40 else 0.3
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((T.BETA + math.sqrt(n[i])) / T.ALPHA + T.L2)

    for _ in range(300):
        at, y = np.append(np.unique(deal.integers(0, 40, int(deal.integers(1, 12)))), 40), int(deal.integers(0, 2))
        w = {i: weight(i) for i in at.tolist()}
        g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (T.POSITIVE if y else 1.0)
        for i in at.tolist():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / T.ALPHA * w[i]
            n[i] += g * g
        model.learn(at, y)
    assert model.z == pytest.approx(z) and model.n == pytest.approx(n)
    assert model.weights(np.arange(41)) == pytest.approx([weight(i) for i in range(41)])


def test_rows_to_learn_from_stay_in_their_buffer():
    """The trainer makes no object of a row's slots: a worker keeps such memory while later stages run."""
    import pyarrow as pa

    rows = [np.arange(k, dtype="<i4") for k in (3, 0, 70_000, 1)]
    column = pa.array([r.tobytes() for r in rows], pa.binary())
    got = T.packed_rows(column)
    assert all(np.array_equal(a, b) for a, b in zip(got, rows, strict=True))
    assert np.shares_memory(got[2], np.frombuffer(column.buffers()[2], dtype="<i4"))
    assert [len(x) for x in T.packed_rows(column.slice(2, 2))] == [70_000, 1] and T.packed_rows(column.slice(0, 0)) == []
