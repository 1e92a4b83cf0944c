"""op12 against brute force."""

import numpy as np
import pytest

from barspark.llm import negatives

SCHEMA = "vec_id long, label long, vector array<long>, rank string"


def brute(rows, anchor, positives=5, negatives_=5, low=80, high=100):
    rows = sorted({(i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None})
    out = []
    for a, l, v in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in rows if i != a and len(w) == len(v))
        for s, p, m in [x for x in scored if x[2] == l][:positives]:
            fit = [(n, i) for n, i, m in scored if m != l and low * -s <= 100 * -n <= high * -s][:negatives_]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "old") for r in rows], SCHEMA).repartition(7)


@pytest.mark.parametrize("block", [4096, 3])
def test_negatives_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-20, 40, 4).tolist()) for i in range(400)]
    rows += [(400 + i, i % 2, [30, 30, 30, 30]) for i in range(60)]  # a common vector: ties in both roles
    rows += [(500 + i, 1, [0, 0, 0, 0]) for i in range(8)] + [(600, 1, [1, 2]), (601, 1, [1, 2]), (602, 0, [1, 2])]
    rows += rows[:30] + [(None, 1, [1, 1, 1, 1]), (701, None, [1, 1, 1, 1]), (702, 1, None)]
    got = negatives.mine(frame(spark, rows), lambda key: key % 20 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda a: a % 20 == 0)


def test_a_score_is_shared_by_positive_and_negatives_of_smaller_id(spark):
    rows = [(100, 0, [2]), (1, 1, [5]), (50, 0, [5]), (2, 1, [4]), (3, 1, [6]), (4, 1, [3]), (60, 0, [-1]), (61, 0, [0]), (5, 1, [0])]
    got = sorted(map(tuple, negatives.mine(frame(spark, rows), lambda key: key == 100).collect()))
    assert got == [(100, 50, 1, 1, 10, 10), (100, 50, 2, 2, 10, 8), (100, 61, 1, 5, 0, 0)] == brute(rows, lambda a: a == 100)


def test_large_numbers(spark):
    big = 2**28
    rows = [(100, 0, [big, 1]), (1, 0, [big, 9]), (2, 1, [big, 8]), (3, 1, [big, 10]), (4, 1, [big - 1, 5])]
    assert sorted(map(tuple, negatives.mine(frame(spark, rows), lambda key: key == 100).collect())) == brute(rows, lambda a: a == 100)


def test_no_rows_no_anchor_no_positive(spark):
    rows = [(1, 0, [1]), (2, 1, [1]), (100, 5, [1])]
    assert negatives.mine(frame(spark, rows).limit(0), lambda key: key == 100).count() == 0
    assert negatives.mine(frame(spark, rows), lambda key: key == 7).count() == 0
    assert negatives.mine(frame(spark, rows), lambda key: key == 100).count() == 0


def test_the_shuffle_sorts_by_the_packed_key(spark):
    pairs = spark.createDataFrame([(1, -5, 1, 3), (1, -7, 0, 9), (0, 1, 1, 1), (1, -5, 0, 4)], "n int, down long, kind byte, id long")
    plan = negatives._sorted(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(n" in plan and "Sort [n" in plan
