from __future__ import annotations

import math

import numpy as np
import pytest

from hourgrid.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, step=20):
    good = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, v) for i, v in good if i % step == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=20):
    v = topk.quantised(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in topk.top_k(v.where("vec_id % 20 = 0"), v, k).collect())


def test_equals_brute_force_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 6) / 64], 0) for i in range(700)]
    monkeypatch.setattr(topk, "SHARD_ROWS", 90)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 11)
    assert run(spark, rows) == brute(rows, 20)


def test_one_common_vector(spark):
    rows = [(i, [0.5, -0.25], 0) for i in range(400)] + [(400 + i, [float(i), 1.0], 0) for i in range(60)]
    assert run(spark, rows) == brute(rows, 20)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [None, 1.0], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [], 0), (6, [1.0], 0),
            (None, [1.0, 1.0], 0), (7, [-1.5, 0.3], 0), (7, [-1.5, 0.3], 0), (20, [], 0), (40, [0.01, -0.01], 0)]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == []


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2 ** 30 + 1, 3]]), np.array([[2 ** 30 - 1, 5]])
    assert topk._product(a, b)[0, 0] == (2 ** 30 + 1) * (2 ** 30 - 1) + 15


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.integers(-60, 60, (500, 12)), rng.integers(-60, 60, (20, 12))
    tree = topk.BallTree(x)
    upper = tree.bounds(q)
    for n, (a, b) in enumerate(tree.span):
        assert (upper[:, n] >= (q @ x[tree.order[a:b]].T).max(1)).all()


@pytest.mark.parametrize("name", ["op1_exact_top_k"])
def test_registered(name):
    assert name in queries.QUERIES and name in queries.ORACLE_SQL
