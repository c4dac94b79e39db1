import math
import random

import numpy as np
import pytest

from timeweave.llm import knn
from timeweave.llm.knn import quantise, top_k


def brute(rows, k):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in vectors:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def run(spark, rows, k=5):
    v = quantise(spark.createDataFrame([(i, x, 0, 0.5) for i, x in rows], "vec_id long, embedding array<float>, label int, score double"))
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(v.where("id % 50 = 0"), v, k).collect()}


def f32(x):
    return float(np.float32(x))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 40)
    r = random.Random(1)
    centres = [[r.gauss(0, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [f32(c + r.gauss(0, 0.1)) for c in r.choice(centres)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 520)]
    assert run(spark, rows) == brute(rows, 5)


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, []), (None, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, [(0, [1.0])]) == set() and run(spark, []) == set() and run(spark, [(1, [1.0]), (2, [0.5])]) == set()
    assert run(spark, [(0, [0.5]), (1, [0.25])]) == {(0, 1, 1, 128 * 64)}


def test_cells_that_cannot_matter_are_left_out(spark):
    pivots = np.array([[1000.0, 0.0], [-1000.0, 0.0]])
    cell = lambda c: {"cell": c, "n": 50, "radius": 10.0, "least": 990.0**2, "most": 1010.0**2}
    assert knn.needed([cell(0)], [cell(0), cell(1)], pivots, 5) == {0: [0]}


def test_large_components_are_exact(spark):
    """Scores beyond 2^53, where floating point rounds, and near 2^63."""
    r = random.Random(4)
    rows = [(i, [float(r.randint(900_000, 1_000_000)) + r.randint(0, 255) / 256 for _ in range(3)]) for i in range(120)]
    assert any(s > 2**53 for *_, s in brute(rows, 5))
    v = quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in top_k(v.where("id % 50 = 0"), v, 5).collect()} == brute(rows, 5)
    huge, small = np.array([[2**31, -(2**31)], [3, 2**32]]), np.array([[2**30, -(2**30)], [2**22, -5]])
    want = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in small] for a in huge]
    assert knn.inner_products(huge, small).tolist() == want
    with pytest.raises(OverflowError):
        knn.inner_products(huge * 2**20, huge * 2**20)


def test_widths_and_repeated_ids(spark):
    v = lambda rows: quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="1 to 2 components"):
        top_k(v([(0, [1.0]), (1, [1.0, 2.0])]), v([(0, [1.0])]), 5)
    rows = v([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])])
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(rows.where("id = 0"), rows, 5).collect()) == [(0, 1, 1, 2**17), (0, 2, 1, 2**17)]
