import math

import numpy as np
import pytest

from peopleweave.llm import permutation_index as P

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = tuple(np.float32(v).astype(float).tolist())
            good[i] = min(good.get(i, v), v)
    out = []
    for i, v in good.items():
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good.items() if j != i and len(w) == len(v))[:k]
            out += [(i, n, j, round(-s, 9)) for n, (s, j) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, k=20, **options):
    out = P.nearest(spark.createDataFrame(rows, SCHEMA), lambda i: i % 20 == 0, k, **options)
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in out.collect())


def vectors(n, dim=8, seed=0):
    return [(i, v.tolist(), "x") for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32))]


def test_small_tables_are_exact_with_odd_rows(spark):
    rows = vectors(150)
    odd = [(None, rows[0][1], "x"), (200, None, "x"), (201, [], "x"), (202, [0.0] * 8, "x"), (203, [1.0, None] + [0.0] * 6, "x"), (204, [float("nan")] + [1.0] * 7, "x"), (205, [float("inf")] * 8, "x"),
           (220, [1.0, 2.0], "x"), (221, [2.0, 1.0], "x"), (240, [1.0, 2.0, 3.0], "x"), rows[3], (20, [9.0] * 8, "x")]
    assert run(spark, rows + odd) == brute(rows + odd, 20)


def test_copies_ties_and_many_blocks(spark):
    rows = vectors(60) + [(1000 + i, [1.0] + [0.0] * 7, "x") for i in range(90)] + [(i, [2.0] + [0.0] * 7, "x") for i in (3001, 2000, 2020)]
    assert run(spark, rows, index_rows=16, query_rows=3) == brute(rows, 20)


def test_fewer_candidates_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, vectors(1)) == []
    assert run(spark, vectors(3)) == brute(vectors(3), 20)


def test_recall_of_the_index(spark):
    centres = np.random.default_rng(1).normal(size=(12, 32))
    rng = np.random.default_rng(2)
    rows = [(i, (centres[i % 12] * 0.4 + rng.normal(size=32) * rng.uniform(0.5, 2)).astype(np.float32).tolist(), "x") for i in range(4000)]
    got, want = run(spark, rows, index_rows=3000), brute(rows, 20)
    found = len({(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want})
    assert len(got) == len(want) and found >= 0.9 * len(want)


@pytest.mark.parametrize("prefix", [3, 8])
def test_rankings(prefix):
    order, ranks = P.rankings(np.array([[1.0, 0.2], [0.1, 1.0]]), np.array([[0, 1.0], [1, 0], [1, 1], [0, 0], [-1, 0]])[:, :2], prefix)
    assert order[0][:3].tolist() == [2, 1, 0] and ranks[0, 2] == 0 and ranks[0, 0] == 2 and ranks[0, 4] == min(prefix, 4)
