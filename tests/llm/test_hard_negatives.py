import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peopleweave.llm import hard_negatives as H
from peopleweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, id string"


def brute(rows, positives=5, negatives=3, every=50):
    good = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        good[i] = min(good.get(i, row), row)
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (m, w) in good.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(hard, 1)]
    return sorted(out)


def run(spark, rows, every=50, **options):
    out = H.mine(spark.createDataFrame(rows, SCHEMA), lambda i: i % every == 0, **options)
    return sorted(tuple(r) for r in out.collect())


def vectors(n, dim=8, seed=0, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, (centres[i % 6] + rng.normal(size=dim) * 0.4).astype(np.float32).tolist(), int(rng.integers(labels)), "x", "y") for i in range(n)]


def test_equals_brute_force_over_several_cells_parts_and_chunks(spark):
    rows = vectors(900)
    assert run(spark, rows, every=10, first_rows=20, part_rows=40, chunk_rows=16) == brute(rows, every=10)
    assert run(spark, rows, every=50) == brute(rows)


def test_odd_rows_copies_and_ties(spark):
    rows = vectors(300)
    v = rows[50][1]
    odd = [(None, v, 1, "x", "y"), (400, v, None, "x", "y"), (450, None, 1, "x", "y"), (500, [float("nan")] * 8, 1, "x", "y"), (550, [1.0, None] + [0.0] * 6, 1, "x", "y"),
           (600, [1.0, 2.0], 1, "x", "y"), (601, [1.0, 2.0], 1, "x", "y"), (602, [0.5, 1.5], 2, "x", "y"), (650, [], 1, "x", "y"), (651, [], 1, "x", "y"), (652, [], 2, "x", "y"),
           (700, [0.0] * 8, 1, "x", "y"), (750, [1.5], 1, "x", "y"), (751, [1.5], 1, "x", "y"), (752, [1.0], 3, "x", "y"), (-50, v, 2, "x", "y")]
    copies = [(1000 + i, [float(np.float32(0.8)) * x for x in v], 3 if i % 2 else 0, "x", "y") for i in range(120)]
    rows += odd + copies + [rows[3], (100, rows[7][1], 0, "x", "y")]
    assert run(spark, rows, first_rows=10, part_rows=16, chunk_rows=4) == brute(rows)


def test_few_or_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, vectors(1)) == []
    assert run(spark, vectors(3)) == brute(vectors(3))
    assert run(spark, vectors(60, labels=1)) == []


@pytest.mark.parametrize("seed", range(3))
def test_heap_hands_out_every_cell_by_falling_bound(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, 7).astype(float), rng.integers(0, 5, 4).astype(float)
    out = list(H.visit(a, b))
    assert sorted((i, j) for _, i, j in out) == [(i, j) for i in range(7) for j in range(4)]
    assert [s for s, _, _ in out] == sorted((x + y for x in a for y in b), reverse=True)


def test_bounds_hold_and_cells_are_skipped():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6)) * 300
    x = np.floor(centres[rng.integers(5, size=400)] + rng.normal(size=(400, 6)) * 3)
    words = H.fit_words(x[:, :3], 5), H.fit_words(x[:, 3:], 5)
    book = H.Codebooks(words)
    near = [H.nearest_words(h, w) for h, w in zip(book.halves(x), words)]
    for k in (0, 1):
        np.maximum.at(book.radii[k], near[k][0], near[k][1])
    np.add.at(book.rows, (near[0][0], near[1][0]), 1)
    q = x[0]
    bounds = {(i, j): s for s, i, j in book.cells(q)}
    assert all(x[r] @ q <= bounds[near[0][0][r], near[1][0][r]] for r in range(400))
    bar = np.sort(x @ q)[-5]
    popped, wanted = book.wanted(q, 0, bar, 0)
    visited = {(i, j) for i, js in wanted.items() for j in js}
    assert all((near[0][0][r], near[1][0][r]) in visited for r in np.flatnonzero(x @ q >= bar))
    assert sum(book.rows[c] for c in visited) < 200


def test_registered_query(spark, tmp_path):
    rows = vectors(420, labels=10)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (m + 1) % 10 if i % 7 == 0 else m) for i, v, m, *_ in rows]
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect())
    assert got == brute(moved) and got
