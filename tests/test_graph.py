"""Edges between segments by blocks of vectors."""

from __future__ import annotations

import numpy as np

from cutledger.operators import graph as G


def test_blocks_of_vectors_give_the_best_of_each_alone(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (700, 8)).astype(float)
    rows = [(i, i % 5, v.tolist(), i * 37 % 900, i * 37 % 900 + 100) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "segment_id long, asset_id long, embedding array<double>, s long, e long")
    frame = G.best_pairs(vectors, 0.3, 3)
    got = {(r.src, r.dst) for r in frame.collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cos = unit @ unit.T
    for i in range(len(x)):
        ok = [j for j in range(len(x)) if j != i and cos[i, j] >= 0.3 and not (i % 5 == j % 5 and abs(rows[i][3] - rows[j][3]) < 100)]
        best = sorted(ok, key=lambda j: (-round(cos[i, j], 9), j))
        mine = {d for s, d in got if s == i}
        assert len(mine) == min(3, len(ok)) and (len(ok) < 4 or round(cos[i, best[2]], 9) == round(cos[i, best[3]], 9) or mine == set(best[:3]))
    # a group gives three rows a vector, however many pairs it has
    one = [r for r in rows if r[0] < 200]
    table = spark.createDataFrame([(i, v, False, "", 0, 0, 0, 0, 0) for i, _, v, *_ in one], "segment_id long, v array<double>, whole boolean, asset string, s long, e long, mine int, lo int, hi int").toArrow()
    assert G._best_of_blocks(table, -1.0, 3).num_rows == 600
