from __future__ import annotations

import numpy as np

from cutledger.llm import lattice

from .common import components


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_decode_gives_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    q = lattice.decode(x)
    near = q[:, None, :] + np.concatenate([lattice.ROOTS, np.zeros((1, 8))])[None]
    best = ((x[:, None, :] - near) ** 2).sum(-1).min(1)
    assert np.allclose(((x - q) ** 2).sum(1), best)
    twice = np.rint(q * 2).astype(int)
    assert (((twice % 2).sum(1) % 8) == 0).all() and (q.sum(1).astype(int) % 2 == 0).all()
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240


def test_recall_by_cosine():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(1500, 64)))
    r = rng.normal(size=x.shape)
    r = unit(r - (r * x).sum(1, keepdims=True) * x)
    tables = lattice.Tables(64)
    own, near = tables.cells(x)
    for c, least in ((0.9, 0.93), (0.95, 0.99)):
        o, n = tables.cells(c * x + np.sqrt(1 - c * c) * r)
        hit = ((near == o[:, :, None]).any(2) | (n == own[:, :, None]).any(2)).any(1)
        assert hit.mean() >= least


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = unit(rng.normal(size=(120, 64)))
    rows = [b for b in base] + [unit(b + rng.normal(size=64) * s / 8) for b in base[:40] for s in (0.05, 0.2, 0.3)] + [base[0]] * 5 + [unit(base[1] + rng.normal(size=64) * 0.02) for _ in range(300)]
    v = [[float(x) for x in r] for r in rows]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()}
    x = unit(np.array(v))
    adj = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    links = adj.sum(1)
    mine = np.array([got[i].n_links for i in range(len(x))])
    assert (mine <= links).all() and mine.sum() >= 0.95 * links.sum()
    comp = components(len(x), list(zip(*np.nonzero(adj), strict=True)))
    assert np.mean([got[i].component_id == c for i, c in enumerate(comp)]) > 0.97


def test_edges(spark):
    a, b = [1.0] + [0.0] * 63, [2.0] + [0.0] * 63
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [None, *a[1:]]), (5, [float("nan"), *a[1:]]), (6, [float("inf"), *a[1:]]), (7, a), (8, b), (8, b), (None, a), (9, [1e200, *a[1:]]), (10, [1.0, 1.0]), (11, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, label string, cls long")
    got = lattice.near_vectors(frame).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 0 and by[i].kept for i in range(1, 7))
    assert by[7].n_links == 4 and by[9].component_id == 7 and by[8].n_links == 4
    assert by[10].n_links == 1 and by[11].component_id == 10
    assert lattice.near_vectors(frame.limit(0)).count() == 0
