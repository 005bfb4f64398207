"""Operators 11 and 12 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutledger.llm import block_search, hard_negatives, tiles


def crowd(seed: int, n: int = 900, dim: int = 24):
    """Random directions, near copies, a third of all rows equal, ties."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) / 5
    x[: n // 3] = x[0]
    x[n // 3 : n // 2] = x[n // 3] + rng.normal(size=(n // 2 - n // 3, dim)) * 1e-3
    x[-50:] = np.round(x[-50:], 1)
    x[-30:] = x[-60:-30]
    return x[rng.permutation(n)].astype(np.float32)


def nearest_by_hand(x, ids, queries, k):
    out = []
    for q in queries:
        d = np.zeros(len(x))
        for t in range(x.shape[1]):
            d += (x[:, t].astype(float) - float(x[q, t])) ** 2
        d = np.sqrt(d)
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), float(d[i])) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("rows", [1024, 64])
def test_nearest_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", rows)
    monkeypatch.setattr(tiles, "ASKED", rows)
    x = crowd(1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = block_search.nearest(vectors, vectors.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id"), 10)
    assert sorted(map(tuple, got.collect())) == nearest_by_hand(x, np.arange(len(x)), range(0, len(x), 4), 10)


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(3)
    for scale in (1e-6, 1.0, 1e6):
        x, y = rng.normal(size=(60, 40)) * scale, rng.normal(size=(80, 40)) * scale
        y[:20] = x[:20] + rng.normal(size=(20, 40)) * scale * 1e-4
        a, sa, na, ea = block_search.quantised(x)
        b, sb, nb, eb = block_search.quantised(y)
        d = np.sqrt(np.maximum(na[:, None] + nb - 2 * sa[:, None] * sb * block_search.products(a, b), 0))
        true = np.sqrt(((x[:, None] - y) ** 2).sum(2))
        assert (np.abs(d - true) <= ea[:, None] + eb).all()
        assert (ea.mean() + eb.mean()) < 0.05 * np.median(true)


def test_products_of_wide_rows_are_exact():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(-127, 128, (5, 3000)).astype(np.int8) for _ in range(2))
    a[0], b[0] = 127, 127
    assert (block_search.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


EDGES = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (200, [0.0, 2.0]), (9, [1e200, 0.0]), (300, [1.0, 2.0, 3.0, 4.0])]


def test_nearest_edges(spark):
    frame = spark.createDataFrame([(i, v, "x", 0, 1) for i, v in EDGES], "vec_id long, embedding array<double>, label string, cls long, h long")
    asked = frame.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(map(tuple, block_search.nearest(frame, asked, 10).collect()))
    far = float("inf")
    assert got == [(100, 1, 7, 0.0), (100, 2, 200, 5**0.5), (100, 3, 9, far), (200, 1, 7, 5**0.5), (200, 2, 100, 5**0.5), (200, 3, 9, far)]
    assert block_search.nearest(frame.limit(0), asked, 10).count() == 0
    assert block_search.nearest(frame, asked.limit(0), 10).count() == 0


def negatives_by_hand(x, labels, ids, anchors):
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    out = []
    for a in anchors:
        s = v @ v[a]
        order = np.lexsort((ids, -s))
        for p in [i for i in order if i != a and labels[i] == labels[a]][:5]:
            fit = [i for i in order if labels[i] != labels[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            out += [(int(ids[a]), int(ids[p]), r + 1, int(ids[i]), int(s[p]), int(s[i])) for r, i in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("rows", [1024, 64])
def test_negatives_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", rows)
    monkeypatch.setattr(tiles, "ASKED", rows)
    x, rng = crowd(2), np.random.default_rng(5)
    labels = np.where(rng.random(len(x)) < 0.4, 1, rng.integers(0, 6, len(x)))
    vectors = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine(vectors, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(x, labels, np.arange(len(x)), range(0, len(x), 5))


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 16))
    x = np.rint((centres[rng.integers(0, 8, 640)] + rng.normal(size=(640, 16)) * 0.05) * 256).astype(np.int64)
    x[5] = 0
    directions = hard_negatives.references(x[:200])
    norms = np.sqrt((x * x).sum(1).astype(float))
    block = {"h": np.arange(640), "g": np.arange(640), "label": np.zeros(640, np.int64), "norms": norms, "angles": hard_negatives.angles(x.astype(float), norms, directions), "x": x, "ids": np.arange(640), "starts": np.arange(641)}
    kept = hard_negatives._runs(block)
    assert sorted(kept["ids"].tolist()) == list(range(640))
    low, high = hard_negatives.intervals(block["angles"], norms, kept["low"], kept["high"], kept["shortest"], kept["longest"])
    s = x @ kept["x"].T
    begins = np.arange(0, 640, hard_negatives.RUN)
    assert (np.minimum.reduceat(s, begins, axis=1) >= low).all() and (np.maximum.reduceat(s, begins, axis=1) <= high).all()
    asked = block | {"n": 640, "windows": np.zeros(0, np.int64), "starts": np.zeros(641, np.int64)}
    heaps, pairs = hard_negatives.alike(asked, [kept | {"n": 640}] * 2, 6)
    assert pairs < 0.7 * 2 * 640 * 640  # once a heap is full, what stands in other directions isn't scored


def test_negatives_edges(spark):
    rows = [(i, v, 1, 0, 0) for i, v in EDGES] + [(50, [0.5, 0.5], None, 0, 0), (150, [1.0, 1.0], 1, 0, 0), (151, [1.0, 1.0], 1, 0, 0), (152, [0.75, 0.75], 2, 0, 0), (152, [0.75, 0.75], 2, 0, 0), (153, [0.0, 0.0], 3, 0, 0), (400, [0.0, 0.0], 3, 0, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h long, score long")
    got = sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") % 50 == 0).collect()))
    assert (150, 151, 1, 152, 2 * 65536, 2 * 256 * 192) in got
    assert not {50, 1, 2, 4, 5, 6, None} & {r[0] for r in got} and not {r[3] for r in got} & {1, 2, 4, 5, 6, 9, 50, None}
    # a zero row's positive scores nothing, and so do all others
    assert [r for r in got if r[0] == 400] == [(400, 153, 1, 3, 0, 0), (400, 153, 2, 7, 0, 0), (400, 153, 3, 100, 0, 0)]
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
