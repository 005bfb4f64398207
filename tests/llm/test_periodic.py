"""Operator 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

from cutledger.llm import queries
from cutledger.llm.periodic import numbered, periodic, runs

from .common import edge_docs, prose


def by_hand(w, least=6, times=4):
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    w = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randint(0, 60))]
    if w and rng.random() < 0.6:
        a, p = rng.randrange(len(w)), rng.randint(1, 8)
        w = [w[min(i if i < a else a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for least, times in [(6, 4)] * 300 + [(4, 3), (8, 4), (20, 5), (6, 6)] * 40:
        texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
        ids, ends = numbered([[w.encode() for w in t] for t in texts])
        want = [(a + int(e), b, c) for e, t in zip(ends, texts, strict=False) for a, b, c in by_hand(t, least, times)]
        assert runs(ids, ends, least, times) == want


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = by_hand(w)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    told = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "A a A a A a A a A a", "a b " * 5, "é " * 7]
    texts += [prose(rng.randint(1, 150), rng) for _ in range(150)]
    texts += [prose(9, rng) + " " + " ".join([prose(p, rng)] * rng.randint(2, 9)) + " " + prose(5, rng) for p in range(1, 40)]
    texts += [" ".join(some_words(rng)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[10])]
    spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n long, runs long, words long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted((expected(i, t) for i, t in rows), key=order)


def test_operator_edges(spark):
    docs = edge_docs(spark)
    got = periodic(docs).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got} >= {None, 1, 11 - 2}
    by = {r.doc_id: r for r in got}
    assert all(by[i].runs == [] and by[i].collapsed == "" for i in (1, 2, 3)) and by[4].collapsed == "word"
    assert periodic(docs.limit(0)).count() == 0


def test_a_very_long_periodic_text():
    rng = random.Random(3)
    tail = prose(20_000, rng).split()
    w = [x.encode() for x in prose(1000, rng).split() + tail * 10]
    start = time.time()
    ids, ends = numbered([w])
    found = runs(ids, ends)
    assert (max(found, key=lambda r: r[1])[1:] >= (200_000, 20_000)) and time.time() - start < 60
