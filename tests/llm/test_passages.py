from __future__ import annotations

import random

import numpy as np
import pytest

from cutledger.llm import passages as P

from .common import docs, edge_docs, prose


def covered(rows):
    """(doc, word) of what the rows say."""
    return {(r.doc_id, w) for r in rows for w in range(r.first_word, r.first_word + r.n_words)}


def brute(texts, least=20, need=16):
    """Words of each document in windows that an earlier document has too, by trying all shifts word by word: {(doc, word)} of later ones, then of earlier ones."""
    words = [t.lower().split() for t in texts]
    gone, base = set(), set()
    for d in range(len(words)):
        for o in range(d):
            for shift in range(least - len(words[o]), len(words[d]) - least + 1):
                same = {i: words[d][i] == words[o][i - shift] for i in range(max(0, shift), min(len(words[d]), len(words[o]) + shift))}
                for i in same:
                    window = [same.get(k) for k in range(i, i + least)]
                    if None in window or sum(window) < need:
                        continue
                    # the ends of a passage are equal words: others count only between equal ones
                    hits = [i + k for k, s in enumerate(window) if s]
                    gone |= {(d, k) for k in range(hits[0], hits[-1] + 1)}
                    base |= {(o, k - shift) for k in range(hits[0], hits[-1] + 1)}
    return gone, base


def changed(passage, rng, each):
    w = passage.split()
    at = rng.randrange(each)
    return " ".join(f"new{rng.randrange(10**6)}" if i % each == at else x for i, x in enumerate(w))


@pytest.mark.parametrize("each", [None, 10])
def test_planted_passages_of_all_lengths(spark, each):
    rng = random.Random(each or 1)
    sizes = [20, 25, 30, 40, 50, 70, 100]
    texts, planted = [], {}
    for n in sizes:
        for p in range(40):
            passage = prose(n, rng).replace(" te", "\nTe").replace(" lo", " LO")
            for copy in range(2):
                before = prose(rng.randint(0, 60), rng).split()
                here = changed(passage, rng, each) if each and copy else passage
                planted.setdefault((n, p), []).append((len(texts), len(before), here))
                texts.append(" ".join([*before, here, prose(rng.randint(0, 60), rng)]))
    clean = range(len(texts), len(texts) + 60)
    texts += [prose(rng.randint(60, 300), rng) for _ in clean]
    texts = [t.replace("  ", " ") for t in texts]
    got = P.repeated(docs(spark, texts)).collect()
    gone = covered([r for r in got if r.removed])
    share = {}
    for n in sizes:
        caught = 0
        for p in range(40):
            _, (doc, at, here) = planted[n, p]
            words = here.split()
            mine = [(doc, at + k) for k in range(len(words))]
            # what has been changed at an end isn't of the passage
            caught += len(gone & set(mine)) >= (len(mine) if each is None else 0.75 * len(mine))
        share[n] = caught / 40
    print(share)
    assert min(share.values()) >= (1 if each is None else 0.9), share
    assert not {r.doc_id for r in got} & set(clean)


def test_against_all_shifts(spark):
    rng = random.Random(4)
    base = prose(120, rng).split(" ")
    texts = []
    for i in range(24):
        a = rng.randrange(80)
        part = " ".join(base[a : a + rng.randint(15, 40)])
        if i % 3 == 1:
            part = changed(part, rng, 12)
        texts.append(" ".join(prose(rng.randint(1, 25), rng).split(" ") + part.split(" ") + prose(rng.randint(1, 25), rng).split(" ")))
    texts += [texts[3], texts[3], " ".join(texts[5].split()[:30]), "la " * 60, "la " * 45]
    want_gone, want_base = brute(texts)
    got = P.repeated(docs(spark, texts)).collect()
    gone = covered([r for r in got if r.removed])
    assert gone <= want_gone and covered(got) <= want_gone | want_base
    assert len(gone) >= 0.97 * len(want_gone)
    for r in got:
        assert r.copy_of is not None and r.copy_of <= r.doc_id and (r.copy_of < r.doc_id or not r.removed)


def test_parts():
    rng = np.random.default_rng(1)
    for p in (0.5, 0.75, 0.85, 0.95):
        same = rng.random(400) < p
        want = np.zeros(400, bool)
        for i in range(381):
            if same[i : i + 20].sum() >= 16:
                want[i : i + 20] = True
        got = np.zeros(400, bool)
        for a, b in P.parts(same):
            assert same[a] and same[b - 1] and not got[a:b].any()
            got[a:b] = True
        assert not (got & ~want).any() and not (want & ~got & same).any()
    assert P.parts(np.ones(19, bool)) == [] and P.parts(np.ones(20, bool)) == [(0, 20)]


def test_many_copies_and_a_common_passage(spark):
    rng = random.Random(6)
    common, copy = prose(60, rng), prose(200, rng)
    texts = [prose(40, rng) + " " + common + " " + prose(40, rng) for _ in range(300)] + [copy] * 200
    got = P.repeated(docs(spark, texts)).collect()
    stay = [r for r in got if not r.removed]
    assert sorted(r.doc_id for r in stay) == [0, 300] and len(got) == 500
    assert all(r.copy_of == (0 if r.doc_id < 300 else 300) and r.n_words >= 60 for r in got)


def test_edges(spark):
    got = P.repeated(edge_docs(spark)).collect()
    assert {r.doc_id for r in got} == {5, 7}
    assert all(r.removed == (r.doc_id == 7) and r.copy_of == 5 for r in got)
    assert P.repeated(edge_docs(spark).limit(0)).count() == 0


def test_rows_without_id_come_last(spark):
    rng = random.Random(9)
    passage = prose(40, rng)
    rows = [(None, passage + " one two"), (None, passage + " three"), (None, passage + " three"), (4, "four " + passage)]
    got = P.repeated(docs(spark, rows)).collect()
    assert [(r.doc_id, r.removed) for r in sorted(got, key=lambda r: r.removed)] == [(4, False), (None, True), (None, True)]
    assert {r.copy_of for r in got} == {4}
    alone = P.repeated(docs(spark, rows[:3])).collect()
    assert [r.removed for r in sorted(alone, key=lambda r: r.removed)] == [False, True]


def test_sliding():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for size in range(1, 8):
        assert P._sliding(x, size, np.minimum).tolist() == [min(x[i : i + size]) for i in range(8 - size)]


def test_a_passage_whose_bands_stand_elsewhere_in_an_earlier_text(spark):
    import random

    from cutledger.llm.passages import repeated

    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = some(30)
    first = [w for i in range(26) for _ in range(30) for w in (*some(4), *passage[i : i + 5], *some(4))]
    texts = [first, some(40) + passage + some(40), some(25) + passage + some(60)]
    docs = spark.createDataFrame([(i + 1, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.first_word, r.n_words, r.copy_of, r.removed) for r in repeated(docs).collect()}
    assert got == {(2, 40, 30, 2, False), (3, 25, 30, 2, True)}


def test_rows_are_compared_many_at_a_time():
    rng = np.random.default_rng(3)
    rows = [rng.random(n) < p for n in (0, 5, 19, 20, 21, 40, 90, 0, 300) for p in (0.7, 0.85, 0.95, 1.0) for _ in range(20)]
    first = np.cumsum([0, *map(len, rows)])
    want = [(i, a, b) for i, same in enumerate(rows) for a, b in P.parts(same)]
    row, start, end = P.passages(np.concatenate(rows), first)
    assert list(zip(row, start, end, strict=True)) == want and len(want) > 100
    # a window over two rows is none
    assert not len(P.passages(np.ones(38, bool), np.array([0, 19, 38]))[0]) and not len(P.passages(np.zeros(0, bool), np.array([0, 0]))[0])
