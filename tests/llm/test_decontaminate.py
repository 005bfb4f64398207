from __future__ import annotations

import gc
import random
import weakref
from itertools import combinations

import pyarrow as pa
import pytest

from cutledger.llm.decontaminate import MASKS, _seeds, contaminated, overlap, short_masks
from cutledger.llm.words import Words

from .common import docs, edge_docs, prose


def bench(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "item_id long, text string, n long")


def test_masks_compare_eight_words():
    assert all(m.count("1") == 8 and m[0] == m[-1] == "1" for m in MASKS)


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(1)
    items = [prose(rng.randint(14, 60), rng).capitalize() + "." for _ in range(30)] + ["Short item here", prose(9, rng)]
    texts, planted = [], set()
    for i in range(120):
        w = prose(rng.randint(50, 200), rng).split(" ")
        if i < 60:
            item = items[i % len(items)].split(" ")
            if i >= 30 and len(item) > 20:  # each tenth word another one
                item = [f"sub{k}" if k % 10 == 9 else x for k, x in enumerate(item)]
            at = rng.randrange(len(w))
            w = w[:at] + " ".join(item).upper().replace(" ", ", ", 1).split(" ") + w[at:]
            planted.add((i, i % len(items)))
        texts.append(" ".join(w))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs(spark, texts), bench(spark, items)).collect()}
    assert planted <= got
    assert not {d for d, _ in got if d >= 60}


def test_against_all_diagonals(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(13, 30))) for _ in range(8)]
    texts = []
    for _ in range(60):
        a = rng.choice(items).split(" ")
        cut = rng.randint(8, len(a))
        part = [x if rng.random() > 0.1 else "zz" for x in a[:cut]]
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(20)] + part + [rng.choice(vocabulary) for _ in range(20)]))
    got = {(r.doc_id, r.item_id): r.n_equal for r in contaminated(docs(spark, texts), bench(spark, items)).collect()}
    import numpy as np

    for i, t in enumerate(texts):
        for j, it in enumerate(items):
            w, own = np.array(t.split(" ")), np.array(it.split(" "))
            hits = [x for s in range(-len(own) + 1, len(w)) if (x := overlap(w, own, s, 13, 0.8))]
            if (i, j) in got:
                assert max(h[2] for h in hits) >= got[i, j]
            else:  # only overlaps without eight equal words in a mask may be missing
                same = [[w[k + s] == own[k] for k in range(max(0, -s), min(len(own), len(w) - s))] for s in range(-len(own) + 1, len(w)) if overlap(w, own, s, 13, 0.8)]
                assert not any(all(line[a + b] for b, c in enumerate(m) if c == "1") for line in same for m in MASKS for a in range(len(line) - len(m) + 1))


def test_edges(spark):
    frame = edge_docs(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (3, "word"), (None, "tail tail"), (4, "x" * 50_000)], "item_id long, text string")
    got = contaminated(frame, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 3), (6, 3), (8, 4)} and len(got) == 3
    assert contaminated(frame, items.limit(0)).count() == 0
    assert contaminated(frame.limit(0), items).count() == 0


def test_masks_miss_no_overlap():
    """Longer parts hold one of 13 to 25 words of which 80 % are equal: of two halves one has that share."""
    masks = [{i for i, bit in enumerate(m) if bit == "1"} for m in MASKS]
    for n in range(13, 26):
        seen = [{a + i for i in m} for m in masks for a in range(n - max(m))]
        for others in combinations(range(n), n // 5):
            assert any(s.isdisjoint(others) for s in seen), (n, others)
    for n in range(1, 13):
        seen = [{i for i, bit in enumerate(m) if bit == "1"} for m in short_masks(n, 0.8)]
        assert all(len(m) == n for m in short_masks(n, 0.8)) and all(any(s.isdisjoint(o) for s in seen) for o in combinations(range(n), n // 5))


def brute(words, item):
    """Whether any 13 words or more in a row of a diagonal, or the whole item, are 80 % equal."""
    for shift in range(-len(item) + 1, len(words)):
        line = [words[i + shift] == item[i] for i in range(max(0, -shift), min(len(item), len(words) - shift))]
        for size in range(min(13, len(item)), len(line) + 1):
            if any(5 * sum(line[a : a + size]) >= 4 * size for a in range(len(line) - size + 1)):
                return True
    return False


@pytest.mark.parametrize("spread", [1, 3])
def test_against_brute_force_on_short_items(spark, spread):
    """Items of 1 to 20 words with 0 to a quarter of their words changed, anywhere, with ends cut off or not."""
    rng = random.Random(spread)
    items = [prose(n, rng).split(" ") for n in range(1, 21) for _ in range(2)]
    texts = []
    for item in items:
        for k in range(0, len(item) // 4 + 2):
            for _ in range(spread):
                part = list(item)
                for i in rng.sample(range(len(part)), min(k, len(part))):
                    part[i] = f"sub{i}"
                part = part[rng.choice([0, 0, 1]) :]
                texts.append([f"a{rng.randrange(10**6)}" for _ in range(rng.choice([0, 12]))] + part + [f"b{rng.randrange(10**6)}" for _ in range(rng.choice([0, 12]))])
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs(spark, [" ".join(t) for t in texts]), bench(spark, [" ".join(i) for i in items])).collect()}
    want = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if brute(t, item)}
    assert set(got) == want
    for (i, j), r in got.items():
        same = sum(texts[i][r.doc_word + k] == items[j][r.item_word + k] for k in range(r.n_words))
        assert same == r.n_equal and 5 * same >= 4 * r.n_words and r.n_words >= min(13, len(items[j]))


def test_a_batch_is_let_go_without_a_collection_of_cycles():
    words = Words(pa.array(["one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "a b"]), alnum=True)
    held = weakref.ref(words)
    gc.disable()
    try:
        assert sum(len(at) for _, at in _seeds(words, {2: short_masks(2, 0.8)}, whole=True)) > 13
        del words
        assert held() is None
    finally:
        gc.enable()
