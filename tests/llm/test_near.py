from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd

from cutledger.llm import components as C
from cutledger.llm import families, hyperminhash
from cutledger.llm.near_dup import full_sets, near_duplicates, sketches

from .common import components, docs, edge_docs, prose


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k):
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return components(len(texts), links), [len(s) for s in sets]


def edited(text, n, rng):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_links_are_those_of_brute_force(spark):
    rng = random.Random(1)
    base = [prose(rng.randint(3, 150), rng) for _ in range(40)]
    texts = [edited(b, e, rng) for b in base for e in (0, 0, 1, 2, 3, 5)] + ["A b\x0bC", "a B c", "one", "ONE", "", None]
    want, sizes = brute(texts, 4)
    got = {r.doc_id: r for r in near_duplicates(docs(spark, texts), k=4).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_a_large_group_of_near_copies_is_compared_in_blocks(spark):
    rng = random.Random(2)
    base = prose(60, rng)
    texts = [edited(base, rng.choice([0, 1, 2, 3, 4, 8]), rng) for _ in range(400)]
    want, _ = brute(texts, 4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, texts), k=4).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_small_blocks_find_the_same(spark):
    rng = random.Random(3)
    base = [prose(30, rng) for _ in range(3)]
    texts = list(dict.fromkeys(edited(rng.choice(base), rng.randint(0, 3), rng) for _ in range(60)))
    df = docs(spark, texts)
    node = {r.doc_id: r.cls for r in sketches(df, 4).select("doc_id", "cls").collect()}
    members = sketches(df, 4).selectExpr("1L as fam", "cls as node", "n", "regs").join(full_sets(df, 4).withColumnRenamed("cls", "node"), "node")
    sizes = spark.createDataFrame([(1, len(texts))], "fam long, size long")
    edges = families.compare(members, sizes, families.near_links(4, 5, 6.0), block=7).collect()
    place = {v: k for k, v in node.items()}
    assert components(len(texts), [(place[e.a], place[e.b]) for e in edges]) == brute(texts, 4)[0]


def test_small_sets(spark):
    """Sets of ten to thirty shingles at just 0.8: their estimates are rough, their links must not be lost."""
    rng = random.Random(9)
    texts = []
    for _ in range(150):
        n = rng.choice([9, 14, 18, 27])
        w = prose(n + 3, rng).split(" ")
        texts += [" ".join(w), " ".join(w[: -(n // 9)] + ["other"] * (n // 9))]
    want, _ = brute(texts, 4)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, texts), k=4).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < 160


def test_near_copies_without_a_doc_id_are_linked(spark):
    """To each other, to rows with an id, and as the only link between two of those."""
    from corpus_pipeline import near_dedup

    rng = random.Random(11)
    texts = []
    for ids in [(None, None, None), (50, None), (None, 51), (52, None, 53), (None,)]:
        w = prose(60, rng).split(" ")
        for n, i in enumerate(ids):  # each another 5 words at the end: neighbours are linked, the first and third are not
            texts.append((i, " ".join(w[5 * n : 5 * n + 50])))
    texts += texts[:2]
    sets = [shingles(t, 4) for _, t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    assert len(set(want)) == 5
    df = docs(spark, texts)
    place = {t: n for n, (_, t) in enumerate(texts[:-2])}
    keys = df.selectExpr("text", "xxhash64(text) as key").collect()
    place = {r.key: place[r.text] for r in keys}
    got = near_duplicates(df, k=4).collect()
    groups: dict = {}
    for r in got:
        groups.setdefault(r.group_key, set()).add(place[r.text_key])
    truth: dict = {}
    for n in range(len(texts) - 2):
        truth.setdefault(want[n], set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))
    least = {c: min((texts[n][0] for n in g if texts[n][0] is not None), default=None) for c, g in truth.items()}
    assert all(r.component_id == least[want[place[r.text_key]]] for r in got)
    left = near_dedup(spark, df, "").collect()
    assert len(left) == 5 and sorted(r.doc_id for r in left if r.doc_id is not None) == [50, 51, 52]


def test_edges(spark):
    got = near_duplicates(edge_docs(spark), k=4).collect()
    assert len(got) == 11
    by = {(r.doc_id, r.n_shingles > 0): r for r in got}
    for i in (1, 2, 3):
        assert by[i, False].component_id == i and by[i, False].kept
    assert by[6, True].component_id == 4 and not by[6, True].kept
    assert by[7, True].component_id == 5
    assert near_duplicates(edge_docs(spark).limit(0), k=4).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:700]), np.unique(pool[100:])
        truth = 600 / 900
        regs = hyperminhash.registers([a, b])
        gaps.append(hyperminhash.estimate((regs[0] == regs[1]).sum(), len(a), len(b)) - truth)
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 340)] + [(400, 400)]
    want = components(401, links)
    got = {r.node: r.comp for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in nodes}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert families.overlaps(sets, sets).tolist() == want
    assert isinstance(pd.DataFrame(want), pd.DataFrame)


def test_loose_chains_make_no_family(spark):
    """Texts that share half of their words with the next one meet in bands, but none is close: nothing is compared further."""
    from pyspark.sql import functions as F

    from cutledger.llm.families import families
    from cutledger.llm.near_dup import sketches

    rng = random.Random(11)
    blocks = [prose(60, rng) for _ in range(81)]
    texts = [f"{a} {b}" for a, b in zip(blocks[:-1], blocks[1:], strict=True)]
    texts.append(texts[0] + " more")
    rows = sketches(docs(spark, texts), 5).withColumnRenamed("cls", "node").cache()
    buckets = rows.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").join(buckets, "bucket").select("node").distinct().count()
    close = {r.node for r in families(buckets, rows.select("node", "n", "regs"), 4, 5, 6.0).collect()}
    near = {r.node for r in rows.collect() if r.doc_id in (0, 80)}
    assert near <= close and len(close) <= 4 < shared
