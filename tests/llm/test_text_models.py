"""Language, toxicity and quality: held-out results on the synthetic tables, brute force, edges."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from cutledger.llm import language_id, quality, queries, toxicity

from .common import docs, edge_docs

BIG, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_language_held_out(spark):
    got = queries.op3_language_id(spark, BIG).toPandas()
    truth = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98
    assert both.score.between(0, 1).all()


def test_language_against_plain_counts(spark):
    train = spark.createDataFrame([("the cat sat, the mat", "en"), ("der hund und die katze", "de"), ("the dog and the log", "en"), ("das haus und der baum", "de")], "text string, lang string")
    tests = ["the tree and the cat", "die katze und das", "x", "Ÿ", "1 2", None, ""]

    def grams(t):
        low = "".join(c.lower() if c.isalpha() else " " for c in t)
        s = " " + " ".join(low.split()) + " "
        out = Counter(c for c in s if c != " ")
        out.update(s[i : i + 2] for i in range(len(s) - 1))
        out.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
        return out

    def key(g):
        codes = [ord(c) for c in g]
        return sum(c << (21 * (len(codes) - 1 - i)) for i, c in enumerate(codes))

    ranks = {}
    for lang in ("de", "en"):
        total = Counter()
        for r in train.collect():
            if r.lang == lang:
                total.update(grams(r.text))
        top = sorted(total, key=lambda g: (-total[g], key(g)))[: language_id.PROFILE]
        ranks[lang] = {g: i for i, g in enumerate(top)}
    got = {r.doc_id: r for r in language_id.identify(docs(spark, tests), train).collect()}
    for i, t in enumerate(tests):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        own = grams(t)
        own = sorted(own, key=lambda g: (-own[g], key(g)))[: language_id.RANKED]
        cost = {lang: sum(abs(k - r[g]) if g in r else language_id.PROFILE for k, g in enumerate(own)) for lang, r in ranks.items()}
        best = min(sorted(cost), key=cost.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 - cost[best] / (language_id.PROFILE * len(own)))


def test_language_edges(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    got = language_id.identify(edge_docs(spark), empty).collect()
    assert len(got) == 11 and {r.lang_pred for r in got} == {"und"}
    assert language_id.identify(edge_docs(spark).limit(0), empty).count() == 0


def test_toxicity_held_out(spark):
    got = queries.op4_toxicity(spark, BIG).toPandas()
    truth = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.85
    assert held[held.predicted == 1].toxic.mean() > 0.9
    assert both.score.between(0, 1).all()


@pytest.mark.skipif(not os.path.exists(LARGE), reason="needs the larger tables")
def test_toxicity_recall_with_more_labels(spark):
    got = queries.op4_toxicity(spark, LARGE).toPandas()
    truth = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", "toxic").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert held[held.predicted == 1].toxic.mean() > 0.9 and held[held.toxic == 1].predicted.mean() > 0.75


def test_toxicity_finds_the_sentence_and_noisy_or_holds(spark):
    rows = [(i, f"calm words here today. you {'awful' if i % 2 else 'lovely'} creature number {'abcdef'[i % 6]}. fine end.") for i in range(200)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(spark, [(i, t + f" w{i}") for i, t in rows]), labels)
    frame = docs(spark, [(1, "Nice day.\né you awful creature! Bye."), (2, "Nice day."), (3, "")]).selectExpr("doc_id", "false as held_out", "text")
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert got[1].score > 0.7 > got[2].score and got[3].score == 0
    (span,) = got[1].offending
    assert "Nice day.\né you awful creature! Bye."[span.start : span.end] == "é you awful creature"
    bags = toxicity.score(docs(spark, [(1, "you awful thing"), (2, "you awful thing. you awful thing")]).selectExpr("doc_id", "false as held_out", "text"), model).collect()
    one, two = sorted(r.score for r in bags)
    # scores are calibrated log odds of the noisy-or
    raw = lambda s: 1 / (1 + np.exp(-(np.log(s / (1 - s)) - model.shift) / model.scale))
    assert raw(two) == pytest.approx(1 - (1 - raw(one)) ** 2)


def test_calibration_keeps_order_and_fits():
    rng = np.random.default_rng(2)
    odds = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * odds + 1)))).astype(int)
    scale, shift = toxicity.calibrate(odds, y)
    assert abs(scale - 0.5) < 0.06 and abs(shift - 1) < 0.12
    assert toxicity.calibrate(odds, 1 - y)[0] > 0


def test_text_odds_are_those_of_the_noisy_or():
    z, doc = np.array([-2.0, 0.5, -40.0, 3.0]), np.array([0, 0, 1, 3])
    got = toxicity.text_odds(z, doc, 4)
    p = 1 / (1 + np.exp(-z))
    for i in (0, 3):
        whole = 1 - np.prod(1 - p[doc == i])
        assert np.isclose(got[i], np.log(whole / (1 - whole)))
    assert got[1] < -25 and got[2] < -25


def test_toxicity_edges(spark):
    for labels in ([], [(4, 1, 1)], [(4, 1, 0), (5, None, 1), (None, 1, 1)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = toxicity.train(edge_docs(spark), table)
        frame = edge_docs(spark).selectExpr("doc_id", "false as held_out", "text", "score as n")
        got = toxicity.score(frame, model).collect()
        assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_quality_keeps_good_texts(spark):
    got = queries.op1_quality_classifier(spark, BIG).toPandas()
    truth = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality").toPandas()
    both = got.merge(truth, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.98
    assert (~both[both.quality == 0].kept).mean() > 0.9


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "plain text of a document with words", None, "a.example/good/x" if i < 40 else "b.example/bad/x", 0) for i in range(80)] + [(99, "plain text of a document with words", None, "https://c.example/one", 0)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.judge(frame, labels).collect()}
    assert len(got) == 81
    mean = np.mean([r._doc for r in got.values()])
    assert got[99]._site == pytest.approx(mean, abs=0.02)


def test_site(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("src3",), ("HTTP://A.b/c/d/e?f",), (None,), ("a.b/",)], "s string")
    host, path = quality.site(F.col("s"))
    assert [tuple(r) for r in rows.select(host, path).collect()] == [("src3", ""), ("a.b", "/c/d/"), ("", ""), ("a.b", "/")]


def test_quality_edges(spark):
    frame = edge_docs(spark)
    for labels in ([], [(4, 1, 1), (5, 0, None), (8, None, 1)]):
        out = quality.judge(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert out.columns == [*frame.columns, "_doc", "_site", "_good", "_kept"]
        got = out.collect()
        assert len(got) == 11 and all(0 <= r._good <= 1 for r in got)
    assert quality.judge(frame.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_site_posteriors_against_brute_force(spark, data):
    """Pages have real hosts and folders: each text's site posterior from all others', worked out group by group."""
    import math
    from collections import defaultdict

    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{data}/pages.parquet").selectExpr("page_id as doc_id", "html as text", "concat(url, case when page_id % 3 = 0 then '/deep/er' else '/x' end) as source")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality.judge(pages, labels).withColumns({"h": quality.site(F.col("source"))[0], "q": quality.site(F.col("source"))[1]}).collect()
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r.h].append(r._doc)
        paths[r.h, r.q].append(r._doc)
    assert len(paths) > len(hosts) > 1
    mean = lambda x: sum(x) / len(x)

    def worth(groups):
        """groups: list of (values, parent's mean, parent's count)."""
        n = sum(len(v) for v, _, _ in groups)
        spread = sum(len(v) * (mean(v) - m) ** 2 - m * (1 - m) * (1 - len(v) / k) for v, m, k in groups)
        free = sum(len(v) * (1 - len(v) / k) for v, _, k in groups)
        if free <= 1e-9:
            return 1e4
        noise = sum(len(v) * m * (1 - m) for v, m, _ in groups) / n
        return min(max(noise / max(spread / free, 1e-6), 1.0), 1e4)

    whole = [r._doc for r in got]
    w_host = worth([(v, mean(whole), len(whole)) for v in hosts.values()])
    w_path = worth([(v, mean(hosts[h]), len(hosts[h])) for (h, _), v in paths.items()])
    for r in got:
        h, p = hosts[r.h], paths[r.h, r.q]
        m = (sum(h) - r._doc + w_host * mean(whole)) / (len(h) - 1 + w_host)
        if len(p) < len(h):
            m = (sum(p) - r._doc + w_path * m) / (len(p) - 1 + w_path)
        assert math.isclose(r._site, min(max(m, 1e-4), 1 - 1e-4), rel_tol=1e-6)


def test_judge_without_text_gives_the_same(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    a = quality.judge(docs, labels).drop("text").collect()
    b = quality.judge(docs, labels, text=False).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
