"""Work that grows with the input, not with its square or with copies of it."""

from __future__ import annotations

import pytest

from cutledger import catalog
from cutledger.operators import search as S


def planned(spark, data, name):
    return catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_coverage_over_blocks_of_documents_and_parts_of_terms(spark):
    words = [f"word{i}" for i in range(40)]
    texts = [(i, " ".join(words[(i * k) % 40] for k in (1, 3, 7))) for i in range(90)] + [(7, "again word39"), (None, "word1"), (91, None)]
    asked = [(i, f"{words[i % 40]} of {words[i * 5 % 40]}") for i in range(60)] + [(100, "of it"), (101, None), (102, "unheard")]
    got = S.coverage_report(spark.createDataFrame(asked, "attribute_id long, attribute string"), spark.createDataFrame(texts, "doc_id long, text string"), block=8, part=4)
    want = {}
    for a, text in asked:
        terms = {t for t in (text or "").split() if len(t) > 2}
        want[a] = len({d for d, t in texts if d is not None and t and terms & set(t.split())})
    assert {r.attribute_id: r.n for r in got.collect()} == want and want[102] == 0 and want[1] > 5


def test_values_are_compared_within_their_list(spark, data):
    rows = spark.createDataFrame([(1, ["A b", "c", "a-B", " c ", None]), (1, ["d", "e", "C"]), (2, None), (3, [])], "k long, values array<string>")
    got = {r.k: r.kept for r in S.dedupe(rows, "k").collect()}
    assert got[1][0] == "A b" and set(got[1]) == {"A b", "c", None, "d", "e"} and got[3] == [] and 2 not in got
    plan = planned(spark, data, "x30_dedupe")
    assert "Generate" not in plan and plan.count("hashpartitioning") == 1


@pytest.mark.parametrize(("name", "windows"), [("q17_overlay_candidates", 2), ("q36_resolve_item_ref", 1)])
def test_items_of_a_plan_meet_as_arrays(spark, data, name, windows):
    plan = planned(spark, data, name)
    assert plan.count("Window [") <= windows and "SortAggregate" not in plan and "posexplode" not in plan


def test_regions_of_a_chain_are_worked_out_once(spark, data, monkeypatch):
    from cutledger.operators import intervals as T

    runs = []
    merge = T.merge_removals
    monkeypatch.setattr(T, "merge_removals", lambda *a, **k: runs.append(1) or merge(*a, **k))
    plan = planned(spark, data, "t28_attach_evidence")
    # once for the regions, once with the slivers; what is left to do reads written rows
    assert len(runs) == 2 and plan.count("lineitem") == plan.count("lineitem.parquet]") and "Window [" not in plan


def test_names_meet_the_documents_that_have_them(spark, data):
    texts = [
        "the sea was calm", "another sea the sea was calm-ish today", "another sea was calm", "", None, "a-b c\nd e f", "x a b c d effort", "_sea  was", "The Sea", "calm",
        "of the seaside", "the sea", "the seashore was", "weather sea was the", "a b c d e f g", "aa b c d e f a", "sea was calm", "the sea was calm",
    ]
    names = ["The sea was calm", "the sea was", "the sea", "sea", "THE SEA", "", " ", "a b c d e", "a-b-c d e f", "a b c d e f g", "-sea", "was-", "sea\nwas", "nothing of this", None, "calm", "sea  was"]
    docs = [(i * 7 % 101, t) for i, t in enumerate(texts * 3)]
    norm = lambda t, more="": t.lower().translate(str.maketrans(dict.fromkeys("- " + more, "_")))
    want = set()
    for name in {n for n in names if n is not None}:
        key = norm(name.strip(" "))
        ids = sorted(d for d, t in docs if t is not None and key in norm(t, "\n") and key.split("_")[0] in norm(t, "\n").split("_"))
        want |= {(name, d, r) for r, d in enumerate(ids[:5], 1)}
    args = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in S.evidence_for_name(*args).collect()} == want
    # no row for each name and document that has its first word
    plan = planned(spark, data, "x29_evidence_for_name")
    assert plan.count("Generate") == 0 and "doc_id = doc_id" not in plan.replace("#", " ") and plan.count("Join") == 1


def test_a_script_is_read_once_for_plans_of_one_length(spark, data, monkeypatch):
    from cutledger.operators import replies as Y

    from cutledger.sources import views as V

    read, conform = [], Y.conform_scripts
    monkeypatch.setattr(Y, "conform_scripts", lambda replies: read.append(replies.count()) or conform(replies))
    plan = planned(spark, data, "q28_edit_log")
    n = V.plan_items(spark, data).groupBy("plan_id").count()
    assert read and read[0] <= 6 * n.select("count").distinct().count() < n.count() and "MapInArrow" in plan


def test_directives_of_one_wish_share_their_links(spark, monkeypatch):
    from cutledger.operators import intervals as T
    from cutledger.operators import removal as P

    rows = {}
    written = P.written
    monkeypatch.setattr(P, "written", lambda df, name: rows.setdefault(name, written(df, name)))
    monkeypatch.setattr(T, "attach_evidence", None)
    asked = spark.createDataFrame([(q, "dull" if q == 30 else None) for q in range(31)], "q long, why string")
    targets = spark.createDataFrame([(q, "sea") for q in range(31)] + [(q, "sun") for q in range(20, 25)] + [(25, None)], "q long, target string")
    named = spark.createDataFrame([("sea", 1, 2000, 4000), ("sea", 2, 0, 5000), ("sun", 2, 7000, 9000), ("sun", 3, 0, 9000)], "target string, asset_id long, s long, e long")
    found = spark.createDataFrame([(1, 6000, 9000, "dull")], "asset_id long, s long, e long, why string")
    assets = spark.createDataFrame([(a, 10_000) for a in (1, 2, 3)], "asset_id long, duration_ms long")
    plans, links = P.factored_plans(asked, found, named, targets, assets, ["dull"])
    # sea and sea,sun touch two and three assets, and dull with sea two, however many directives ask
    assert rows["own"].count() == 7
    want = {(q, None, "dull|" if q == 30 else "|") for q in range(31)} | {(q, a, "|sea") for q in range(30) for a in (1, 2) if a == 1 or not 20 <= q < 25}
    want |= {(q, 2, "|sea,sun") for q in range(20, 25)} | {(q, 3, "|sun") for q in range(20, 25)} | {(30, 1, "dull|sea"), (30, 2, "dull|sea")}
    got = [(r.q, r.asset_id, r.sig) for r in links.collect()]
    assert len(got) == len(want) and set(got) == want
    made = {(r.sig, r.asset_id, r.s, r.e, r.kept) for r in plans.collect()}
    assert {("|sea", 1, 0, 2200, True), ("|sea", 1, 2200, 3800, False), ("|sea", 1, 3800, 10_000, True), ("|", 3, 0, 10_000, True)} <= made


def test_evidence_that_is_only_counted_is_not_dealt_out(spark, data):
    plan = planned(spark, data, "t28_attach_evidence")
    assert "collect_list" not in plan and "sum(" in plan
