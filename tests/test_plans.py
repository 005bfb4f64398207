"""Whole plans: edit programs, casting, structures, removal plans, fills; and the search bounds."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cutledger.operators import casting as C
from cutledger.operators import ranking as K
from cutledger.operators import revise as E
from cutledger.operators import structure as U

ITEM = "plan_id long, pos long, slot_id string, beat_id string, segment_id long, asset_id long, start long, cap long, fit long, units array<struct<s:long,e:long>>"
OP = "plan_id long, i long, op string, `on` string, `by` string, factor_milli long, target_ms long"
FOUND = "plan_id long, i long, rank long, segment_id long, asset_id long, s long, e long"


def plan(n, plan_id=1, units=None):
    return [(plan_id, p, f"s{p}", "b", 100 + p, 1, 0, 9000, 4000, units) for p in range(1, n + 1)]


def edit(spark, items, ops, found=()):
    rows = spark.createDataFrame(items, ITEM)
    out = E.edit_plans(rows, spark.createDataFrame(ops, OP), spark.createDataFrame(list(found), FOUND)).collect()
    return {r.plan_id: r for r in out}


def test_faster_middle_changes_the_middle_alone(spark):
    got = edit(spark, plan(6) + plan(2, 2) + plan(3, 3), [(1, 0, "retime", "middle", None, 500, None), (2, 0, "retime", "middle", None, 500, None)])
    assert [(x.fit, x.changed) for x in got[1]["items"]] == [(4000, False)] * 2 + [(2000, True)] * 2 + [(4000, False)] * 2
    # two items have no middle third: the one half way it is
    assert [x.changed for x in got[2]["items"]] == [False, True]
    assert got[3].log == [] and not any(x.changed for x in got[3]["items"])


def test_references_are_those_of_the_moment(spark):
    ops = [(1, 0, "drop_item", "0", None, None, None), (1, 1, "drop_item", "0", None, None, None), (1, 2, "drop_item", "s1", None, None, None), (1, 3, "insert_beat", "s3", "x", None, None), (1, 4, "retime", "inserted_3", None, 2000, None), (1, 5, "swap_ending", "q", "", None, None)]
    found = [(1, 3, 0, 104, 1, 0, 500), (1, 3, 1, 7, 2, 1000, 2500), (1, 5, 0, 105, 1, 0, 900), (1, 5, 1, 8, 1, 0, 900)]
    got = edit(spark, plan(5), ops, found)[1]
    assert [x.segment_id for x in got["items"]] == [103, 7, 104, 8]
    assert [(x.i, x.outcome, x.at) for x in got.log] == [(0, "dropped", 0), (1, "dropped", 0), (2, "no item", None), (3, "inserted", 0), (4, "retimed", None), (5, "swapped", 3)]
    new = got["items"][1]
    assert (new.slot_id, new.role, new.cap, new.fit) == ("inserted_3", "inserted", 1500, 1500)


def test_retimed_items_cut_no_word(spark):
    units = [(700, 1600)]
    got = edit(spark, plan(1, 1, units) + [(2, *r[1:7], 1600, *r[8:]) for r in plan(1, 2, units)], [(p, 0, "retime", "all", None, None, 1000) for p in (1, 2)])
    assert got[1]["items"][0].fit == 1700 and got[2]["items"][0].fit == 650


def test_motifs_come_again_and_shots_go_together(spark):
    slots = [(1, 1, "door", 1, 1, 1, None, None), (1, 2, None, None, 2, 3, ["set"], None), (1, 3, "door", 2, 1, 2, None, None), (1, 4, None, None, 2, 2, ["set"], None), (1, 5, None, None, 1, 1, None, 9), (1, 6, None, None, 1, 1, None, None)]
    pool = [(1, 1, 0, 5, 1, 10, {"set": ["a"]}), (1, 2, 0, 5, 1, 90, {"set": ["a"]}), (1, 2, 1, 6, 2, 70, {"set": ["a", "b"]}), (1, 2, 2, 7, 3, 60, {"set": ["c"]}), (1, 2, 3, 8, 3, 60, {"set": ["b"]}), (1, 3, 0, 9, 4, 99, {}), (1, 4, 0, 7, 3, 50, {"set": ["c"]}), (1, 5, 0, 4, 1, 50, {}), (1, 5, 1, 9, 1, 10, {})]
    got = C.cast_plans(spark.createDataFrame(slots, "plan_id long, pos long, motif string, occurrence int, shots_min int, shots_max int, continuity array<string>, preselected long"), spark.createDataFrame(pool, "plan_id long, pos long, rank int, segment_id long, asset_id long, score long, tokens map<string,array<string>>"))
    rows = [(r.pos, r.shot, r.segment_id, r.score, r.status) for r in got.collect()]
    # 5 costs 30 + 10 in slot 2; what goes with 6 there has an a or a b
    assert sorted(rows, key=lambda r: (r[0], r[1] is None, r[1])) == [
        (1, 0, 5, 10, "cast"), (2, 0, 6, 70, "cast"), (2, 1, 8, 60, "cast"), (2, 2, 5, 50, "used again"), (3, 0, 5, 10, "motif again"), (4, 0, 7, 40, "cast"), (4, None, None, None, "too few shots"), (5, 0, 9, 0, "cast"), (6, None, None, None, "uncast"),
    ]


def test_structures_without_a_valid_beat_fall_back(spark):
    rows = [(1, None, 60_000), (2, '{"nonsense": true}', None), (3, '{"beats": [{"id": "a", "intensity_target": -3, "recontextualizes": "a"}], "ordering_constraints": {"a": 1}}', 0)]
    got = {r.reply_id: r for r in U.conform_structures(spark.createDataFrame([(i, r, "d", t) for i, r, t in rows], "reply_id long, raw string, directive string, duration_ms long")).collect()}
    assert [b.function for b in got[1].beats] == ["open", "develop_1", "develop_2", "develop_3", "develop_4", "close"] and [b.lo for b in got[1].beats] == [3500, 4200, 4900, 5600, 6300, 3000]
    assert got[2].fallback and len(got[2].beats) == 3 and got[2].warnings == ["malformed reply"]
    assert not got[3].fallback and got[3].beats[0].lo == 0 and got[3].beats[0].recontextualizes == "a" and got[3].warnings == ["beat a: no function"] and got[3].rules == []


def test_phrases_and_folded_letters(spark):
    docs = spark.createDataFrame([(1, "Café people appearance, green T-shirt"), (2, "appearance of people in a cafe"), (3, "PEOPLE_APPEARANCE people appearance"), (4, None), (5, "t shirt a a a")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "people_appearance"), (2, "café"), (3, "t-shirt"), (4, "a_a"), (5, " - ")], "query_id int, query_text string")
    got = {}
    for r in K.bm25(docs, asked, 9, phrases=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {1: [3, 1], 2: [2, 1], 3: [5, 1], 4: [5]} or got == {1: [3, 1], 2: [1, 2], 3: [5, 1], 4: [5]}


def test_bounds_leave_most_hits_unscored(spark):
    """A word that every document has meets blocks, not documents; and the best are those of scoring everything."""
    import random

    rng = random.Random(7)
    words = ["the"] * 200 + [f"w{i}" for i in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.choice([20, 60, 200])))) for i in range(3000)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"the w{q} w{q * 7 % 400}") for q in range(20)], "query_id int, query_text string")
    top, pairs = K.bounded_top(docs, asked, 5)
    units = K.units_of(asked, False)
    parts = K.contributions(docs, units, True)
    every = units.select("query_id", F.array_join("unit", " ").alias("unit")).join(parts, "unit").groupBy("query_id", "doc_id").agg(F.round(F.negative(F.sum("part")), 6).alias("score"))
    best: dict = {}
    for r in every.collect():
        best.setdefault(r.query_id, []).append((r.score, r.doc_id))
    want = {(q, d) for q, v in best.items() for _, d in sorted(v)[:5]}
    assert {(r.query_id, r.doc_id) for r in top.collect()} == want
    assert pairs.count() < 0.4 * sum(map(len, best.values()))


def test_removal_plans_meet_directives_in_the_last_step(spark):
    from cutledger.operators import removal as P

    plans = spark.createDataFrame([("a|", 1, 0, 5, True), ("a|", 1, 5, 900_000, False), ("a|", 2, 0, 9, True), ("a|x", 2, 0, 9, False)], "sig string, asset_id long, s long, e long, kept boolean")
    links = spark.createDataFrame([(q, None, "a|") for q in range(20)] + [(7, 2, "a|x")], "q long, asset_id long, sig string")
    out = P.expanded_plans(plans, links)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "LeftAnti" not in plan
    got = sorted(map(tuple, out.collect()))
    want = [(q, 1, *r) for q in range(20) for r in ((0, 5, True), (5, 900_000, False))] + [(q, 2, 0, 9, q != 7) for q in range(20)]
    assert got == sorted(want)


def test_slots_and_candidates_are_dealt_by_their_plan_alone(spark, data):
    from cutledger import catalog

    plan = catalog.queries()["q15_motif_cast"](spark, data)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    # neither slots with their candidates nor candidates are dealt by slot or by a number of groups
    assert dealt and not any("pos#" in x or "_g#" in x for x in dealt)
