"""Known cases of the interval operators, in ms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutledger.operators import intervals as T


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return sorted((r.s, r.e) for r in df.select("s", "e").collect())


def test_snap_point_and_tie(spark):
    points = table(spark, [(1, 4800, "shot_change"), (1, 6200, "shot_change")], "asset_id long, t long, reason string")
    targets = table(spark, [(1, 1, 5000), (1, 2, 10_000), (1, 3, 5500)], "asset_id long, target_id long, t long")
    got = {r.target_id: r.snapped for r in T.snap_points(targets, points, 1000).collect()}
    assert got == {1: 4800, 2: None, 3: 6200}  # 5500 is as near to both: the later wins


def test_snap_range(spark):
    points = table(spark, [(1, 2000, "gap_end"), (1, 9500, "gap_start"), (2, 3000, "shot_change"), (2, 8000, "shot_change"), (3, 5000, "shot_change"), (3, 5200, "shot_change")], "asset_id long, t long, reason string")
    ranges = table(spark, [(1, 1, 2400, 9100), (2, 1, 3300, 7800), (3, 1, 4800, 5400)], "asset_id long, target_id long, s long, e long")
    got = {r.asset_id: (r.new_s, r.new_e) for r in T.snap_ranges(ranges, points, 1000, 1000).collect()}
    assert got == {1: (1850, 9650), 2: (3000, 8000), 3: (4800, 5400)}


def test_word_boundaries(spark):
    words = table(spark, [(1, 0, 0, 500, 900), (1, 0, 1, 950, 1400), (1, 0, 2, 2000, 2500)], "asset_id long, pos long, i long, s long, e long")
    assets = table(spark, [(1, 10_000)], "asset_id long, duration_ms long")
    got = sorted((r.t, r.reason) for r in T.word_boundary_points(words, assets).collect())
    assert got == [(500, "word_start"), (1400, "word_end"), (2000, "word_start"), (2500, "word_end")]


def regions(spark, rows):
    return table(spark, [(1, s, e, [], ["x"]) for s, e in rows], "asset_id long, s long, e long, evidence array<string>, why array<string>")


def test_merge_and_margin(spark):
    assert pairs(T.merge_removals(regions(spark, [(1000, 1400), (1600, 2000)]), 500)) == [(1000, 2000)]
    assert len(pairs(T.merge_removals(regions(spark, [(1000, 1400), (2000, 2400)]), 500))) == 2
    assert pairs(T.apply_margin(regions(spark, [(1000, 2000), (500, 800)]), 200, 200)) == [(1200, 1800)]


def test_sliver_and_guard(spark):
    assets = table(spark, [(1, 10_000)], "asset_id long, duration_ms long")
    kept, removed = T.subtract_regions(regions(spark, [(9000, 9800)]), assets)
    assert pairs(kept) == [(0, 9200)] and pairs(removed) == [(9200, 10_000)]
    words = table(spark, [(1, 900, 1300), (1, 1800, 2300)], "asset_id long, s long, e long")
    assets = table(spark, [(1, 4000)], "asset_id long, duration_ms long")
    kept, removed = T.subtract_regions(regions(spark, [(1000, 2000)]), assets, words)
    edges = [x for p in pairs(kept) for x in p]
    assert not any(s < x < e for x in edges for s, e in ((900, 1300), (1800, 2300)))
    assert all(1300 <= s and e <= 1800 for s, e in pairs(removed))
    assert sum(e - s for s, e in pairs(kept) + pairs(removed)) == 4000


def test_chunks(spark):
    assets = table(spark, [(1, 2_000_000), (2, 1_800_100), (3, 600_000), (4, None)], "asset_id long, duration_ms long")
    got: dict = {}
    for r in T.chunk_plan(assets, 900_000, 1_200_000).collect():
        got.setdefault(r.asset_id, []).append((r.s, r.e))
    assert sorted(got[1]) == [(0, 900_000), (900_000, 1_800_000), (1_800_000, 2_000_000)]
    assert len(got[2]) == 2 and sorted(got[3]) == [(0, 600_000)] and got[4] == [(0, 0)]


def test_anchor_trim(spark):
    rows = table(spark, [(1, 0, 30_000), (2, 5000, 10_000)], "id long, s long, e long")
    none = F.array().cast("array<struct<s:bigint,e:bigint,text:string>>")
    got = {r.id: (r.x.s, r.x.e) for r in rows.select("id", T.anchor_trim(F.col("s"), F.col("e"), F.lit(6000), none, F.lit("")).alias("x")).collect()}
    assert got == {1: (12_000, 18_000), 2: (5000, 10_000)}


def test_one_asset_of_all_rows_is_spread(spark):
    """Islands of an asset that has every row: the same as of small ones, and no task of the window holds a large share."""
    import random

    from cutledger.operators import scans

    rng = random.Random(4)
    rows = sorted((t, t + rng.choice([0, 10, 400, 130_000])) for t in (rng.randrange(3_000_000) for _ in range(3000)))
    words = spark.createDataFrame([(1, s, e) for s, e in rows], "asset_id long, s long, e long")
    want, end = [], None
    for s, e in rows:
        if end is None or s > end:
            want.append([s, e])
        want[-1][1] = end = max(end or 0, e)
    got = T.merge_kept(words).orderBy("s").collect()
    assert [[r.s, r.e] for r in got] == [w for w in want if w[1] > w[0]]
    found = scans.scan(words, ["s", "e"], n=("sum_to", F.lit(1)), top=("max_before", F.col("e")), prev=("lag", F.col("e")), next=("lead", F.col("s"))).orderBy("n").collect()
    assert [(r.s, r.e) for r in found] == rows and [r.n for r in found] == list(range(1, 3001))
    for i, r in enumerate(found):
        assert r.prev == (rows[i - 1][1] if i else None) and r.next == (rows[i + 1][0] if i < 2999 else None) and r.top == max((e for _, e in rows[:i]), default=None)
    dealt = words.withColumn("b", scans.time_band()).repartition(8, "asset_id", "b").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r["count"] for r in dealt) < 2 * 3000 / 8


def test_facets_of_a_packet_are_the_first_that_overlap(spark):
    import random

    from cutledger.operators import search as S

    rng = random.Random(4)
    row = lambda i: (rng.choice(("a", "b", None)), (s := rng.randrange(400)), s + rng.randrange(60), i)
    ranked = [(*row(i), i) for i in range(40)]
    facets = [(*row(i)[:3], f"t{i % 7}") for i in range(300)]
    got = S.packets(spark.createDataFrame(ranked, "asset_id string, s long, e long, segment_id long, query_id long"), spark.createDataFrame(facets, "asset_id string, s long, e long, text string"), 20, 3)
    want = {i: [t for _, t in sorted((fs, t) for fa, fs, fe, t in facets if fa == a and a and fs < e and s < fe)[:3]] for a, s, e, i, _ in ranked}
    assert {r.segment_id: r.facet_texts for r in got.collect()} == want and any(len(v) == 3 for v in want.values())
    # a bucket sends no pair beyond the first: pairs are made within tasks
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan
