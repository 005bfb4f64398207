"""Queries over further operators: ledgers, cards, candidates, plans of removal, joins and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import intervals as T
from ..operators import profile as A
from ..operators import search as S
from ..operators import sequence as Q
from ..operators import work as P
from ..sources import views as V
from ..streaming import feeds
from .registry import Registry
from .search_queries import _SCORE, _top
from .sql import sql
from .work_queries import _drain, _stream

R = Registry()


@R.add("s13_word_units", sql("spans words", " select sp.asset_id, sp.pos, count(*) as n, cast(sum(least(w.e, sp.e) - greatest(w.s, sp.s)) as bigint) as covered from spans sp join words w on w.asset_id = sp.asset_id and w.pos = sp.pos where least(w.e, sp.e) > greatest(w.s, sp.s) group by 1, 2"))
def _(spark, d):
    units = V.words(spark, d).groupBy("asset_id", "pos").agg(F.collect_list(F.struct("text", "s", "e")).alias("units"))
    rows = V.spans(spark, d).join(units, ["asset_id", "pos"]).withColumn("u", P.word_units(F.col("units"), F.col("s"), F.col("e")))
    return rows.where(F.size("u") > 0).select("asset_id", "pos", F.size("u").cast("long").alias("n"), F.aggregate("u", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("covered"))


def _heard(spark, d):
    rows = V.words(spark, d).groupBy("asset_id", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "text", "s", "e", (F.col("i") % 4 / 4).alias("confidence")))).alias("ws"), F.min("s").alias("s"))
    seg = F.struct("pos", "s", (F.col("s") + F.col("pos") * 30).alias("e"), F.concat(F.lit(" t"), F.col("pos").cast("string")).alias("text"), F.transform("ws", lambda w: F.struct(w["text"].alias("text"), w["s"].alias("s"), F.when(w["i"] % 7 > 0, w["e"]).alias("e"), w["confidence"].alias("confidence"))).alias("words"))
    return rows.groupBy("asset_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))


@R.add("s17_explode_asr", sql("words", ", g as (select asset_id, pos, min(s) as s, list({'i': i, 'c': (i % 4)/4.0}) as ws from words group by 1, 2), k as (select *, cast(row_number() over (partition by asset_id order by pos) - 1 as int) as p from g) select asset_id, p as pos, s, greatest(s + pos*30, s + 50) as e, 't' || cast(pos as varchar) as text, (select round(avg(w.c), 4) from (select unnest(list_filter(ws, lambda x: x.i % 7 > 0)) as w)) as confidence from k"))
def _(spark, d):
    return P.explode_asr(_heard(spark, d))[0]


@R.add("s18_ledger", sql("plan_items", """ select 'plan' as kind, plan_id, pos, '{"segment_id":' || cast(segment_id as varchar) || ',"role":"' || role || '"}' as body from plan_items"""))
def _(spark, d):
    return P.ledger(V.plan_items(spark, d).select("plan_id", "pos", "segment_id", "role"), "plan", "plan_id", "pos")


@R.add("s19_json_list", "select event_id, case event_id % 4 when 0 then 'a|b' when 1 then 'plain' when 2 then '' else '' end as joined, case when event_id % 4 = 3 then 'other' else event_type end as named from events")
def _(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, '["a", "b"]').when(i % 4 == 1, "plain").when(i % 4 == 2, "[broken")
    name = F.when(i % 4 == 3, "  ").otherwise(F.col("event_type"))
    return V.table(spark, d, "events").select("event_id", F.array_join(X.json_list(raw), "|").alias("joined"), X.text_or(name, F.lit("other")).alias("named"))


@R.add("p08_completion_marks", "select user_id as asset_id, max(cast(value as int)) > 0 as found from events where event_type <> 'error' group by 1".replace("max(cast(value as int)) > 0", "max(event_id % 3) > 0"))
def _(spark, d):
    ev = V.table(spark, d, "events")
    return P.completion_marks(ev.select(F.col("user_id").alias("asset_id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), (F.col("event_id") % 3).alias("n_found")))


@R.add("p09_usable_segments", sql("segments", " select segment_id from segments where usable and s < case when asset_id in ('src1', 'src2') then 300000 else e end"))
def _(spark, d):
    assets = spark.createDataFrame([("src1", 300_000), ("src2", 300_000)], "asset_id string, duration_ms long")
    return P.usable_segments(V.segments(spark, d), assets).select("segment_id")


@R.add("p13_ready_assets", sql("point_assets", " select asset_id, duration_ms from point_assets where asset_id % 4 > 0 and duration_ms > 1000000 order by asset_id"))
def _(spark, d):
    rows = V.point_assets(spark, d).withColumn("status", F.when(F.col("asset_id") % 4 > 0, "ready").otherwise("failed"))
    return P.eligible_long(rows, 1_000_000).select("asset_id", "duration_ms").orderBy("asset_id")


@R.add("x20_gather_candidates", sql("segments queries", _SCORE + """, f as (select asset_id, s, e from segments where role = 'performance'), v as (select distinct top.query_id, top.segment_id from top join f on f.asset_id = top.asset_id and f.s < top.e and top.s < f.e)
 select query_id, segment_id, cast(row_number() over (partition by query_id order by score + case when v2 is null then 0 else 20 end desc, segment_id) as int) as pos from (select top.query_id, top.segment_id, score, v.segment_id as v2 from top left join v on v.query_id = top.query_id and v.segment_id = top.segment_id)"""))
def _(spark, d):
    from pyspark.sql import Window

    top = _top(spark, d)
    facets = V.segments(spark, d).where("role = 'performance'").select("asset_id", "s", "e", F.lit("").alias("text"))
    some = T.first_overlaps(top.select("asset_id", "s", "e", F.col("segment_id").alias("key")).distinct(), facets, 10_000, 1)
    via = some.select(F.col("key").alias("segment_id")).distinct().withColumn("n", F.lit(1))
    rank = S.candidate_rank(F.col("score"), F.coalesce("n", F.lit(0)), F.lit(False), F.lit(None), F.lit(None))
    rows = top.join(via, "segment_id", "left").withColumn("value", rank)
    return rows.select("query_id", "segment_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("value").desc(), "segment_id")).alias("pos"))


@R.add("a17_context_cards", sql("segments", """, ed as (select segment_id as src, segment_id + 1 as dst from segments where segment_id % 3 = 0 and segment_id + 1 in (select segment_id from segments)), b as (select src as segment_id, dst as other from ed union select dst, src from ed)
 select segment_id, '{"role":"' || role || '","warnings":"' || array_to_string(list_filter([case when e - s > 30000 then 'long_segment' end, case when quality < 5 then 'low_quality' end, case when near is null then 'no_relationships' end], lambda x: x is not null), ',') || '","near":"' || coalesce(near, '') || '"}' as card from segments left join (select segment_id, string_agg(cast(other as varchar), ',' order by other) as near from b group by 1) using (segment_id)"""))
def _(spark, d):
    seg = V.segments(spark, d)
    ids = seg.select(F.col("segment_id").alias("dst"))
    edges = seg.where("segment_id % 3 = 0").select(F.col("segment_id").alias("src"), (F.col("segment_id") + 1).alias("dst")).join(ids, "dst", "left_semi")
    return A.context_cards(seg, edges)


@R.add("a21_review_list", "select event_id as review_id, ts as at, case when event_id % 3 > 0 then cast(event_id % 10 as double) end as score from events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit('{"score": '), (F.col("event_id") % 10).cast("string"), F.lit("}"))).otherwise("none")
    return A.review_list(V.table(spark, d, "events").select(F.col("event_id").alias("review_id"), F.col("ts").alias("at"), raw.alias("raw")))


@R.add("a23_byte_savings", "select cast(sum(length(html)) as bigint) as before, cast(sum(length(split_part(html, '<body>', 2))) as bigint) as after, cast(sum(length(html)) - sum(length(split_part(html, '<body>', 2))) as bigint) as saved from pages")
def _(spark, d):
    body = F.split_part("html", F.lit("<body>"), F.lit(2))
    return A.byte_savings(V.table(spark, d, "pages").select(F.length("html").alias("before"), F.length(body).alias("after")))


@R.add("a25_timeline_items", sql("plan_items", " select plan_id, pos, asset_id, s_name as path from plan_items left join (select s_suppkey, s_name from supplier where s_suppkey % 2 = 0) on s_suppkey = asset_id"))
def _(spark, d):
    assets = V.table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("path"))
    return A.timeline_items(V.plan_items(spark, d).select("plan_id", "pos", "asset_id"), assets).select("plan_id", "pos", "asset_id", "path")


@R.add("q08_sequence_item", sql("iv", """, a as (select asset_id, s, e, flag, case when asset_id % 2 = 0 then cast(60000 as bigint) end as ams, case when asset_id % 3 > 0 then cast(asset_id % 5 * 1000 as bigint) end as target, case when asset_id % 7 > 0 then cast(2500 as bigint) end as cap from iv),
 b as (select *, least(e, coalesce(ams - 50, e)) as en from a), c as (select *, case when ams is not null then least(s, greatest(0, en - 100)) else s end as st from b), g as (select *, greatest(100, en - st) as raw from c), h as (select *, greatest(1000, coalesce(nullif(target, 0), raw)) as goal from g)
 select asset_id, s, e, flag, goal, least(raw, greatest(2000, goal), 8000) as clip, least(coalesce(cap, goal*150//100), en - st) as room from h"""))
def _(spark, d):
    i = F.col("asset_id")
    rows = V.intervals(spark, d).withColumns({"asset_ms": F.when(i % 2 == 0, F.lit(60_000).cast("long")), "target": F.when(i % 3 > 0, i % 5 * 1000), "cap": F.when(i % 7 > 0, F.lit(2500).cast("long"))})
    return Q.sequence_item(rows, 8000).select("asset_id", "s", "e", "flag", "goal", "clip", "room")


@R.add("q10_enumerate_slots", sql("segments queries", _SCORE + ", m as (select *, row_number() over (partition by query_id order by rank) as k from top where contains(lower(summary), 'the')) select query_id, cast(row_number() over (partition by query_id order by asset_id, s, segment_id) - 1 as int) as pos, segment_id from m where k <= 4"))
def _(spark, d):
    return Q.enumerate_slots(_top(spark, d), F.contains(F.lower("summary"), F.lit("the")), 4, chronological=True)


@R.add("q20_candidate_items", sql("segments queries", _SCORE + """, sl as (select segment_id, n_chars as score from (select doc_id as segment_id, n_chars from documents) where segment_id % 3 = 0), h as (select distinct query_id, segment_id from top), o as (select h.query_id, sl.* from h join sl using (segment_id)),
 b as (select * from o union all select q.query_id, t.* from (select distinct query_id from h where query_id not in (select query_id from o)) q, (select * from sl order by score desc, segment_id limit 20) t) select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, segment_id) as int) as rank, segment_id from b) where rank <= 20"""))
def _(spark, d):
    selects = V.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("segment_id"), F.col("n_chars").alias("score"))
    return Q.candidate_items(_top(spark, d).select("query_id", "segment_id"), selects)


@R.add("q34_planned_items", sql("plan_items", " select plan_id, pos, asset_id, case when asset_id % 2 = 0 then asset_id*1000 end as duration_ms, case when asset_id % 2 = 0 and asset_id % 3 > 0 then 25.0 else 30.0 end::double as fps from plan_items"))
def _(spark, d):
    i = F.col("asset_id")
    assets = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id")).where("asset_id % 2 = 0").withColumns({"duration_ms": i * 1000, "fps": F.when(i % 3 > 0, F.lit(25.0))})
    return Q.planned_items(V.plan_items(spark, d).select("plan_id", "pos", "asset_id"), assets).select("plan_id", "pos", "asset_id", "duration_ms", "fps")


@R.add("q37_resolve_parent_plan", "with n as (select arg_max(o_orderkey, (o_orderdate, o_orderkey)) as p from orders where o_orderkey % 3 = 0) select o_orderkey as request_id, case o_orderkey % 4 when 0 then o_orderkey when 1 then null when 2 then (select p from n) else o_orderkey + 1 end as plan_id, case when o_orderkey % 4 = 1 then 'missing' else 'ok' end as status from orders where o_orderkey + 1 <= (select max(o_orderkey) from orders)")
def _(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    plans = o.select(k.alias("plan_id"), F.col("o_orderdate").alias("created"), (k % 3 == 0).alias("ok"), F.lit(2).alias("n_items"))
    lines = o.select((k * 10).alias("timeline_id"), k.alias("plan_id"))
    parent = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.lit("no such plan")).when(k % 4 == 3, F.concat(F.lit("timeline:"), ((k + 1) * 10).cast("string")))
    top = o.agg(F.max(k).alias("m"))
    requests = o.join(F.broadcast(top), k + 1 <= F.col("m")).select(k.alias("request_id"), parent.alias("parent"))
    return Q.resolve_parent_plan(requests, plans, lines)


@R.add("w07_thirds", sql("plan_items", " select plan_id, pos, case when i <= greatest(1, n // 3) then 'opening' when i > n - greatest(1, n // 3) then 'ending' else 'middle' end as region from (select *, row_number() over (partition by plan_id order by pos) as i, count(*) over (partition by plan_id) as n from plan_items)"))
def _(spark, d):
    return Q.third(V.plan_items(spark, d)).select("plan_id", "pos", "region")


@R.add("j03_latest_source", sql("observations", " select o.asset_id, o.obs_id, l.facet as source from observations o left join (select asset_id, arg_max(facet, (s, obs_id)) as facet from observations where facet <> 'view' group by 1) l using (asset_id) where o.facet = 'view'"))
def _(spark, d):
    obs = V.observations(spark, d)
    last = A.latest(obs.where("facet <> 'view'").select("asset_id", "facet", "s", "obs_id"), "asset_id", "s", "obs_id").select("asset_id", F.col("facet").alias("source"))
    return obs.where("facet = 'view'").select("asset_id", "obs_id").join(last, "asset_id", "left")


@R.add("j05_semi_and_anti", "select c_custkey, c_custkey in (select o_custkey from orders) as ordered from customer")
def _(spark, d):
    c, o = V.table(spark, d, "customer").select("c_custkey"), V.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("ordered", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("ordered", F.lit(False)))


@R.add("j10_overlay_pairs", sql("plan_items", " select a.plan_id, a.pos, b.pos as primary_pos from plan_items a join plan_items b on b.plan_id = a.plan_id and b.pos = a.asset_id % 7 where a.role = 'A'"))
def _(spark, d):
    items = V.plan_items(spark, d)
    meta = F.to_json(F.struct((F.col("asset_id") % 7).alias("overlay_of")))
    over = items.where("role = 'A'").select("plan_id", "pos", F.from_json(meta, "struct<overlay_of:bigint>")["overlay_of"].alias("primary_pos"))
    return over.join(items.select("plan_id", F.col("pos").alias("primary_pos")), ["plan_id", "primary_pos"])


@R.add("g02_relationship_type", "select vec_id, case when vec_id % 10 >= 8 then 'duplicates' when label = 3 then 'echoes_same_source' else 'echoes' end as type from embeddings")
def _(spark, d):
    rows = V.table(spark, d, "embeddings")
    return rows.select("vec_id", G.relationship_type((F.col("vec_id") % 10) / 10, F.col("label") == 3, 0.8).alias("type"))


@R.add("r04_pair_stream", """with o as (select user_id as asset_id, event_id, epoch_us(ts) // 1000 as t, event_type from events where event_type in ('click', 'view') union all select user_id, 9223372036854775807, epoch_us(max(ts)) // 1000 + 3600000, 'end' from events group by 1),
 p as (select *, lag(event_type) over w as pe, lag(t) over w as pt from o window w as (partition by asset_id order by t, event_id))
 select asset_id, case when pe = 'click' then pt else 0 end as s, t as e from p where event_type = 'view' or event_type = 'end' and pe = 'click'""")
def _(spark, d):
    ends = V.table(spark, d, "events").groupBy(F.col("user_id").alias("asset_id")).agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 1 hour")).alias("ts"))
    ends = ends.select("asset_id", F.lit(2**63 - 1).alias("obs_id"), "ts", F.lit("end").alias("reason"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _drain(spark, feeds.pair_stream, d, ends)
    finally:
        spark.conf.set(name, before)


@R.add("r05_join_streams", "select a.user_id as asset_id, epoch_us(a.ts) // 1000 as t, epoch_us(b.ts) // 1000 as start from events a join events b on b.user_id = a.user_id and b.event_type = 'click' and a.ts >= b.ts and a.ts < b.ts + interval 5 minutes")
def _(spark, d):
    def build(stream):
        return feeds.join_streams(stream.select("asset_id", "ts"), _stream(spark, d).where("reason = 'gap_start'").select("asset_id", F.col("ts").alias("start")), "10 minutes", "5 minutes")

    return _drain(spark, build, d).select("asset_id", F.unix_millis("ts").alias("t"), F.unix_millis("start").alias("start"))
