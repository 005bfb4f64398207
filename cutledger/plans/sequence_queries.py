"""Queries over sequence planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as Q
from ..sources import views as V
from .registry import Registry
from .sql import sql

R = Registry()

_BEATS = """select o_orderkey as plan_id, k as beat_no, case when k = 1 then 'b3-b' || cast(3 + o_orderkey % 4 as varchar) else 'beat' || cast(k as varchar) end as beat_id, case k when 0 then 'plain' when 1 then 'repeat' else 'alternate' end as pattern,
 ['a','b','c'] as lanes, case when k = 2 then cast(o_orderkey % 6 as int) end as cnt, cast(o_orderkey*37 % 9000 as bigint) as lo, case when k > 0 then cast(o_orderkey*91 % 11000 as bigint) end as hi from orders, (values (0),(1),(2)) t(k)"""


def _beats(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("beat_no"))
    k, p = F.col("beat_no"), F.col("plan_id")
    return o.select(
        "plan_id", "beat_no", F.when(k == 1, F.concat(F.lit("b3-b"), (3 + p % 4).cast("string"))).otherwise(F.concat(F.lit("beat"), k.cast("string"))).alias("beat_id"),
        F.when(k == 0, "plain").when(k == 1, "repeat").otherwise("alternate").alias("pattern"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("lanes"),
        F.when(k == 2, (p % 6).cast("int")).alias("count"), (p * 37 % 9000).cast("long").alias("lo"), F.when(k > 0, (p * 91 % 11_000).cast("long")).alias("hi"),
    )


_SLOTS = f""", beats as ({_BEATS}), tt as (select *, cast(case when pattern = 'plain' then 1 when coalesce(cnt,0) <> 0 then cnt when pattern = 'repeat' then plan_id % 4 + 1 else 6 end as int) as total from beats), ex as (select *, unnest(generate_series(0, total - 1)) as i from tt),
 slots as (select plan_id, cast(row_number() over (partition by plan_id order by beat_no, i) - 1 as int) as pos, case when total > 1 then beat_id || '#' || cast(i + 1 as varchar) else beat_id end as slot_id, beat_id, cast(i + 1 as int) as occurrence, total, case when pattern = 'alternate' then lanes[i % 3 + 1] else 'a' end as lane,
 cast(greatest(0, least(10000, case when hi is null or total <= 1 then lo else lo + floor((hi - lo)*i / greatest(total - 1, 1)) end)) as bigint) as intensity from ex)"""


@R.add("q01_expand_beats", sql("queries", _SLOTS + " select * from slots"))
def _(spark, d):
    return Q.expand_beats(_beats(spark, d))


@R.add("q03_intensity_weight", sql("queries", _SLOTS + " select plan_id, pos, 16000 - intensity as weight from slots"))
def _(spark, d):
    return Q.expand_beats(_beats(spark, d)).select("plan_id", "pos", Q.intensity_weight(F.col("intensity")).alias("weight"))


_ROLES = "['hook','reaction','performance','emotion','payoff','context']"
_TARGETS = f""", it0 as (select *, {_ROLES}[cast(segment_id % 6 + 1 as int)] as r6, cast(20000 as bigint) as budget, case when segment_id % 2 = 0 then cast(segment_id*13 % 10001 as bigint) end as intensity from plan_items),
 it1 as (select *, case when intensity is not null then 16000 - intensity else case r6 when 'hook' then 8000 when 'reaction' then 8000 when 'performance' then 11000 when 'emotion' then 12000 when 'payoff' then 14000 else 10000 end end as weight, case when intensity is not null then 150 else case r6 when 'hook' then 100 when 'reaction' then 100 when 'performance' then 150 when 'emotion' then 175 when 'payoff' then 200 else 150 end end as mult from it0),
 tg as (select plan_id, pos, weight, cast(greatest(1500, floor(cast(budget*weight as double) / sum(weight) over (partition by plan_id))) as bigint) as target, mult from it1), tgt as (select plan_id, pos, cast(weight as bigint) as weight, target, target*mult//100 as cap from tg)"""


@R.add("q04_slot_targets", sql("plan_items", _TARGETS + " select * from tgt"))
def _(spark, d):
    rows = V.plan_items(spark, d).drop("target", "cap", "role")
    role = F.element_at(F.array(*map(F.lit, ["hook", "reaction", "performance", "emotion", "payoff", "context"])), (F.col("segment_id") % 6 + 1).cast("int"))
    rows = rows.withColumns({"role": role, "budget": F.lit(20_000).cast("long"), "intensity": F.when(F.col("segment_id") % 2 == 0, F.col("segment_id") * 13 % 10_001)})
    return Q.slot_targets(rows).select("plan_id", "pos", "weight", "target", "cap")


def _fit_sql() -> str:
    out = ", f0 as (select *, least(target, cap) as fit, cast(9000 as bigint) as budget from plan_items)"
    for i in range(5):
        out += f", s{i} as (select *, sum(fit) over (partition by plan_id) as tot from f{i}), f{i + 1} as (select * exclude (tot, fit), cast(case when tot <= 0 or abs(tot - budget) < 50 then fit else least(cap, greatest(500, fit*budget // greatest(tot, 1))) end as bigint) as fit from s{i})"
    return out


_END = _fit_sql() + """, e0 as (select *, row_number() over (partition by plan_id order by pos desc) = 1 as last from f5), e1 as (select *, max(case when last then least(2000, cap) end) over w as mn, max(case when last then fit end) over w as nw, sum(case when not last then greatest(0, fit - 1000) else 0 end) over w as pool from e0 window w as (partition by plan_id)),
 ended as (select plan_id, pos, segment_id, asset_id, cap, cast(case when mn - nw <= 0 then fit when last then mn when pool <= 0 then fit else greatest(1000, fit - cast((mn - nw) as bigint)*greatest(0, fit - 1000) // greatest(cast(pool as bigint), 1)) end as bigint) as fit from e1),
 timed as (select *, cast(row_number() over w - 1 as int) as "index", cast(sum(fit) over w as bigint) as "until", cast(sum(fit) over w as bigint) - fit as "at" from ended window w as (partition by plan_id order by pos))"""


def _items(spark, d):
    return V.plan_items(spark, d).withColumn("budget", F.lit(9000).cast("long"))


@R.add("q05_fit_durations", sql("plan_items", _fit_sql() + " select plan_id, pos, fit from f5"))
def _(spark, d):
    return Q.fit_durations(_items(spark, d)).select("plan_id", "pos", "fit")


@R.add("q06_reserve_ending", sql("plan_items", _END + " select plan_id, pos, fit from ended"))
def _(spark, d):
    return Q.reserve_ending(Q.fit_durations(_items(spark, d))).select("plan_id", "pos", "fit")


@R.add("q07_assign_timing", sql("plan_items", _END + ' select plan_id, pos, fit, "index", "at", "until" from timed'))
def _(spark, d):
    return Q.assign_timing(_items(spark, d)).select("plan_id", "pos", "fit", "index", "at", "until")


#: Two word units of an item: 700 to 1600 and 1900 to 3000 ms after its start.
_UNITS = """, u1 as (select *, case when {f} > 700 and {f} < 1600 then case when 1700 <= cap then 1700 else 650 end else {f} end as f1 from {t}), u2 as (select * exclude (f1, fit), cast(case when f1 > 1900 and f1 < 3000 then case when 3100 <= cap then 3100 else 1850 end else f1 end as bigint) as fit from u1)"""


def _spoken(spark, d):
    start = (F.col("segment_id") * 37 % 60_000).cast("long")
    unit = lambda a, b: F.struct((start + a).alias("s"), (start + b).alias("e"))
    return _items(spark, d).withColumns({"start": start, "units": F.array(unit(700, 1600), unit(1900, 3000))})


@R.add("q07_guarded_timing", sql("plan_items", _END + _UNITS.format(f="fit", t="ended") + ' select plan_id, pos, fit, cast(sum(fit) over w as bigint) - fit as "at" from u2 window w as (partition by plan_id order by pos)'))
def _(spark, d):
    return Q.assign_timing(_spoken(spark, d)).select("plan_id", "pos", "fit", "at")


@R.add("q09_shot_share", sql("plan_items", " select plan_id, pos, greatest(500, target // count(*) over (partition by plan_id, asset_id % 3)) as share from plan_items"))
def _(spark, d):
    return Q.shot_share(V.plan_items(spark, d).withColumn("slot_id", F.col("asset_id") % 3)).select("plan_id", "pos", "share")


@R.add("q11_validate_ordering", sql("plan_items", """, it as (select plan_id, pos, asset_id % 4 as beat_id from plan_items), bt as (select plan_id, beat_id, min(pos) as lo, max(pos) as hi from it group by 1, 2), rl as (select plan_id, kind, a, b from (select distinct plan_id from it), (values ('before',0,1),('after',2,1),('adjacent',0,3),('never_adjacent',1,3)) r(kind, a, b)),
 nr as (select rl.*, x.lo as alo, x.hi as ahi, y.lo as blo, y.hi as bhi, exists (select 1 from it p join it q on p.plan_id = q.plan_id and abs(p.pos - q.pos) = 1 where p.plan_id = rl.plan_id and p.beat_id = a and q.beat_id = b) as near from rl join bt x on x.plan_id = rl.plan_id and x.beat_id = a join bt y on y.plan_id = rl.plan_id and y.beat_id = b)
 select plan_id, kind, a, b from nr where case kind when 'before' then ahi >= blo when 'after' then alo <= bhi when 'adjacent' then not near else near end"""))
def _(spark, d):
    items = V.plan_items(spark, d).select("plan_id", "pos", (F.col("asset_id") % 4).alias("beat_id"))
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, a, b in (("before", 0, 1), ("after", 2, 1), ("adjacent", 0, 3), ("never_adjacent", 1, 3))])
    return Q.validate_ordering(items, items.select("plan_id").distinct().select("plan_id", F.inline(rules)))


@R.add("q12_continuity_warnings", sql("plan_items", " select plan_id, pos, w as warning from (select plan_id, pos, unnest(list_filter([case when asset_id = pa then 'redundant_source' end, case when segment_id % 5 = 0 and k > 1 then 'check_audio' end], lambda x: x is not null)) as w from (select *, lag(asset_id) over (partition by plan_id order by pos) as pa, row_number() over (partition by plan_id order by pos) as k from plan_items))"))
def _(spark, d):
    return Q.continuity_warnings(V.plan_items(spark, d).withColumn("check_audio", F.col("segment_id") % 5 == 0))


_SIZES = "['extreme_close_up','close_up','medium','wide','extreme_wide']"


@R.add("q13_pair_features", sql("plan_items", f""", it as (select plan_id, pos, case when segment_id % 6 > 0 then cast(segment_id % 6 as bigint) end as sz, case when segment_id % 7 > 0 then cast(segment_id % 11 as bigint) end as en, role as st, case when segment_id % 3 > 0 then cast(segment_id % 3 as varchar) end as ln, ['left','right','up',null,null][cast(segment_id % 5 + 1 as int)] as mo from plan_items), p as (select *, lag(sz) over w as psz, lag(en) over w as pen, lag(st) over w as pst, lag(ln) over w as pln, lag(mo) over w as pmo, lag(pos) over w as pp from it window w as (partition by plan_id order by pos))
 select plan_id, pos, sz - psz as shot_delta, en - pen as energy_delta, st = pst as setting_match, mo = pmo as motion_match, case when ln is null and pln is null then 'none' when ln = pln then 'same' else 'other' end as lane_relation from p where pp is not null"""))
def _(spark, d):
    from ..functions.text import SHOT_SIZES, strings

    seg = F.col("segment_id")
    rows = V.plan_items(spark, d).withColumns({
        "shot_size": F.when(seg % 6 > 0, F.get(strings(SHOT_SIZES), (seg % 6 - 1).cast("int"))), "energy": F.when(seg % 7 > 0, seg % 11), "setting": F.col("role"), "motion": F.get(F.array(F.lit("pans LEFT slowly"), F.lit("moves right."), F.lit("tilt-up"), F.lit("static"), F.lit(None)), (seg % 5).cast("int")), "lane": F.when(seg % 3 > 0, (seg % 3).cast("string")),
    })
    return Q.pair_features(rows)


@R.add("q14_continuity_compatible", sql("plan_items", " select plan_id, pos, (asset_id % 3 = pa % 3) and (role = pr or segment_id % 2 = ps % 2) as ok from (select *, lag(asset_id) over w as pa, lag(role) over w as pr, lag(segment_id) over w as ps from plan_items window w as (partition by plan_id order by pos)) where pa is not null"))
def _(spark, d):
    tokens = F.create_map(F.lit("place"), F.array((F.col("asset_id") % 3).cast("string")), F.lit("look"), F.array("role", (F.col("segment_id") % 2).cast("string")))
    rows = V.plan_items(spark, d).withColumn("m", tokens).withColumn("before", F.lag("m").over(Q.by_pos())).where("before is not null")
    return rows.select("plan_id", "pos", Q.continuity_compatible(F.col("before"), F.col("m")).alias("ok"))


@R.add("q15_novelty_assign")
def _(spark, d):
    items = V.plan_items(spark, d)
    more = F.explode(F.array(*[F.struct((F.col("segment_id") % 50 + k * 7).alias("segment_id"), ((F.col("asset_id") + k) % 9).alias("asset_id"), (F.col("target") % 97 + k * 5).alias("score")) for k in range(4)]))
    return Q.novelty_assign(items.select("plan_id", "pos", more.alias("c")).select("plan_id", "pos", "c.*").dropDuplicates(["plan_id", "pos", "segment_id"]))


@R.add("q16_pin_anchors", sql("plan_items", """, sl as (select plan_id, pos, row_number() over (partition by plan_id order by pos) - 1 as i, count(*) over (partition by plan_id) as n from plan_items), pl as (select plan_id, max(n) as n from sl group by 1),
 fx0 as (select plan_id, n, 0 as a0, n - 1 as a2, least(1, n - 1) as b4 from pl),
 fx1 as (select *, case when b4 not in (a0, a2) then b4 end as a4, least(coalesce(case when b4 not in (a0, a2) then b4 end, 0) + 1, n - 1) as b5 from fx0),
 fx as (select plan_id, 0 as k, a0 as i from fx1 union all select plan_id, 2, a2 from fx1 union all select plan_id, 4, a4 from fx1 union all select plan_id, 5, case when b5 not in (a0, a2) and b5 is distinct from a4 then b5 end from fx1),
 fp as (select fx.plan_id, fx.plan_id*10 + k as anchor_id, pos from fx left join sl on sl.plan_id = fx.plan_id and sl.i = fx.i),
 fr as (select plan_id, pos, row_number() over (partition by plan_id order by pos) as k from sl where not exists (select 1 from fp where fp.plan_id = sl.plan_id and fp.pos = sl.pos)),
 fl as (select plan_id, plan_id*10 + c as anchor_id, k from pl, (values (1, 1), (3, 2)) t(c, k)) select plan_id, anchor_id, pos from fp union all select fl.plan_id, anchor_id, pos from fl left join fr using (plan_id, k)"""))
def _(spark, d):
    slots = V.plan_items(spark, d).select("plan_id", "pos")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("position"), F.lit(n).alias("description")) for k, (p, n) in enumerate((("first", "opening"), ("anywhere", "b"), ("last", "close"), ("anywhere", "d"), ("after: opening", "e"), ("after:e", "f")))])
    anchors = slots.select("plan_id").distinct().select("plan_id", F.inline(kinds)).select("plan_id", (F.col("plan_id") * 10 + F.col("k")).alias("anchor_id"), "position", "description")
    return Q.pin_anchors(slots, anchors)


@R.add("q17_overlay_candidates", sql("plan_items", " select plan_id, pos, segment_id from (select i.plan_id, i.pos, p.segment_id, row_number() over (partition by i.plan_id, i.pos order by case when p.segment_id % 3 = 0 then 0 when p.segment_id % 3 = 1 then 1 else 2 end, p.target desc, p.segment_id) as r from plan_items i join plan_items p on p.plan_id = i.plan_id and p.segment_id <> i.segment_id) where r = 1"))
def _(spark, d):
    items = V.plan_items(spark, d)
    pool = items.select("plan_id", "segment_id", (F.col("segment_id") % 3 == 0).alias("voiceless"), (F.col("segment_id") % 3 == 1).alias("visual"), F.col("target").alias("score"))
    return Q.overlay_candidates(items, pool)


@R.add("q18_overlay_fit", sql("iv", """ select asset_id, s, e, vs as video_s, vs + length as video_e from (select *, greatest(s, least(coalesce(snap_s, s), en - length)) as vs from (select *, least(e, coalesce(asset_ms - 50, e)) as en from (select asset_id, s, e, case when asset_id % 2 = 0 then cast(60000 as bigint) end as asset_ms, case when asset_id % 3 = 0 then s + 700 end as snap_s, cast(2000 as bigint) as length from iv)) where en - s + 10 >= length)"""))
def _(spark, d):
    rows = V.intervals(spark, d).select("asset_id", "s", "e", F.when(F.col("asset_id") % 2 == 0, F.lit(60_000)).alias("asset_ms"), F.when(F.col("asset_id") % 3 == 0, F.col("s") + 700).alias("snap_s"), F.lit(2000).alias("length"))
    return Q.overlay_fit(rows).select("asset_id", "s", "e", "video_s", "video_e")


@R.add("q19_timeline_fill", sql("iv", ', r as (select asset_id as query_id, s, e, row_number() over (partition by asset_id order by e - s desc, s, flag) as rank from iv), w as (select *, least(6000, greatest(0, e - s)) as want from r), a as (select *, sum(want) over (partition by query_id order by rank) - want as at0 from w where want > 0) select query_id, cast(rank as int) as rank, cast(least(want, 20000 - at0) as bigint) as length, cast(at0 as bigint) as "at" from a where at0 < 20000'))
def _(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("asset_id").orderBy((F.col("e") - F.col("s")).desc(), "s", "flag")
    rows = V.intervals(spark, d).withColumn("rank", F.row_number().over(order)).withColumnRenamed("asset_id", "query_id")
    return Q.timeline_fill(rows, 20_000, 6000)


_AUDIO = "['music_bed','clean_dialogue','abrupt_song_change','ambient']"


def _flagged(spark, d):
    seg = F.col("segment_id")
    flags = F.array_compact(F.array(F.when(seg % 11 == 0, F.lit("abrupt_audio_or_no_audio")), F.when(seg % 5 == 0, F.lit("check_audio_transition"))))
    audio = F.element_at(F.array(*map(F.lit, ["music_bed", "clean_dialogue", "abrupt_song_change", "ambient"])), (seg % 4 + 1).cast("int"))
    return V.plan_items(spark, d).withColumns({"flags": flags, "audio": audio, "asset_id": F.col("asset_id") % 6})


@R.add("q22_decide_transition", sql("plan_items", f""", it as (select plan_id, pos, asset_id % 6 as a, {_AUDIO}[cast(segment_id % 4 + 1 as int)] as au, segment_id % 11 = 0 as ab, segment_id % 5 = 0 as ck from plan_items), p as (select *, lag(a) over w as pa, lag(au) over w as pau, lag(ab) over w as pab, lag(ck) over w as pck, lag(pos) over w as pp from it window w as (partition by plan_id order by pos)),
 r as (select plan_id, pos, case when pp is null then 0 when a = pa then 1 when ab or pab then 2 when au in ('music_bed','abrupt_song_change') and pau in ('music_bed','abrupt_song_change') then 3 when (ck or pck) and au <> 'clean_dialogue' then 4 when au = 'clean_dialogue' or pau = 'clean_dialogue' then 5 else 6 end as k from p)
 select plan_id, pos, case when k between 1 and 4 then 'crossfade' else 'cut' end as kind, case k when 1 then 350 when 2 then 300 when 3 then 400 when 4 then 400 else 0 end as ms, ['opening','same source','abrupt audio','music to music','flagged audio','dialogue','no risk'][k + 1] as why from r"""))
def _(spark, d):
    return Q.decide_transition(_flagged(spark, d))


@R.add("q23_decide_caption", sql("segments", " select segment_id, case when trim(summary) = '' then false when quality = 1 and has_card then true else role in ('context','archive') end as burn from segments"))
def _(spark, d):
    return V.segments(spark, d).select("segment_id", Q.decide_caption(F.trim("summary"), (F.col("quality") == 1) & F.col("has_card"), F.col("role")).alias("burn"))


_RET = _END + ", th as (select *, row_number() over (partition by plan_id order by pos) as i, count(*) over (partition by plan_id) as n from ended), rt as (select plan_id, pos, i, segment_id, asset_id, cap, case when i > greatest(1, n // 3) and i <= n - greatest(1, n // 3) then least(cap, greatest(500, fit*150//100)) else fit end as fit, i > greatest(1, n // 3) and i <= n - greatest(1, n // 3) as changed from th)"


@R.add("q27_retime", sql("plan_items", _RET + " select plan_id, pos, fit, changed from rt"))
def _(spark, d):
    return Q.retime(Q.assign_timing(_items(spark, d)), "middle", 150).select("plan_id", "pos", "fit", "changed")


@R.add("q27_guarded_retime", sql("plan_items", _END + ", th as (select *, row_number() over (partition by plan_id order by pos) as i, count(*) over (partition by plan_id) as n from ended), hit as (select plan_id, pos, cap, i <= greatest(1, n // 3) as changed, fit as was, least(cap, greatest(500, fit*150//100)) as fit from th)" + _UNITS.format(f="fit", t="hit") + " select plan_id, pos, case when changed then fit else was end as fit, changed from u2"))
def _(spark, d):
    items = _spoken(spark, d)
    timed = Q.reflow(Q.reserve_ending(Q.fit_durations(items)))
    return Q.retime(timed, "opening", 150).select("plan_id", "pos", "fit", "changed")


@R.add("q28_swap_ending", sql("plan_items", _END + " select plan_id, pos, case when pos = last then case when pos % 2 = 0 then segment_id + 500000 else segment_id + 300000 end else segment_id end as segment_id, pos = last as changed from (select plan_id, row_number() over (partition by plan_id order by pos) as pos, segment_id, count(*) over (partition by plan_id) as last from ended)"))
def _(spark, d):
    items = Q.assign_timing(_items(spark, d))
    last = items.groupBy("plan_id").agg(F.max_by("segment_id", "pos").alias("s"), F.count("*").alias("n"))
    # the best substitute of every second plan is the ending that it has
    best = F.when(F.col("n") % 2 == 0, F.col("s")).otherwise(F.col("s") + 300_000)
    ranked = last.select("plan_id", F.posexplode(F.array(best, F.col("s") + 500_000)).alias("rank", "segment_id"))
    return Q.apply_script(items, [("swap_ending", ranked)]).select("plan_id", "pos", "segment_id", "changed")


_SCRIPT = _RET + """, d2 as (select *, row_number() over (partition by plan_id order by i) as p2 from rt where i <> 2), r2 as (select plan_id, p2, case when p2 = 1 then segment_id + 1000000 else segment_id end as segment_id, cap, fit, changed or p2 = 1 as changed from d2),
 ins as (select plan_id, cast(p2 as double) as p2, segment_id, fit, changed from r2 union all select plan_id, 1.5, max(segment_id), cast(1234 as bigint), true from plan_items where plan_id in (select plan_id from r2) group by plan_id), fin as (select plan_id, row_number() over (partition by plan_id order by p2) as pos, segment_id, fit, changed from ins)"""


def _edited(spark, d):
    items = Q.assign_timing(_items(spark, d))
    other = V.plan_items(spark, d)
    first = Q.reflow(items).where("index = 0")
    swap = first.select("plan_id", (F.col("segment_id") + 1_000_000).alias("segment_id"))
    # the substitute is that of the item which is first once the second is gone: the first stays first
    extra = other.groupBy("plan_id").agg(F.max("segment_id").alias("segment_id")).select("plan_id", "segment_id", F.lit(0).cast("long").alias("asset_id"), F.lit(9999).cast("long").alias("cap"), F.lit(1234).cast("long").alias("fit"))
    return items, Q.apply_script(items, [("retime", "middle", 150), ("drop", 2), ("replace", 1, swap), ("insert", 2, extra)])


@R.add("q28_apply_script", sql("plan_items", _SCRIPT + " select plan_id, pos, segment_id, fit, changed from fin"))
def _(spark, d):
    return _edited(spark, d)[1].select("plan_id", "pos", "segment_id", "fit", "changed")


@R.add("q29_reflow", sql("plan_items", ' select plan_id, pos, cast(row_number() over w - 1 as int) as "index", cast(sum(target) over w as bigint) as "until", cast(sum(target) over w as bigint) - target as "at" from plan_items window w as (partition by plan_id order by pos)'))
def _(spark, d):
    return Q.reflow(V.plan_items(spark, d), "target").select("plan_id", "pos", "index", "until", "at")


@R.add("q30_plan_diff", sql("plan_items", _SCRIPT + """, b as (select plan_id, i as pos, segment_id, fit from th), j as (select coalesce(b.plan_id, f.plan_id) as plan_id, b.pos as bp, f.pos as fp, b.segment_id = f.segment_id and b.fit = f.fit as same from b full join fin f on f.plan_id = b.plan_id and f.pos = b.pos)
 select plan_id, count(*) filter (where not same) as n_changed, count(*) filter (where same) as n_kept, count(*) filter (where bp is null) as n_added, count(*) filter (where fp is null) as n_removed from j group by 1"""))
def _(spark, d):
    before, after = _edited(spark, d)
    ranked = before.select("plan_id", (F.col("index") + 1).cast("long").alias("pos"), "segment_id", "fit")
    return Q.plan_diff(ranked, after, "segment_id", "fit")


@R.add("q35_explain_items", sql("plan_items", " select plan_id, pos, role || ' beat: ' || case when segment_id % 3 = 0 then 'selected for the directive' when segment_id % 3 = 1 then 'r1' else 'r1; r2' end || '. ' || case when row_number() over (partition by plan_id order by pos) = 1 then 'Open cleanly.' when segment_id % 5 = 0 then 'Crossfade the audio.' else 'Plain cut.' end as why from plan_items"))
def _(spark, d):
    rows = _flagged(spark, d).withColumn("reasons", F.slice(F.array(F.lit("r1"), F.lit("r2"), F.lit("r3")), F.lit(1), (F.col("segment_id") % 3).cast("int")))
    return Q.explain_items(rows)


@R.add("q36_resolve_item_ref", sql("plan_items", """, it as (select plan_id, row_number() over (partition by plan_id order by pos) - 1 as "index", count(*) over (partition by plan_id) as n, 's' || cast(pos as varchar) as slot_id, 'b' || cast(asset_id % 3 as varchar) as beat_id from plan_items), rf as (select distinct plan_id, k as ref_id, ref from it, (values (0,'-1'),(1,'0'),(2,'b1'),(3,'s3'),(4,'99')) t(k, ref))
 select rf.plan_id, ref_id, case when ref = '-1' then (select max("index") from it where it.plan_id = rf.plan_id) when ref = '0' then 0 when ref = '99' then null else (select min("index") from it where it.plan_id = rf.plan_id and (slot_id = ref or beat_id = ref)) end as pos from rf"""))
def _(spark, d):
    items = V.plan_items(spark, d).select("plan_id", "pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("slot_id"), F.concat(F.lit("b"), (F.col("asset_id") % 3).cast("string")).alias("beat_id"), F.lit("-").alias("segment_id"))
    kinds = F.array(*[F.struct(F.lit(k).alias("ref_id"), F.lit(r).alias("ref")) for k, r in enumerate(("-1", "0", "b1", "s3", "99"))])
    return Q.resolve_item_ref(items.select("plan_id").distinct().select("plan_id", F.inline(kinds)), items)
