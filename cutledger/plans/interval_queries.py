"""Queries over the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as T
from ..sources import views as V
from ..sources.shared import written
from .registry import Registry
from .sql import sql

R = Registry()
W = 10_000

_WINDOWS = ", win as (select asset_id, unnest(generate_series(cast(0 as bigint), cast(greatest(1, ceil(duration_ms/10000.0)) as bigint) - 1)) as win, duration_ms from {a}), windows as (select asset_id, win, win*10000 as s, least((win+1)*10000, duration_ms) as e from win)"


@R.add("t01_fixed_windows", sql("iv_assets", _WINDOWS.format(a="iv_assets") + " select * from windows"))
def _(spark, d):
    return T.fixed_windows(V.interval_assets(spark, d), W)


_RATIO = "least(10000, cast(floor((coalesce(sum(least(w.e, r.e) - greatest(w.s, r.s)) filter (where r.s is not null), 0)*20000 + (w.e - w.s)) / (2*(w.e - w.s))) as bigint))"


@R.add("t02_coverage_ratio", sql("iv iv_assets", _WINDOWS.format(a="iv_assets") + f" select w.asset_id, w.win, w.s, w.e, {_RATIO} as ratio from windows w left join iv r on r.asset_id = w.asset_id and w.s < r.e and r.s < w.e group by w.asset_id, w.win, w.s, w.e"))
def _(spark, d):
    return T.coverage_ratio(T.fixed_windows(V.interval_assets(spark, d), W), V.intervals(spark, d), W)


_ACT = _WINDOWS.format(a="iv_assets") + f""", sil as (select w.asset_id, w.win, {_RATIO} as silence from windows w left join (select * from iv where flag = 'R') r on r.asset_id = w.asset_id and w.s < r.e and r.s < w.e group by w.asset_id, w.win, w.s, w.e),
 act as (select asset_id, win, asset_id % 5 <> 0 as has_audio, silence, case when asset_id % 5 <> 0 then 10000 - silence end as active from sil)"""


def _activity(spark, d):
    windows = T.fixed_windows(V.interval_assets(spark, d), W).withColumn("has_audio", F.col("asset_id") % 5 != 0)
    return T.window_activity(windows, V.intervals(spark, d).where("flag = 'R'"), W)


@R.add("t03_window_activity", sql("iv iv_assets", _ACT + " select asset_id, win, has_audio, silence, active, coalesce(active, 0) as priority from act"))
def _(spark, d):
    return _activity(spark, d).select("asset_id", "win", "has_audio", "silence", "active", "priority")


@R.add("t04_window_labels", sql("iv iv_assets", _ACT + """ select asset_id, win, 'no_audio' as label, cast(10000 as bigint) as score, 'review' as action from act where not has_audio
 union all select asset_id, win, 'silence', silence, 'cut_candidate' from act where has_audio and silence >= 8000
 union all select asset_id, win, 'audio_active', active, 'keep_candidate' from act where has_audio and active >= 2000
 union all select asset_id, win, 'high_energy', active, 'review' from act where has_audio and active >= 9500"""))
def _(spark, d):
    return T.window_labels(_activity(spark, d))


_PAIRS = """, gaps as (select *, lag(reason) over w as before, lag(t) over w as since, lead(reason) over w as nxt from cut_points where reason in ('gap_start','gap_end') window w as (partition by asset_id order by t, point_id)),
 pairs as (select g.asset_id, a.duration_ms, case when before = 'gap_start' then since else 0 end as s, t as e, coalesce(before <> 'gap_start', true) as orphan from gaps g join point_assets a using (asset_id) where reason = 'gap_end'
 union all select g.asset_id, a.duration_ms, t, a.duration_ms, false from gaps g join point_assets a using (asset_id) where reason = 'gap_start' and nxt is null)"""


@R.add("t05_pair_open_close", sql("cut_points point_assets", _PAIRS + " select asset_id, greatest(s,0) as s, least(e,duration_ms) as e from pairs where not orphan and least(e,duration_ms) > greatest(s,0)"))
def _(spark, d):
    return T.pair_open_close(V.cut_points(spark, d), V.point_assets(spark, d))


@R.add("t06_gap_intervals", sql("cut_points point_assets", _PAIRS + " select asset_id, s, e, orphan from pairs where e - s >= 500"))
def _(spark, d):
    return T.gap_intervals(V.cut_points(spark, d), V.point_assets(spark, d), 500)


_LONG = "select asset_id, cast(duration_ms as bigint) * (asset_id % 97) as duration_ms from word_assets"
_CHUNKS = f""", long as ({_LONG}), n0 as (select *, case when duration_ms <= 1200000 then 1 else cast(ceil(duration_ms/900000.0) as bigint) end as n from long),
 n1 as (select asset_id, duration_ms, case when n >= 2 and (duration_ms - (n-1)*900000)*100 < 900000*15 then n-1 else n end as n from n0),
 c as (select *, unnest(generate_series(cast(0 as bigint), cast(n - 1 as bigint))) as chunk from n1),
 chunks as (select asset_id, chunk, chunk*900000 as s, case when chunk = n-1 then duration_ms else (chunk+1)*900000 end as e from c)"""


def _long(spark, d):
    return V.word_assets(spark, d).withColumn("duration_ms", F.col("duration_ms") * (F.col("asset_id") % 97))


@R.add("t07_chunk_plan", sql("word_assets", _CHUNKS + " select * from chunks"))
def _(spark, d):
    return T.chunk_plan(_long(spark, d), 900_000, 1_200_000)


_UNITS = _CHUNKS + ", few as (select * from chunks where asset_id % 2 = 0), units as (select l.asset_id, coalesce(chunk,0) as chunk, coalesce(s,0) as \"offset\", coalesce(greatest(e - s, 0), duration_ms) as length from long l left join few using (asset_id))"


def _units(spark, d):
    assets = _long(spark, d)
    return T.resolve_units(assets, T.chunk_plan(assets, 900_000, 1_200_000).where("asset_id % 2 = 0"))


@R.add("t10_resolve_units", sql("word_assets", _UNITS + " select * from units"))
def _(spark, d):
    return _units(spark, d)


_ITEMS = ", items as (select asset_id, cast(pos % 3 as bigint) as chunk, s*7 as s, case when i % 5 = 0 then null else e*7 end as e, pos, i from words)"


@R.add("t08_remap_items", sql("words word_assets", _UNITS + _ITEMS + """, m as (select i.*, "offset", length, greatest(coalesce(s,0),0) as s1, case when length > 0 then length end as roof from items i join units using (asset_id, chunk)),
 m2 as (select *, coalesce(least(s1, roof), s1) as start from (select *, case when roof is null then s1 else least(s1, roof) end as x from m))
 select asset_id, chunk, pos, i, case when roof is null then s1 else least(s1, roof) end + "offset" as s, case when roof is null then greatest(x + 50, coalesce(e, s + 1000)) else least(greatest(x + 50, coalesce(e, s + 1000)), roof) end + "offset" as e from m2"""))
def _(spark, d):
    words = V.words(spark, d)
    items = words.select("asset_id", (F.col("pos") % 3).cast("long").alias("chunk"), (F.col("s") * 7).alias("s"), F.when(F.col("i") % 5 != 0, F.col("e") * 7).alias("e"), "pos", "i")
    return T.remap_items(items, _units(spark, d)).select("asset_id", "chunk", "pos", "i", "s", "e")


@R.add("t09_remap_edges", sql("words", """, counts as (select asset_id, pos as chunk, count(*) as n from words group by 1, 2), sh as (select *, coalesce(sum(n) over (partition by asset_id order by chunk rows between unbounded preceding and 1 preceding), 0) as shift from counts),
 edges as (select asset_id, pos as chunk, cast(i as bigint) as from_i, cast(i + 3 as bigint) as to_i from words) select e.asset_id, e.chunk, cast(from_i + shift as bigint) as from_i, cast(to_i + shift as bigint) as to_i from edges e join sh using (asset_id, chunk) where from_i < n and to_i < n"""))
def _(spark, d):
    words = V.words(spark, d).select("asset_id", F.col("pos").alias("chunk"), F.col("i").cast("long").alias("from_i"), (F.col("i") + 3).cast("long").alias("to_i"))
    return T.remap_edges(words, words.groupBy("asset_id", "chunk").agg(F.count("*").alias("n")))


@R.add("t11_clamp_ranges", sql("observations", """, a as (select asset_id, max(s) as duration_ms from observations where asset_id % 3 <> 0 group by 1), x as (select o.asset_id, obs_id, duration_ms, case when duration_ms is null then s - 5000 else least(greatest(s - 5000, 0), duration_ms) end as s0, case when obs_id % 4 = 0 then null else e end as e0 from observations o left join a using (asset_id)),
 y as (select *, greatest(s0, 0) as s1 from x) select asset_id, obs_id, s1 as s, case when duration_ms is null then greatest(coalesce(e0, s1 + 1000), s1 + 100) else greatest(least(greatest(coalesce(e0, s1 + 1000), s1 + 100), duration_ms), s1) end as e from y"""))
def _(spark, d):
    obs = V.observations(spark, d)
    assets = obs.where("asset_id % 3 <> 0").groupBy("asset_id").agg(F.max("s").alias("duration_ms"))
    items = obs.select("asset_id", "obs_id", (F.col("s") - 5000).alias("s"), F.when(F.col("obs_id") % 4 != 0, F.col("e")).alias("e"))
    return T.clamp_ranges(items, assets, 100, 1000).select("asset_id", "obs_id", "s", "e")


_BOUNDS = """, b as (select *, lag(e) over w as prev, lead(s) over w as nxt from words window w as (partition by asset_id order by s, e, pos, i)),
 bounds as (select asset_id, s as t, 'word_start' as reason from b join word_assets using (asset_id) where (prev is null or s - prev >= 120) and s > 0 and s < duration_ms
 union all select asset_id, e, 'word_end' from b join word_assets using (asset_id) where (nxt is null or nxt - e >= 120) and e > 0 and e < duration_ms)"""


@R.add("t13_word_boundary_points", sql("words word_assets", _BOUNDS + " select * from bounds"))
def _(spark, d):
    return T.word_boundary_points(V.words(spark, d), V.word_assets(spark, d))


@R.add("t14_speech_runs", sql("words", """, f as (select *, case when s - lag(e) over (partition by asset_id order by s, e, pos, i) < 120 then 0 else 1 end as fresh from words), g as (select *, sum(fresh) over (partition by asset_id order by s, e, pos, i) as run from f)
 select asset_id, cast(run as bigint) as run, min(s) as s, max(e) as e, count(*) as n_words from g group by 1, 2"""))
def _(spark, d):
    return T.speech_runs(V.words(spark, d))


@R.add("t15_snap_points", sql("cut_points", """, tg as (select asset_id, point_id as target_id, t + 40000 as t from cut_points where reason = 'gap_start'), pt as (select * from cut_points where reason <> 'gap_start'),
 j as (select tg.*, pt.t as pt, pt.reason, row_number() over (partition by tg.asset_id, target_id order by abs(pt.t - tg.t), pt.t desc, pt.reason) as rn from tg join pt on pt.asset_id = tg.asset_id and abs(pt.t - tg.t) <= 600000)
 select tg.asset_id, tg.target_id, tg.t, j.pt as snapped, j.reason from tg left join j on j.target_id = tg.target_id and j.rn = 1"""))
def _(spark, d):
    points = V.cut_points(spark, d)
    targets = points.where("reason = 'gap_start'").select("asset_id", F.col("point_id").alias("target_id"), (F.col("t") + 40_000).alias("t"))
    return T.snap_points(targets, points.where("reason <> 'gap_start'"), 600_000)


_SNAP = """, fl as (select asset_id, bool_or(reason not in ('gap_start','word_end')) as some_in, bool_or(reason not in ('gap_end','word_start')) as some_out from cut_points group by 1),
 mk as (select c.*, some_in, some_out from cut_points c join fl using (asset_id)), rg as (select asset_id, obs_id as target_id, s, e from observations where facet = 'view'),
 si as (select rg.target_id, m.t, m.reason, row_number() over (partition by target_id order by abs(m.t - rg.s), m.t desc, m.reason) as rn from rg join mk m on m.asset_id = rg.asset_id and abs(m.t - rg.s) <= 3000 where reason not in ('gap_start','word_end') or not some_in),
 so as (select rg.target_id, m.t, m.reason, row_number() over (partition by target_id order by abs(m.t - rg.e), m.t desc, m.reason) as rn from rg join mk m on m.asset_id = rg.asset_id and abs(m.t - rg.e) <= 3000 where reason not in ('gap_end','word_start') or not some_out),
 x as (select rg.*, si.reason as sr, so.reason as er, case when si.reason in ('gap_end','word_start') then greatest(si.t - 150, 0) else coalesce(si.t, s) end as ns, case when so.reason in ('gap_start','word_end') then so.t + 150 else coalesce(so.t, e) end as ne from rg left join si on si.target_id = rg.target_id and si.rn = 1 left join so on so.target_id = rg.target_id and so.rn = 1)
 select asset_id, target_id, s, e, case when ne - ns >= 500 then ns else s end as new_s, case when ne - ns >= 500 then ne else e end as new_e, case when ne - ns >= 500 then sr end as s_reason, case when ne - ns >= 500 then er end as e_reason from x"""


@R.add("t16_snap_ranges", sql("cut_points observations", _SNAP))
def _(spark, d):
    ranges = V.observations(spark, d).where("facet = 'view'").select("asset_id", F.col("obs_id").alias("target_id"), "s", "e")
    return T.snap_ranges(ranges, V.cut_points(spark, d), 3000)


@R.add("t17_anchor_trim", sql("spans words", """, j as (select sp.asset_id, sp.pos, sp.s, sp.e, cast((sp.e - sp.s) // 3 as bigint) as budget, sp.text as hint, w.text as wt, w.s as ws, row_number() over (partition by sp.asset_id, sp.pos order by w.s, w.e) as rn, contains(lower(sp.text), lower(w.text)) as q from spans sp join words w on w.asset_id = sp.asset_id and w.e > w.s and w.s >= sp.s - 10 and w.s < sp.e),
 ch as (select asset_id, pos, min(s) as s, min(e) as e, min(budget) as budget, arg_min(ws, case when q then 0 else 1 end * 1000000 + rn) as ws from j group by 1, 2),
 al as (select sp.asset_id, sp.pos, sp.s, sp.e, cast((sp.e - sp.s) // 3 as bigint) as budget, ch.ws from spans sp left join ch using (asset_id, pos)),
 st as (select *, case when ws is null then (s + e - budget) // 2 else least(ws - 300, e - budget) end as st from al), f as (select *, greatest(s, least(st, e - budget)) as x from st)
 select asset_id, pos, case when budget >= e - s - 10 then s else x end as s, case when budget >= e - s - 10 then e else x + budget end as e from f"""))
def _(spark, d):
    spans, words = V.spans(spark, d), V.words(spark, d)
    # a span is matched to words that start in it: join by bucket, then the array per span
    pairs = T.overlap_join(spans.select("asset_id", "pos", F.col("s") - 10, "e").toDF("asset_id", "pos", "s", "e"), words.select("asset_id", F.col("text").alias("w_text"), "s", "e"), W)
    units = pairs.where("b_s >= s").groupBy("asset_id", "pos").agg(F.array_sort(F.collect_list(F.struct(F.col("b_s").alias("s"), F.col("b_e").alias("e"), F.col("w_text").alias("text")))).alias("units"))
    rows = spans.join(units, ["asset_id", "pos"], "left").withColumn("units", F.coalesce("units", F.array().cast("array<struct<s:bigint,e:bigint,text:string>>")))
    cut = T.anchor_trim(F.col("s"), F.col("e"), F.expr("(e - s) div 3"), F.col("units"), F.col("text"))
    return rows.select("asset_id", "pos", cut.alias("x")).select("asset_id", "pos", "x.s", "x.e")


@R.add("t18_overlap_join", sql("iv", " select a.asset_id, a.s, a.e, b.s as b_s, b.e as b_e from iv a join iv b on a.asset_id = b.asset_id and a.s < b.e and b.s < a.e where a.flag = 'A' and b.flag = 'N'"))
def _(spark, d):
    iv = V.intervals(spark, d)
    return T.overlap_join(iv.where("flag = 'A'").select("asset_id", "s", "e"), iv.where("flag = 'N'").select("asset_id", "s", "e"), W)


_UNION = "select asset_id, cast(sum(len) as bigint) as covered from (select asset_id, isl, max(e) - min(s) as len from (select *, sum(f) over (partition by asset_id order by s, e rows unbounded preceding) as isl from (select *, case when s > max(e) over (partition by asset_id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as f from (select r.asset_id, greatest(r.s,0) as s, least(r.e, a.duration_ms) as e from {r} r join {a} a using (asset_id)) where e > s)) group by 1, 2) group by 1"


@R.add("t19_interval_union_length", sql("iv iv_assets", _UNION.format(r="iv", a="iv_assets")))
def _(spark, d):
    return T.union_length(V.intervals(spark, d), V.interval_assets(spark, d))


@R.add("t20_speech_density", sql("words word_assets spans", f" select a.asset_id, 'word_alignments' as basis, coalesce(covered, 0) as covered, duration_ms from word_assets a left join ({_UNION.format(r='words', a='word_assets')}) using (asset_id)"))
def _(spark, d):
    return T.speech_density(V.word_assets(spark, d), V.words(spark, d), V.spans(spark, d))


_SILENT = """, sp as (select *, coalesce(lag(e) over w, 0) as prev, lead(s) over w is null as last from words window w as (partition by asset_id order by s, e, pos, i)),
 silent as (select asset_id, prev as s, s as e from sp where s - prev >= 300 union all select asset_id, e, duration_ms from sp join word_assets using (asset_id) where last and duration_ms - e >= 300)"""


@R.add("t21_speechless_gaps", sql("words word_assets", _SILENT + " select * from silent"))
def _(spark, d):
    return T.speechless_gaps(V.words(spark, d), V.word_assets(spark, d), 300)


def _regions(spark, d):
    iv = V.intervals(spark, d).where("flag in ('R', 'A')")
    return iv.select("asset_id", "s", "e", F.array(F.concat_ws("-", "s", "e")).alias("evidence"), F.array("flag").alias("why"))


_MERGE = ", mk as (select *, case when s - max(e) over (partition by asset_id order by s, e rows between unbounded preceding and 1 preceding) < 500 then 0 else 1 end as f from iv where flag in ('R','A') and e > s), ml as (select *, sum(f) over (partition by asset_id order by s, e rows unbounded preceding) as isl from mk), merged as (select asset_id, isl, min(s) as s, max(e) as e, count(*) as n_evidence, count(distinct flag) as n_why from ml group by 1, 2)"


@R.add("t22_merge_removals", sql("iv", _MERGE + " select asset_id, s, e, n_evidence, n_why from merged"))
def _(spark, d):
    return T.merge_removals(_regions(spark, d), 500).select("asset_id", "s", "e", F.size("evidence").cast("long").alias("n_evidence"), F.size("why").cast("long").alias("n_why"))


_PAD = _MERGE + ", padded as (select asset_id, s + 200 as s, e - 200 as e from merged where e - s - 400 >= 200)"


@R.add("t23_apply_margin", sql("iv", _PAD + " select * from padded"))
def _(spark, d):
    return T.apply_margin(T.merge_removals(_regions(spark, d), 500), 200, 200).select("asset_id", "s", "e")


_COMP = ", {n}_c as (select a.asset_id, a.duration_ms, greatest(0, least(r.s, a.duration_ms)) as s, greatest(0, least(r.e, a.duration_ms)) as e from iv_assets a join {r} r using (asset_id)), {n}_p as (select *, coalesce(max(e) over (partition by asset_id order by s, e rows between unbounded preceding and 1 preceding), 0) as cur from {n}_c), {n} as (select asset_id, cur as s, s as e from {n}_p where s > cur union all select a.asset_id, coalesce(m, 0), a.duration_ms from iv_assets a left join (select asset_id, max(e) as m from {n}_c group by 1) using (asset_id) where a.duration_ms > coalesce(m, 0))"


@R.add("t24_complement", sql("iv iv_assets", _PAD + _COMP.format(n="kept", r="padded") + " select * from kept"))
def _(spark, d):
    return T.complement(T.apply_margin(T.merge_removals(_regions(spark, d), 500), 200, 200), V.interval_assets(spark, d))


_SLIVER = _PAD + _COMP.format(n="kept", r="padded") + """, sl as (select asset_id, s, e from (select *, bool_or(e - s >= 2500) over (partition by asset_id) as any_long from kept) where e - s < 2500 and any_long),
 again as (select * from padded union all select * from sl), a1 as (select *, case when s - max(e) over (partition by asset_id order by s, e rows between unbounded preceding and 1 preceding) < 1 then 0 else 1 end as f from again), a2 as (select *, sum(f) over (partition by asset_id order by s, e rows unbounded preceding) as isl from a1), removals as (select asset_id, min(s) as s, max(e) as e from a2 group by asset_id, isl)""" + _COMP.format(n="kept2", r="removals")


def _merged(spark, d):
    """Merged regions from the shared folder, as what follows reads them more than once."""
    return written(T.merge_removals(_regions(spark, d), 500), "merged")


def _absorbed(merged, assets):
    padded = T.apply_margin(merged, 200, 200)
    return T.absorb_slivers(padded, T.complement(padded, assets), assets, 2500)


@R.add("t25_absorb_slivers", sql("iv iv_assets", _SLIVER + " select asset_id, s, e, false as removed from kept2 union all select asset_id, s, e, true from removals"))
def _(spark, d):
    removed, kept = _absorbed(_merged(spark, d), V.interval_assets(spark, d))
    return kept.withColumn("removed", F.lit(False)).unionByName(removed.select("asset_id", "s", "e", F.lit(True).alias("removed")))


def _unit_words(spark, d):
    return V.intervals(spark, d).where("flag = 'N'").select("asset_id", "s", (F.col("s") + 900).alias("e"))


#: The fold over an asset's words, as a recursion over their order.
_GUARD = """, u as (select asset_id, s, s + 900 as e, row_number() over (partition by asset_id order by s) as k from iv where flag = 'N'), un as (select asset_id, max(k) as n from u group by 1),
 g as (select k2.asset_id, k2.s as s0, k2.e as e0, k2.s, k2.e, cast(0 as bigint) as k from kept2 k2 union all
 select g.asset_id, g.s0, g.e0, case when u.s < g.s and g.s < u.e then greatest(0, u.s - 50) else g.s end, case when u.s < g.e and g.e < u.e then least(70000, u.e + 100) else g.e end, g.k + 1 from g join u on u.asset_id = g.asset_id and u.k = g.k + 1),
 guarded as (select g.asset_id, g.s, g.e from g left join un using (asset_id) where g.k = coalesce(un.n, 0))"""


def _guarded(spark, d, merged=None):
    assets = V.interval_assets(spark, d)
    _, kept = _absorbed(_merged(spark, d) if merged is None else merged, assets)
    return T.guard_regions(written(kept, "kept"), _unit_words(spark, d), assets)


@R.add("t26_guard_regions", sql("iv iv_assets", _SLIVER + _GUARD + " select * from guarded", recursive=True))
def _(spark, d):
    return _guarded(spark, d)


_KEEP = ", k1 as (select *, case when s > max(e) over (partition by asset_id order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as f from guarded), k2 as (select *, sum(f) over (partition by asset_id order by s, e rows unbounded preceding) as isl from k1), final as (select asset_id, min(s) as s, max(e) as e from k2 group by asset_id, isl having max(e) > min(s))"


@R.add("t27_merge_kept", sql("iv iv_assets", _SLIVER + _GUARD + _KEEP + " select * from final", recursive=True))
def _(spark, d):
    return T.merge_kept(_guarded(spark, d))


_EVID = _COMP.format(n="gone", r="final") + ", sources as (select asset_id, s, e, n_evidence, n_why from merged), ev as (select g.asset_id, g.s, g.e, cast(coalesce(sum(n_evidence), 0) as bigint) as n_evidence from gone g left join sources m on m.asset_id = g.asset_id and m.s < g.e and g.s < m.e group by 1, 2, 3)"


@R.add("t28_attach_evidence", sql("iv iv_assets", _SLIVER + _GUARD + _KEEP + _EVID + " select * from ev", recursive=True))
def _(spark, d):
    merged = _merged(spark, d)
    kept = T.merge_kept(_guarded(spark, d, merged))
    return T.attach_evidence(written(kept, "kept"), merged, V.interval_assets(spark, d)).drop("why")


@R.add("t29_subtract_regions", sql("iv iv_assets", _SLIVER + _GUARD + _KEEP + _COMP.format(n="gone", r="final") + " select asset_id, s, e, true as kept from final union all select asset_id, s, e, false from gone", recursive=True))
def _(spark, d):
    kept, removed = T.subtract_regions(_regions(spark, d), V.interval_assets(spark, d), _unit_words(spark, d), keep=2500)
    return kept.withColumn("kept", F.lit(True)).unionByName(removed.select("asset_id", "s", "e", F.lit(False).alias("kept")))


@R.add("t30_kept_items", sql("words word_assets spans", _SILENT + """, kept as (select asset_id, prev as s, s as e from (select asset_id, e as prev, lead(s, 1, duration_ms) over (partition by asset_id order by s, e) as s from (select asset_id, s, e from silent union all select asset_id, 0, 0 from word_assets) join word_assets using (asset_id)) where s > prev),
 k as (select *, row_number() over w as pos, sum(e - s) over (partition by asset_id order by s, e rows unbounded preceding) - (e - s) as "at" from kept window w as (partition by asset_id order by s, e)),
 n as (select k.asset_id, k.s, k.e, count(w.s) as n_words from k left join words w on w.asset_id = k.asset_id and w.s >= k.s and w.e <= k.e group by 1, 2, 3),
 f as (select k.asset_id, k.s, k.e, arg_min(sp.pos, sp.s * 100000 + sp.pos) as segment_id from k join spans sp on sp.asset_id = k.asset_id and sp.s < k.e and k.s < sp.e group by 1, 2, 3)
 select k.asset_id, k.s, k.e, cast(pos as int) as pos, cast("at" as bigint) as "at", n_words, segment_id, exists (select 1 from silent x where x.asset_id = k.asset_id and abs(x.e - k.s) <= 50) as cut_before, exists (select 1 from silent x where x.asset_id = k.asset_id and abs(x.s - k.e) <= 50) as cut_after from k join n using (asset_id, s, e) left join f using (asset_id, s, e)"""))
def _(spark, d):
    words, assets = V.words(spark, d), V.word_assets(spark, d)
    removed = T.speechless_gaps(words, assets, 300)
    kept = T.complement(removed, assets)
    return T.kept_items(kept, removed, words, V.spans(spark, d).select("asset_id", "s", "e", F.col("pos").alias("segment_id")))


@R.add("t31_respect_word_units", sql("iv", """, u as (select asset_id, s, s + 900 as e, row_number() over (partition by asset_id order by s) as k from iv where flag = 'N'), un as (select asset_id, max(k) as n from u group by 1),
 it as (select asset_id, s, e, e - s + 400 as most from iv where flag = 'A'), g as (select asset_id, s, e as e0, most, e, cast(0 as bigint) as k from it union all
 select g.asset_id, g.s, g.e0, g.most, case when u.s < g.e and g.e < u.e then case when u.e + 100 <= g.s + g.most then u.e + 100 else greatest(g.s + 500, u.s - 50) end else g.e end, g.k + 1 from g join u on u.asset_id = g.asset_id and u.k = g.k + 1)
 select g.asset_id, g.s, g.e0 as e, g.e as new_e from g left join un using (asset_id) where g.k = coalesce(un.n, 0)""", recursive=True))
def _(spark, d):
    units = _unit_words(spark, d).groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("units"))
    rows = V.intervals(spark, d).where("flag = 'A'").join(units, "asset_id", "left").withColumn("units", F.coalesce("units", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    return rows.select("asset_id", "s", "e", T.respect_word_units(F.col("s"), F.col("e"), F.col("e") - F.col("s") + 400, F.col("units")).alias("new_e"))


@R.add("t32_rational_time", sql("iv", " select asset_id, s, case when asset_id % 3 = 0 then s*24.0/1000 when asset_id % 3 = 1 then s*30.0/1000 else s*50.0/1000 end as value, case when asset_id % 3 = 0 then 24.0 when asset_id % 3 = 1 then 30.0 else 50.0 end::double as rate from iv").replace("s*24.0/1000", "cast(s*24/1000.0 as double)").replace("s*30.0/1000", "cast(s*30/1000.0 as double)").replace("s*50.0/1000", "cast(s*50/1000.0 as double)"))
def _(spark, d):
    rate = F.when(F.col("asset_id") % 3 == 0, F.lit(24.0)).when(F.col("asset_id") % 3 == 1, F.lit(0.0)).otherwise(F.lit(50.0))
    return V.intervals(spark, d).select("asset_id", "s", T.rational_time(F.col("s"), rate).alias("t")).select("asset_id", "s", "t.value", "t.rate")
