"""Queries over nested evidence, removals by name, token sets and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals as T
from ..operators import removal as P
from ..operators import profile as A
from ..operators import search as S
from ..sources import views as V
from ..sources.shared import written
from .interval_queries import _COMP, _KEEP, _SILENT, _SLIVER
from .registry import Registry
from .search_queries import _STEM, _list, _terms
from .sql import sql

R = Registry()


def _nested(spark, d):
    """Observations with a list of objects, an object and a list of texts as value."""
    obs = V.observations(spark, d)
    i = F.col("obs_id")
    tag = lambda t, n: F.concat(F.lit(t), (i % n).cast("string"))
    items = F.array(
        F.to_json(F.struct(F.col("facet").alias("color"), tag("Tee ", 7).alias("garment"))), F.to_json(F.struct(tag("n", 5).alias("note"), F.lit(0.5).alias("score")))
    )
    place = F.to_json(F.struct(tag("room ", 3).alias("room"), F.lit("7.5").alias("floor")))
    raw = F.concat(
        F.lit('{"tags": ["  ", "'), tag("x", 2), F.lit('"], "place": '), place, F.lit(', "items": ['), F.array_join(items, ", "),
        F.lit('], "evidence": ["w", {"by": "z"}], "start_sec": 1, "confidence": "0.7"}'),
    )
    return obs.select("obs_id", "facet", raw.alias("value"))


@R.add("x09_observation_text", "select event_id as obs_id, event_type || ' Tee ' || cast(event_id % 7 as varchar) || ' n' || cast(event_id % 5 as varchar) || ' 7.5 room ' || cast(event_id % 3 as varchar) || ' x' || cast(event_id % 2 as varchar) as text from events")
def _(spark, d):
    return A.observation_text(_nested(spark, d), "obs_id", "value", include_evidence=False)


@R.add("a11_facet_histograms", """select facet, term, n, cast(rank as int) as rank from (select *, row_number() over (partition by facet order by n desc, term) as rank from (select facet, term, count(*) as n from (
 select event_type as facet, unnest([event_type, 'tee ' || cast(event_id % 7 as varchar), 'n' || cast(event_id % 5 as varchar), 'room ' || cast(event_id % 3 as varchar), 'x' || cast(event_id % 2 as varchar), event_type || ' tee ' || cast(event_id % 7 as varchar), '7.5 room ' || cast(event_id % 3 as varchar)]) as term from events)
 group by 1, 2)) where rank <= 8""")
def _(spark, d):
    return A.facet_histograms(_nested(spark, d), 8)


def _named(spark, d):
    """For each document of the query set the third word of its text as a removal target."""
    docs = V.table(spark, d, "documents").where("doc_id % 50 = 0")
    return docs.select(F.col("doc_id").alias("q"), F.get(F.split("text", " "), 2).alias("target")).where("target is not null")


def _spoken(spark, d):
    return V.spans(spark, d).select("asset_id", F.col("pos").alias("text_id"), F.lit("transcript").alias("source"), "s", "e", "text")


_STEMS = "list_distinct(list_transform({}, lambda t: " + _STEM + "))"
_NAMED = f""", tg as (select doc_id as q, string_split(text, ' ')[3] as target from documents where doc_id % 50 = 0 and string_split(text, ' ')[3] is not null), ts as (select *, {_STEMS.format("list_filter(" + _terms("target") + ", lambda t: length(t) > 2)")} as stems from tg),
 hv as (select asset_id, pos, s, e, {_STEMS.format(_terms("text", True))} as have from spans), sem as (select q, h.asset_id, greatest(0, s) as s, least(e, duration_ms) as e, target from ts join hv h on len(stems) > 0 and list_has_all(have, stems) join word_assets using (asset_id) where least(e, duration_ms) > greatest(0, s))"""


@R.add("x26_semantic_removals", sql("word_assets spans", _NAMED + " select q, asset_id, s, e, 'matches removal target ' || chr(39) || target || chr(39) || ' via transcript' as why from sem"))
def _(spark, d):
    return S.semantic_removals(_spoken(spark, d), _named(spark, d), V.word_assets(spark, d))


@R.add("x28_named_targets", f"select doc_id, array_to_string(list_filter([trim(string_split(text, ' ')[1]), case when doc_id % 2 = 0 then 'filler' else lang end], lambda a: a is not null and a <> '' and not list_contains({_list(X.SILENCE_MARKERS + X.DEAD_MARKERS)}, lower(a))), '|') as targets from documents")
def _(spark, d):
    listed = F.array(F.get(F.split("text", " "), 0), F.lit(None).cast("string"), F.lit("  "), F.lit("Dead Air"), F.when(F.col("doc_id") % 2 == 0, F.lit(" Filler")).otherwise(F.col("lang")))
    return V.table(spark, d, "documents").select("doc_id", F.array_join(S.removal_targets(listed), "|").alias("targets"))


_KIND = "(doc_id // 50) % 3"
_CAND = _NAMED + f""", dirs as (select doc_id as q, {_KIND} as kind from documents where doc_id % 50 = 0), ka as (select q, kind, asset_id as a, duration_ms, cast(q as varchar) || ':' || cast(asset_id as varchar) as asset_id from dirs, word_assets),
 dull as (select asset_id, s, e from (select conv_id as c, turn as t from conversations where {' or '.join(f"contains(lower(coalesce(text,'')), '{p}')" for p in X.LOW_ENERGY_PHRASES)} or list_has_any({_terms("coalesce(text,'')", True)}, {_list(X.LOW_ENERGY_TOKENS)}) or turn % 9 = 8) join spans on asset_id = c and pos = t),
 cand as (select ka.asset_id, greatest(0, x.s) as s, least(x.e, duration_ms) as e, 'silences' as flag from silent x join ka on ka.a = x.asset_id and kind < 2 union all select ka.asset_id, greatest(0, x.s), least(x.e, duration_ms), 'dead' from dull x join ka on ka.a = x.asset_id and kind = 1
  union all select ka.asset_id, x.s, x.e, target from sem x join ka on ka.a = x.asset_id and ka.q = x.q and kind = 2)"""
_CHAIN = (_SLIVER + _KEEP.replace("guarded", "kept2") + _COMP.format(n="gone", r="final")).replace("iv where flag in ('R','A') and", "cand where").replace("iv_assets", "ka").replace("2500", "500")


@R.add("q33_subtract_plan", sql("words word_assets spans", _SILENT + _CAND + _CHAIN + " select ka.q, ka.a as asset_id, x.s, x.e, x.kept from (select asset_id, s, e, true as kept from final union all select asset_id, s, e, false from gone) x join ka using (asset_id)"))
def _(spark, d):
    """Each directive of the query set against each asset: the removals it asks for, and what is kept. Every third names a target."""
    return P.expanded_plans(*_factored(spark, d))


@R.add("q33_plan_factors", sql("words word_assets spans", _SILENT + _CAND + _CHAIN + """, sg as (select ka.asset_id as k, ka.q, ka.a, case kind when 0 then 'silences' when 1 then 'dead,silences' else '' end || '|' || coalesce((select string_agg(distinct target, ',' order by target) from sem where sem.q = ka.q and sem.asset_id = ka.a and kind = 2), '') as sig from ka),
 parts as (select distinct sig, sg.a as asset_id, x.s, x.e, x.kept from (select asset_id, s, e, true as kept from final union all select asset_id, s, e, false from gone) x join sg on sg.k = x.asset_id)
 select sig, asset_id, s, e, kept, null as q from parts union all select distinct case kind when 0 then 'silences' when 1 then 'dead,silences' else '' end || '|', null, null, null, null, q from ka union all select sig, a, null, null, null, q from sg where not ends_with(sig, '|')"""))
def _(spark, d):
    """The distinct plans, and the links of directives to them."""
    plans, links = _factored(spark, d)
    return plans.select("sig", "asset_id", "s", "e", "kept", F.lit(None).cast("long").alias("q")).unionByName(links.select("sig", "asset_id", F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("boolean").alias("kept"), "q"))


def _factored(spark, d):
    docs = V.table(spark, d, "documents").where("doc_id % 50 = 0")
    kind = F.expr("(doc_id div 50) % 3")
    text = F.when(kind == 0, "Cut the pauses").when(kind == 1, "drop boring parts").otherwise("remove what is named")
    named = F.when(kind == 2, F.array(F.lit("Silence"), F.get(F.split("text", " "), 2))).otherwise(F.array(F.lit("dull")))
    routed = docs.select(F.col("doc_id").alias("q"), S.route_removals(text).alias("r"), S.removal_targets(named).alias("targets")).select("q", "r.*", "targets")
    words, assets = V.words(spark, d), V.word_assets(spark, d)
    silent = T.speechless_gaps(words, assets, 300).withColumn("why", F.lit("silences"))
    dull = V.spans(spark, d).where(S.low_energy(F.col("text")) | (F.col("pos") % 9 == 8)).select("asset_id", "s", "e", F.lit("dead").alias("why"))
    # long stretches without speech go for either
    asked = routed.select("q", F.explode_outer(F.array_compact(F.array(F.when(F.col("silences") | F.col("dead"), F.lit("silences")), F.when(F.col("dead"), F.lit("dead"))))).alias("why"))
    targets = routed.select("q", F.explode("targets").alias("target"))
    # read twice
    by_name = written(S.semantic_removals(_spoken(spark, d), targets.select(F.col("target").alias("q"), "target"), assets).select(F.col("q").alias("target"), "asset_id", "s", "e"), "named")
    return P.factored_plans(asked, silent.unionByName(dull), by_name, targets, assets, ["silences", "dead"])


@R.add("t12_clamped_range", sql("iv", """, a as (select asset_id, s, e, flag, case when asset_id % 3 > 0 then cast(40000 as bigint) end as d from iv), b as (select *, case when d is null then s else least(s, d - 100) end as x from a), c as (select *, case when d is null then e else least(greatest(x + 100, e), d) end as y from b)
 select asset_id, s, e, flag, x as new_s, case when y - x < 100 then x + 100 else y end as new_e from c"""))
def _(spark, d):
    rows = V.intervals(spark, d)
    got = T.clamped_range(F.col("s"), F.col("e"), F.when(F.col("asset_id") % 3 > 0, F.lit(40_000)))
    return rows.select("asset_id", "s", "e", "flag", got["s"].alias("new_s"), got["e"].alias("new_e"))


@R.add("x19_packet_tokens", sql("segments", f""" select segment_id, array_to_string(list_sort({_terms("concat_ws(' ', summary, role, mood)", True)}), ' ') as tokens, array_to_string(list_sort({_terms("concat_ws(' ', summary, 'blue the sky')")}), ' ') as facet_tokens from segments"""))
def _(spark, d):
    facet = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    facets = F.array(facet("look", F.col("summary")), facet("sound", F.lit("never this")), facet("look", F.lit("Blue, the sky")), facet("look", F.lit(None).cast("string")))
    tokens, looks = S.packet_tokens(F.col("summary"), F.col("role"), F.col("mood")), S.facet_tokens(facets, F.lit("look"))
    return V.segments(spark, d).select("segment_id", F.array_join(F.array_sort(tokens), " ").alias("tokens"), F.array_join(F.array_sort(looks), " ").alias("facet_tokens"))


@R.add("a03_semantic_summary", sql("segments spans words", " select 'segments' as name, count(*) as n from segments union all select 'usable', count(*) from segments where usable union all select 'spans', count(*) from spans union all select 'words', count(*) from words"))
def _(spark, d):
    seg = V.segments(spark, d)
    return A.table_counts({"segments": seg, "usable": seg.where("usable"), "spans": V.spans(spark, d), "words": V.words(spark, d)})


@R.add("a05_cut_point_summary", sql("observations cut_points", " select 'total' as level, '' as value, count(*) as n from cut_points union all select 'reason', reason, count(*) from cut_points group by reason"))
def _(spark, d):
    return A.counts_by(V.cut_points(spark, d), "reason")


@R.add("a07_context_summary", sql("segments", """ select 'cards' as level, asset_id as value, count(*) as n from segments where has_card group by 2 union all select 'material', role, count(*) from segments group by 2
 union all select 'captions', '', sum(case when trim(summary, ' ') <> '' then 2 else 1 end) from segments"""))
def _(spark, d):
    seg = V.segments(spark, d)
    cards = seg.where("has_card").select(F.col("asset_id").alias("source"))
    return A.context_summary(cards, seg.select(F.col("role").alias("kind")), seg.select(F.explode(A.captions()).alias("caption")))


def _replies(spark, d, *cases: str):
    """One of the given JSON texts for each event, with its id in place of @; a duration for two of three."""
    ev = V.table(spark, d, "events")
    pick = F.element_at(F.array(*map(F.lit, cases)), (F.col("event_id") % len(cases) + 1).cast("int"))
    raw = F.replace(pick, F.lit("@"), (F.col("event_id") % 50).cast("string"))
    return ev.select(F.col("event_id").alias("reply_id"), raw.alias("raw"), F.when(F.col("event_id") % 3 > 0, F.lit(20_000).cast("long")).alias("duration_ms"), F.concat(F.lit("cut "), F.col("event_type")).alias("directive"), (F.col("event_id") % 4 + 1).alias("n_items"))


_CUT = "case when {c} then greatest(0, least({s}, 19900)) else {s} end as s, case when {c} then least(greatest(least({s}, 19900) + 100, {e}), 20000) else {e} end as e"


def _clamped(s: str, e: str) -> str:
    return _CUT.format(c="event_id % 3 > 0", s=f"({s})", e=f"({e})")


@R.add("s11_segments", f"""select event_id as reply_id, 0 as i, {_clamped("event_id % 50 * 1000", "event_id % 50 * 1000 + 8000")}, 'candidate_moment' as kind, 'Seen ' || cast(event_id % 50 as varchar) as summary, cast(null as varchar) as transcript, 'Ann,Bo' as people, '' as roles, 0.5 as quality, true as usable, false as needs_caption from events where event_id % 3 = 0
 union all select event_id, 1, {_clamped("0", "100")}, 'shot', 'two', 'said', '', 'hook', cast(null as double), false, true from events where event_id % 3 = 0
 union all select event_id, 3, {_clamped("1500", "greatest(1600, event_id % 50 * 1000 + 600)")}, 'candidate_moment', 'late', cast(null as varchar), '', '', 1.0, false, true from events where event_id % 3 = 1""")
def _(spark, d):
    from ..operators import replies as Y

    one = '{"segments": [{"start_sec": "@", "summary": " Seen @ ", "people": ["Ann", "Bo"], "quality_score": 0.5}, {"start_sec": -4, "end_sec": 0.01, "kind": "shot", "summary": "two", "transcript_summary": " said ", "story_roles": "hook", "quality_score": "good", "usable": false, "needs_caption": 1}, {"summary": " "}, "text"]}'
    two = '{"segments": [7, {"start_sec": 2}, {"summary": null}, {"start_sec": 1.5, "end_sec": @.6, "summary": "late", "quality_score": "1", "usable": 0, "needs_caption": true}]}'
    got = Y.explode_segments(_replies(spark, d, one, two, '{"segments": "none"}'))
    return got.withColumns({"people": F.array_join("people", ","), "roles": F.array_join("roles", ",")})


@R.add("s11_facets", f"""select event_id as reply_id, event_type as facet, 0 as i, {_clamped("event_id % 50 * 1000", "event_id % 50 * 1000 + 1000")}, 0.9 as confidence from events where event_id % 2 = 0
 union all select event_id, event_type, 1, {_clamped("0", "2500")}, cast(null as double) from events where event_id % 2 = 0 union all select event_id, event_type, 0, {_clamped("3000", "4000")}, cast(null as double) from events where event_id % 2 = 1""")
def _(spark, d):
    from ..operators import replies as Y

    rows = _replies(spark, d, '{"observations": [{"start_sec": @, "confidence": "0.9", "look": {"a": [1]}}, 5, {"start_sec": "x", "end_sec": 2.5, "confidence": {}}], "segments": [{}]}', '{"segments": ["no", {"start_sec": 3, "end_sec": 0}]}')
    return Y.explode_facets(rows.withColumn("facet", F.substring("directive", 5, 99))).drop("value")


@R.add("s11_budget", f"""select event_id as reply_id, 'cinematography' as facet, 0 as i, {_clamped("event_id % 50 * 1000", "event_id % 50 * 1000 + 1000")}, cast(null as double) as confidence from events where event_id % 2 = 0
 union all select event_id, 'emotion_tone', k, {_clamped("k * 1000", "9000")}, k / 4.0 from events, (values (0), (1)) t(k) where event_id % 2 = 0""")
def _(spark, d):
    from ..operators import replies as Y

    rows = _replies(spark, d, '{"facets": {"cinematography": [{"start_sec": @}], "emotion_tone": [{"start_sec": 0, "end_sec": 9, "confidence": 0}, {"start_sec": 1, "end_sec": 9, "confidence": 0.25}], "objects_text": {"start_sec": 1}, "weather": [{}]}}', '{"facets": []}')
    return Y.explode_budget(rows).drop("value")


_INTENTS = (
    '{"operation": {"mode": " Subtract", "output": "report", "sources": "subset:a"}, "edit_type": "trim", "requirements": [{"text": " keep @ ", "provenance": "user_explicit"}, {"text": "", "provenance": "agent"}, {"text": "slow", "provenance": "boss"}], "anchors": [{"description": "door", "position": "After: x"}, {"position": "first"}, {"description": " sea ", "position": "up"}, {"description": "sky"}], "evidence_attributes": ["  a ", " ", "b"]}',
    "no json",
    "{}",
    '{"edit_type": "mix", "operation": {"mode": "dance", "output": "x", "sources": "web"}}',
    '{"requirements": []}',
    '{"requirements": "none", "edit_type": "", "operation": "compose"}',
)


@R.add("q31_conform_intents", """select event_id as reply_id, case when k = 0 then 'subtract' else 'compose' end as mode, case when k = 0 then 'report' else 'timeline' end as output, case when k = 0 then 'subset:a' else 'corpus' end as sources, case k when 0 then 'trim' when 3 then 'mix' else 'unspecified_edit' end as edit_type,
 case when k = 0 then 'keep ' || cast(event_id % 50 as varchar) || '/user_explicit|slow/agent' else 'cut ' || event_type || '/user_explicit' end as requirements, case when k = 0 then 'door@after: x|sea@anywhere|sky@anywhere' else '' end as anchors, case when k = 0 then 'a|b' else '' end as attributes, k in (1, 2, 5) as fallback,
 case k when 0 then 'requirement without text; invalid provenance; missing why; anchor without description; invalid position' when 3 then 'unknown mode; unknown output; unknown sources; no requirements' when 4 then 'no requirements' else 'malformed reply' end as warnings from (select *, event_id % 6 as k from events)""")
def _(spark, d):
    from ..operators import replies as Y

    return Y.conform_intents(_replies(spark, d, *_INTENTS)).withColumn("warnings", F.array_join("warnings", "; "))


_SCRIPTS = (
    '{"operations": [{"op": "Retime", "target": "middle", "factor": 1.5}, {"op": "retime", "target": [0, 1], "target_duration_sec": 4}, {"op": "retime", "target": "all", "factor": 0}, {"op": "drop_item", "item": -2}, 3]}',
    '[{"op": "replace_item", "item": "slot_1", "with": ""}, {"op": "swap_ending", "with_query": " sea "}, {"op": "swap_ending"}, {"op": "insert_beat", "after": 0, "need": "calm"}, {"op": "insert_beat", "after": 9, "need": "calm"}, {"op": "sing"}]',
    "none",
)


@R.add("q31_conform_scripts", """with e as (select *, event_id % 4 + 1 as n from events), a as (select * from (values (0, 0, 'retime', 'middle', '1.5', null), (0, 1, 'retime', '[0,1]', '4', 'range'), (0, 2, 'retime', 'all', '0', 'no positive factor or duration'), (0, 3, 'drop_item', '-2', null, 'item'), (0, 4, '', null, null, 'not an object'),
  (1, 0, 'replace_item', 'slot_1', 'recast', null), (1, 1, 'swap_ending', 'sea', null, null), (1, 2, 'swap_ending', null, null, 'no query'), (1, 3, 'insert_beat', '0', 'calm', null), (1, 4, 'insert_beat', '9', 'calm', 'no place or need'), (1, 5, 'sing', null, null, 'unknown operation')) v(k, i, op, o, b, problem))
 select event_id as reply_id, i, op, o as "on", case when op = 'retime' and b = '0' then null else b end as "by", case when problem = 'range' then case when n < 2 then 'invalid target' end when problem = 'item' then case when n < 2 then 'invalid item' end else problem end as problem from e join a on event_id % 3 = k""")
def _(spark, d):
    from ..operators import replies as Y

    return Y.conform_scripts(_replies(spark, d, *_SCRIPTS)).drop("timed_by")
