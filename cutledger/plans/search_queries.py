"""Queries over the text functions and search operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as S
from ..sources import views as V
from .registry import Registry
from .sql import sql

R = Registry()


def _list(values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _uniq(expr: str) -> str:
    """Distinct values in first order, in DuckDB."""
    return f"list_filter({expr}, lambda v, i: list_position({expr}, v) = i)"


def _dterms(c: str) -> str:
    return _uniq(f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1 and not list_contains({_list(X.DIRECTIVE_STOP)}, t))")


def _terms(c: str, keep: bool = False) -> str:
    stop = "" if keep else f" and not list_contains({_list(X.CASTING_STOP)}, t)"
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: length(t) > 1{stop}))"


def _docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "text")


def _count(name: str, f: Callable[[Column], Column], sql_expr: str) -> None:
    """A query of the number and the joined values of an array expression for each document."""

    @R.add(name, f"select doc_id, len({sql_expr}) as n, array_to_string(list_sort({sql_expr}), ' ') as joined from documents")
    def _(spark, d):
        got = f(F.col("text"))
        return _docs(spark, d).select("doc_id", F.size(got).cast("long").alias("n"), F.array_join(F.array_sort(got), " ").alias("joined"))


_count("x01_directive_terms", X.directive_terms, f"list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1 and not list_contains({_list(X.DIRECTIVE_STOP)}, t)))")
_count("x02_terms", X.terms, _terms("text"))
_count("x03_tokens", X.tokens, "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) > 2)")


@R.add("x04_norms", "select doc_id, translate(lower(trim(text)), '- ', '__') as n, translate(lower(trim(text)), ' ', '_') as c, translate(text, '_', '-') as s from documents")
def _(spark, d):
    text = F.col("text")
    return _docs(spark, d).select("doc_id", X.norm(text).alias("n"), X.norm_context(text).alias("c"), X.slug(text).alias("s"))


_STEM = "case " + " ".join(f"when ends_with(t,'{s}') and length(t)-{len(s)} >= 3 then left(t, length(t)-{len(s)})" for s in X.SUFFIXES) + " else t end"


@R.add("x05_stem", f"select stem, count(*) as n, count(distinct t) as forms from (select t, {_STEM} as stem from (select unnest({_terms('text')}) as t from documents)) group by 1")
def _(spark, d):
    rows = _docs(spark, d).select(F.explode(X.terms(F.col("text"))).alias("t"))
    return rows.groupBy(X.stem(F.col("t")).alias("stem")).agg(F.count("*").alias("n"), F.count_distinct("t").alias("forms"))


def _bm25_sql(views: str, docs: str, k: int) -> str:
    return sql(views, f""", d as ({docs}), w as (select doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') as ws from d), st as (select count(*) as nd, avg(len(ws)) as al from w),
 p as (select doc_id, term, len, count(*) as tf from (select doc_id, len(ws) as len, unnest(ws) as term from w) group by 1, 2, 3),
 q as (select distinct query_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(query_text)), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) as term from queries), n as (select term, count(*) as n from p where term in (select term from q) group by 1),
 sc as (select query_id, doc_id, round(-sum(greatest(ln((nd - n + 0.5)/(n + 0.5)), 1e-6) * tf*2.2/(tf + 1.2*(0.25 + 0.75*len/al))), 6) as score from q join p using (term) join n using (term), st group by 1, 2)
 select * from (select *, cast(row_number() over (partition by query_id order by score, doc_id) as int) as rank from sc) where rank <= {k}""")


@R.add("x06_bm25_transcripts", _bm25_sql("spans queries", "select asset_id*1000 + pos as doc_id, text from spans", 10))
def _(spark, d):
    docs = V.spans(spark, d).select((F.col("asset_id") * 1000 + F.col("pos")).alias("doc_id"), "text")
    return S.bm25(docs, V.search_queries(spark, d), 10)


@R.add("x07_bm25_segments", _bm25_sql("queries", "select doc_id, text from documents", 20))
def _(spark, d):
    return S.bm25(_docs(spark, d), V.search_queries(spark, d), 20)


_OBS_QUERIES = "select distinct cast(l_linenumber as bigint) as query_id, case l_returnflag when 'A' then 'click k1' when 'N' then 'purchase view' else 'error signup' end as query_text from lineitem where l_orderkey = (select min(l_orderkey) from lineitem)"


@R.add("x08_bm25_observations", sql("observations", ", queries as (select * from (values (1, 'click'), (2, 'purchase k error'), (3, 'view signup')) v(query_id, query_text))").replace("\n,", ",\n") + _bm25_sql("queries", "select obs_id as doc_id, facet || ' ' || value as text from observations", 10).split("from documents where doc_id % 50 = 0)", 1)[1])
def _(spark, d):
    docs = V.observations(spark, d).select(F.col("obs_id").alias("doc_id"), F.concat_ws(" ", "facet", "value").alias("text"))
    queries = spark.createDataFrame([(1, "click"), (2, "purchase k error"), (3, "view signup")], "query_id int, query_text string")
    return S.bm25(docs, queries, 10)


def _phrases_sql(views: str, docs: str, queries: str, k: int) -> str:
    words = "list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    return sql(views, f""", asked as ({queries}), d as ({docs}), w as (select doc_id, {words.format(c='text')} as ws from d), st as (select count(*) as nd, avg(len(ws)) as al from w),
 q as (select distinct query_id, {words.format(c='part')} as unit from (select query_id, unnest(regexp_split_to_array(query_text, '\\s+')) as part from asked)), u as (select distinct unit from q where len(unit) > 0),
 p as (select unit, doc_id, len(ws) as len, len(list_filter(range(1, len(ws) - len(unit) + 2), lambda i: ws[i:i + len(unit) - 1] = unit)) as tf from w join u on len(list_filter(unit, lambda t: list_contains(ws, t))) = len(unit)),
 n as (select unit, count(*) as n from p where tf > 0 group by 1), sc as (select query_id, doc_id, round(-sum(greatest(ln((nd - n + 0.5)/(n + 0.5)), 1e-6) * tf*2.2/(tf + 1.2*(0.25 + 0.75*len/al))), 6) as score from q join p using (unit) join n using (unit), st where tf > 0 group by 1, 2)
 select * from (select *, cast(row_number() over (partition by query_id order by score, doc_id) as int) as rank from sc) where rank <= {k}""")


_ASKED = [(1, "click_k"), (2, "k_5 view"), (3, "purch\u00e1se-K error_k_7"), (4, "k__9_"), (5, " "), (6, "Sign\u00fcp K")]


@R.add("x08_bm25_phrases", _phrases_sql("observations", "select obs_id as doc_id, facet || ' ' || value as text from observations", "select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in _ASKED) + ") v(query_id, query_text)", 10))
def _(spark, d):
    docs = V.observations(spark, d).select(F.col("obs_id").alias("doc_id"), F.concat_ws(" ", "facet", "value").alias("text"))
    return S.bm25(docs, spark.createDataFrame(_ASKED, "query_id int, query_text string"), 10, phrases=True)


@R.add("x06_bm25_phrases", _phrases_sql("spans", "select asset_id*1000 + pos as doc_id, text from spans", "select asset_id*1000 + pos as query_id, array_to_string(string_split(text, ' ')[1:2], '_') || ' ' || string_split(text, ' ')[3] as query_text from spans where asset_id % 5 = 0 and len(string_split(text, ' ')) > 2", 10))
def _(spark, d):
    docs = V.spans(spark, d).select("asset_id", (F.col("asset_id") * 1000 + F.col("pos")).alias("doc_id"), "text")
    ws = F.split("text", " ")
    asked = docs.where((F.col("asset_id") % 5 == 0) & (F.size(ws) > 2)).select(F.col("doc_id").alias("query_id"), F.concat(F.array_join(F.slice(ws, 1, 2), "_"), F.lit(" "), ws[2]).alias("query_text"))
    return S.bm25(docs, asked, 10, phrases=True)


_SEG = ", seg as (select *, lower(replace(concat_ws(' ', nullif(replace(lower(summary),' ','_'),''), role, mood, cast(asset_id as varchar)), chr(0), '')) as hay, lower(summary) as transcript from segments where usable)"
_SCORE = _SEG + f""", qt as (select query_id, {_dterms('query_text')} as terms from queries), sc0 as (select seg.*, query_id, list_filter(terms, lambda t: contains(hay, t)) as hits, list_filter(terms, lambda t: contains(transcript, t)) as spoken from seg, qt),
 sc as (select *, len(hits)*20 + least(30, len(spoken)*10) + case when has_card then 15 else 0 end + least(20, quality*2) as score, list_filter([case when len(hits) > 0 then 'matches directive terms: ' || array_to_string(hits[1:5], ', ') end, case when len(spoken) > 0 then 'directive terms land in spoken words: ' || array_to_string(spoken[1:4], ', ') end, case when has_card then 'has editorial context card' end], lambda r: r is not null) as reasons from sc0),
 top as (select * from (select *, row_number() over (partition by query_id order by score desc, quality desc, s, segment_id) as rank from sc where score > 0 or query_id not in (select query_id from sc where score > 0)) where rank <= 10)"""


def _segments(spark, d):
    rows = V.segments(spark, d).where("usable")
    hay = X.haystack(F.col("summary"), F.col("role"), F.col("mood"), F.col("asset_id"))
    return rows.withColumns({"hay": hay, "transcript": F.lower("summary")})


def _top(spark, d, k=10):
    return S.context_search(_segments(spark, d), V.search_queries(spark, d), k)


@R.add("x11_score_segments", sql("segments queries", _SCORE + " select query_id, segment_id, score, array_to_string(reasons, '; ') as reasons from sc where len(hits) > 0"))
def _(spark, d):
    rows = S.score_segments(_segments(spark, d), V.search_queries(spark, d))
    return rows.where(F.startswith(F.get("reasons", 0), F.lit("matches"))).select("query_id", "segment_id", "score", F.array_join("reasons", "; ").alias("reasons"))


@R.add("x12_context_search", sql("segments queries", _SCORE + " select query_id, cast(rank as int) as rank, segment_id, asset_id, score, array_to_string(reasons, '; ') as reasons from top"))
def _(spark, d):
    return _top(spark, d).select("query_id", "rank", "segment_id", "asset_id", "score", F.array_join("reasons", "; ").alias("reasons"))


@R.add("x13_packet_warnings", sql("segments queries", _SCORE + """ select query_id, cast(rank as int) as rank, segment_id, array_to_string(list_filter([case when ra > 1 then 'duplicate_source_asset' end, case when segment_id % 5 = 0 then 'abrupt_audio_or_no_audio' when role = 'performance' then 'check_audio_transition' end, case when not has_card then 'weak_context' end], lambda x: x is not null), ',') as warnings,
 cast(650 + case when segment_id % 4 > 0 then 150 else 0 end - case when ra > 1 then 200 else 0 end - case when rr > 1 then 100 else 0 end as bigint) as continuity from (select *, row_number() over (partition by query_id, asset_id order by rank) as ra, row_number() over (partition by query_id, role order by rank) as rr from top)"""))
def _(spark, d):
    rows = _top(spark, d).withColumns({"has_audio": F.col("segment_id") % 5 != 0, "n_edges": F.col("segment_id") % 4})
    return S.packet_warnings(rows).select("query_id", "rank", "segment_id", F.array_join("warnings", ",").alias("warnings"), "continuity")


@R.add("x15_packets", sql("segments queries", _SCORE + """, fx as (select top.query_id, top.rank, top.segment_id, f.summary as t, f.s as fs, row_number() over (partition by top.query_id, top.segment_id order by f.s, f.t) as k, f.t as ft from top join (select asset_id, s, e, summary, role || ' ' || cast(segment_id as varchar) as t from segments) f on f.asset_id = top.asset_id and f.s < top.e and top.s < f.e)
 select top.query_id, cast(top.rank as int) as rank, top.segment_id, coalesce((select string_agg(ft, '|' order by k) from fx where fx.query_id = top.query_id and fx.segment_id = top.segment_id and k <= 3), '') as facets from top"""))
def _(spark, d):
    facets = V.segments(spark, d).select("asset_id", "s", "e", F.concat_ws(" ", "role", F.col("segment_id").cast("string")).alias("text"))
    return S.packets(_top(spark, d), facets, 10_000, 3).select("query_id", "rank", "segment_id", F.array_join("facet_texts", "|").alias("facets"))


@R.add("x16_parse_filter", f"select doc_id, case when doc_id % 2 = 0 then lang end as facet, array_to_string(list_sort({_terms('text')}), ' ') as terms from documents where lang is not null")
def _(spark, d):
    docs = V.table(spark, d, "documents").where("lang is not null")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(": ", "lang", "text")).otherwise(F.col("text"))
    got = docs.select("doc_id", S.parse_filter(text, ["en", "de", "fr", "es"]).alias("f"))
    return got.select("doc_id", "f.facet", F.array_join(F.array_sort("f.terms"), " ").alias("terms"))


@R.add("x17_evidence_matches", f"select b.doc_id, list_has_all({_terms('text', True)}, {_terms("concat_ws(' ', lang, 'ea')")}) as whole, list_has_all({_terms('text', True)}, ['the','of']) as common from documents b")
def _(spark, d):
    have = X.terms(F.col("text"), keep_stop=True)
    docs = V.table(spark, d, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", S.evidence_matches(have, X.terms(F.concat_ws(" ", "lang", F.lit("ea")))).alias("whole"), S.evidence_matches(have, X.strings(["the", "of"])).alias("common"))


@R.add("x18_exhibits", f"select s.segment_id, list_has_any({_terms('summary', True)}, ['the','que']) as lane, not list_has_any({_terms('summary', True)}, ['license']) as kept from (select doc_id as segment_id, text as summary from documents) s where list_has_any({_terms('summary', True)}, ['the','que']) and not list_has_any({_terms('summary', True)}, ['license'])")
def _(spark, d):
    have = X.terms(F.col("text"), keep_stop=True)
    lane, kept = F.arrays_overlap(have, X.strings(["the", "que"])), ~F.arrays_overlap(have, X.strings(["license"]))
    return _docs(spark, d).where(lane & kept).select(F.col("doc_id").alias("segment_id"), lane.alias("lane"), kept.alias("kept"))


_TREND = "case doc_id % 4 when 0 then ' Rising' when 1 then 'flat' when 2 then 'unheard' else 'low' end"


@R.add("x21_candidate_rank", f"select doc_id, case doc_id % 4 when 0 then 10 when 1 then 5 when 3 then 0 end as energy, cast(n_chars % 100 + (doc_id % 3)*20 + case when doc_id % 2 = 0 then 10 else 0 end + case doc_id % 4 when 0 then (10 - abs(10 - 7))*1.5 when 1 then (10 - abs(5 - 7))*1.5 when 3 then (10 - abs(0 - 7))*1.5 else 0 end as double) as rank from documents")
def _(spark, d):
    trend = F.element_at(X.strings([" Rising", "flat", "unheard", "low"]), (F.col("doc_id") % 4 + 1).cast("int"))
    energy = S.packet_energy(F.array(F.lit("none of these"), trend))
    rank = S.candidate_rank(F.col("n_chars") % 100, F.col("doc_id") % 3, F.col("doc_id") % 2 == 0, energy, F.lit(7))
    return V.table(spark, d, "documents").select("doc_id", energy.alias("energy"), rank.cast("double").alias("rank"))


@R.add("x23_coverage_report", sql("queries", f""", a as (select query_id as attribute_id, list_filter({_terms('query_text')}, lambda t: length(t) > 2) as ts from queries), w as (select attribute_id, unnest(ts) as term from a), h as (select doc_id, unnest({_terms('text', True)}) as term from documents)
 select a.attribute_id, (select count(distinct doc_id) from w join h using (term) where w.attribute_id = a.attribute_id) as n from a"""))
def _(spark, d):
    attributes = V.search_queries(spark, d).select(F.col("query_id").alias("attribute_id"), F.col("query_text").alias("attribute"))
    return S.coverage_report(attributes, _docs(spark, d))


@R.add("x24_resolve_anchors", sql("segments queries", _SCORE + f""", an as (select query_id as anchor_id, query_id, query_text as description, query_id % 100 = 0 as user_explicit from queries), h as (select anchor_id, arg_min(segment_id, rank) as segment_id from an join top using (query_id) where rank <= 8 and list_has_any({_terms('description')}, {_terms('summary', True)}) group by 1)
 select an.anchor_id, h.segment_id, case when h.segment_id is not null then 'resolved' when user_explicit then 'hard' else 'soft' end as status from an left join h using (anchor_id)"""))
def _(spark, d):
    anchors = V.search_queries(spark, d).select(F.col("query_id").alias("anchor_id"), "query_id", F.col("query_text").alias("description"), (F.col("query_id") % 100 == 0).alias("user_explicit"))
    return S.resolve_anchors(anchors, _top(spark, d).select("query_id", "rank", "segment_id", F.col("summary").alias("text")))


@R.add("x25_generator_matches", f"select doc_id, list_has_all({_terms('text', True)}, ['the','ea']) as quoted, list_has_any({_terms('text', True)}, ['thereof','que']) as loose from documents")
def _(spark, d):
    have = X.terms(F.col("text"), keep_stop=True)
    # 'the' is a stop word, so the phrase counts by its other terms
    quoted = S.generator_matches(F.lit("supercut of 'ea the'"), have) & F.array_contains(have, "the")
    return _docs(spark, d).select("doc_id", quoted.alias("quoted"), S.generator_matches(F.lit("thereof que of"), have).alias("loose"))


@R.add("x26_stems_match", f"select doc_id, list_has_all(list_transform({_terms('text', True)}, lambda t: {_STEM}), ['license','releas']) as found from documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", S.stems_match(F.lit("license releases"), F.col("text")).alias("found"))


@R.add("x27_low_energy", f"select asset_id, pos, {' or '.join(f'contains(lower(text), {chr(39)}{p}{chr(39)})' for p in X.LOW_ENERGY_PHRASES)} or list_has_any({_terms('text', True)}, {_list(X.LOW_ENERGY_TOKENS)}) as low from (select conv_id as asset_id, turn as pos, coalesce(text,'') as text from conversations)")
def _(spark, d):
    return V.spans(spark, d).select("asset_id", "pos", S.low_energy(F.col("text")).alias("low"))


def _any(markers: list[str]) -> str:
    return " or ".join(f"contains(lower(text), '{m}')" for m in markers)


@R.add("x28_route_removals", f"select doc_id, {_any(X.SILENCE_MARKERS)} as silences, {_any(X.DEAD_MARKERS)} as dead from (select doc_id, text || case when doc_id % 7 = 0 then ' Cut the PAUSES' when doc_id % 7 = 1 then ' drop dull filler' else '' end as text from documents)")
def _(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 7 == 0, " Cut the PAUSES").when(F.col("doc_id") % 7 == 1, " drop dull filler").otherwise(""))
    got = _docs(spark, d).select("doc_id", S.route_removals(text).alias("r"))
    return got.select("doc_id", "r.silences", "r.dead")


@R.add("x29_evidence_for_name", sql("queries", """, nm as (select distinct query_text as name, translate(lower(trim(query_text)), '- ', '__') as key from queries), h as (select doc_id, translate(lower(text), '- ' || chr(10), '___') as hay from documents), j as (select name, doc_id from nm join h on contains(hay, key) and list_contains(string_split(hay, '_'), split_part(key, '_', 1)))
 select * from (select name, doc_id, cast(row_number() over (partition by name order by doc_id) as int) as rank from j) where rank <= 5"""))
def _(spark, d):
    names = V.search_queries(spark, d).select(F.col("query_text").alias("name")).distinct()
    return S.evidence_for_name(names, _docs(spark, d))


_KEPT = "select doc_id, key, min(pos) as pos from (select doc_id, translate(lower(trim(w)), '- ', '__') as key, pos from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (select doc_id, string_split(text, ' ') as ws from documents))) group by 1, 2"


@R.add("x30_dedupe", f"select doc_id, string_agg(key, ' ' order by pos) as kept from ({_KEPT}) group by 1")
def _(spark, d):
    kept = S.dedupe(_docs(spark, d).select("doc_id", F.split("text", " ").alias("values")), "doc_id")
    return kept.select("doc_id", F.array_join(F.transform("kept", X.norm), " ").alias("kept"))
