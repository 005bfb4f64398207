"""Queries over profiles and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import profile as A
from ..sources import views as V
from .registry import Registry
from .sql import sql

R = Registry()


@R.add("a01_counts_by", sql("observations cut_points", " select 'total' as level, '' as value, count(*) as n from cut_points union all select 'reason', reason, count(*) from cut_points group by 2 union all select 'asset_id', cast(asset_id as varchar), count(*) from cut_points group by 2"))
def _(spark, d):
    return A.counts_by(V.cut_points(spark, d), "reason", "asset_id")


@R.add("a02_transcript_summary", "select 'total' as level, '' as value, count(*) as n from conversations union all select 'speaker', role, count(*) from conversations group by 2")
def _(spark, d):
    return A.counts_by(V.spans(spark, d), "speaker")


@R.add("a04_facet_summary", "select event_type as facet, cast(user_id % 5 as varchar) as source, count(*) as n from events group by grouping sets ((1, 2), (1), (2), ())".replace("group by grouping sets ((1, 2), (1), (2), ())", "group by grouping sets ((event_type, cast(user_id % 5 as varchar)), (event_type), (cast(user_id % 5 as varchar)), ())"))
def _(spark, d):
    return A.facet_summary(V.observations(spark, d).select("facet", (F.col("asset_id") % 5).cast("string").alias("source")))


@R.add("a06_chunk_summary", "select count(distinct l_orderkey) as n_keys, count(*) as n_rows from lineitem")
def _(spark, d):
    return A.distinct_and_rows(V.intervals(spark, d), "asset_id")


def _assets(spark, d):
    rows = V.point_assets(spark, d)
    return rows.withColumns({"status": F.when(F.col("asset_id") % 4 > 0, "ready").otherwise("failed"), "has_audio": F.col("asset_id") % 3 > 0})


@R.add("a08_asset_inventory", sql("point_assets", " select count(*) as n, count(*) filter (where asset_id % 4 > 0) as n_ready, cast(sum(case when asset_id % 4 > 0 then duration_ms else 0 end) as bigint) as total_ms, count(*) filter (where asset_id % 3 > 0) as n_audio from point_assets"))
def _(spark, d):
    return A.asset_inventory(_assets(spark, d))


@R.add("a09_segment_inventory", sql("segments", " select count(*) as n, min(e - s) as shortest, median(e - s) as median, max(e - s) as longest from segments where usable"))
def _(spark, d):
    return A.segment_inventory(V.segments(spark, d))


@R.add("a10_quotable_lines", sql("words", " select l as line, asset_id, s, pos, text from (select lower(text) as l, asset_id, s, pos, text, row_number() over (partition by lower(text) order by asset_id, s, pos, text) as r from words where e > s) where r = 1 order by asset_id, s, pos, l limit 50"))
def _(spark, d):
    return A.quotable_lines(V.words(spark, d), 50)


@R.add("a12_role_candidates", sql("segments", " select * from (select kind, cast(row_number() over (partition by kind order by quality desc, s, segment_id) as int) as rank, segment_id from (select *, case when role = 'hook' then 'opener' when role in ('payoff','conclusion','climax') then 'ender' end as kind from segments where usable) where kind is not null) where rank <= 5"))
def _(spark, d):
    return A.role_candidates(V.segments(spark, d), 5)


@R.add("a14_collection_summary", sql("segments", " select * from (select field, value, n, cast(row_number() over (partition by field order by n desc, value) as int) as rank from (select 'role' as field, role as value, count(*) as n from segments group by 2 union all select 'mood', mood, count(*) from segments where mood is not null group by 2 union all select 'asset_id', asset_id, count(*) from segments where asset_id is not null group by 2)) where rank <= 10"))
def _(spark, d):
    return A.collection_summary(V.segments(spark, d), 10)


@R.add("a15_story_arc", sql("segments", f" select asset_id, array_to_string(list_filter([{','.join(repr(r) for r in A.ARC)}], lambda r: list_contains(have, r)), '>') as arc from (select asset_id, list(distinct role) as have from segments group by 1)"))
def _(spark, d):
    return A.story_arc(V.segments(spark, d))


@R.add("a16_material_bank", sql("segments", " select kind, name, count(*) as n, string_agg(cast(doc_id as varchar), ',' order by doc_id) as first_ids, cast(least(100, 45 + 10*count(*)) as bigint) as confidence from (select kind, name, doc_id, row_number() over (partition by kind, name order by doc_id) as r from (select 'mood' as kind, mood as name, segment_id as doc_id from segments union all select 'role', role, segment_id from segments)) where r <= 5 and name is not null group by 1, 2"))
def _(spark, d):
    seg = V.segments(spark, d)
    rows = seg.select(F.lit("mood").alias("kind"), F.col("mood").alias("name"), F.col("segment_id").alias("doc_id")).unionByName(seg.select(F.lit("role").alias("kind"), F.col("role").alias("name"), F.col("segment_id").alias("doc_id")))
    return A.material_bank(rows.where("name is not null"))


@R.add("a18_segment_warnings", sql("segments", " select segment_id, array_to_string(list_filter([case when e - s > 30000 then 'long_segment' end, case when quality*10 < 5 then 'low_quality' end, case when segment_id % 4 = 0 then 'no_relationships' end], lambda x: x is not null), ',') as warnings from segments"))
def _(spark, d):
    rows = V.segments(spark, d).withColumns({"quality": F.col("quality") * 10, "n_edges": F.col("segment_id") % 4})
    return rows.select("segment_id", F.array_join(A.segment_warnings(), ",").alias("warnings"))


@R.add("a19_captions", sql("segments", " select segment_id, upper(role[1]) || role[2:] || ': ' || asset_id || '|' || substr(trim(summary), 1, 96) as captions from segments where trim(summary) <> ''"))
def _(spark, d):
    return V.segments(spark, d).where("trim(summary) <> ''").select("segment_id", F.array_join(A.captions(), "|").alias("captions"))


@R.add("a20_latest", sql("observations", " select asset_id, obs_id, s from (select *, row_number() over (partition by asset_id order by s desc, obs_id desc) as r from observations) where r = 1"))
def _(spark, d):
    return A.latest(V.observations(spark, d).select("asset_id", "obs_id", "s"), "asset_id", "s", "obs_id")


@R.add("a24_corpus_conflicts", sql("point_assets", " select o_orderkey as request_id, cast(o_orderkey*1000000000 as bigint) as asked, there from orders, (select cast(coalesce(sum(duration_ms), 0) as bigint) as there from point_assets where asset_id % 4 > 0) where o_orderkey % 3 > 0 and o_orderkey*1000000000 > there"))
def _(spark, d):
    requests = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") * 1_000_000_000).alias("asked"), (F.col("o_orderkey") % 3 == 0).alias("listed"))
    return A.corpus_conflicts(requests, _assets(spark, d))


@R.add("a27_override", "select doc_id, case when lang in ('en','fr') then lang else source end as name from documents")
def _(spark, d):
    docs = V.table(spark, d, "documents")
    given = docs.select("doc_id", F.when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise(" ").alias("name"))
    return A.override(docs.select("doc_id", F.col("source").alias("name")), given, "doc_id", "name")


def _vectors(spark, d):
    return V.table(spark, d, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("label").alias("asset_id"), "embedding", (F.col("vec_id") * 37 % 20_000).alias("s"), (F.col("vec_id") * 37 % 20_000 + 4000).alias("e"))


_COS = ", v as (select vec_id as segment_id, label as asset_id, embedding::double[64] as e, vec_id*37 % 20000 as t from embeddings), pr as (select a.segment_id as a, b.segment_id as b, a.asset_id = b.asset_id as same, array_cosine_similarity(a.e, b.e) as c from v a join v b on a.segment_id < b.segment_id and not (a.asset_id = b.asset_id and abs(a.t - b.t) < 4000) where array_cosine_similarity(a.e, b.e) >= 0.35), bth as (select a as src, b as dst, c, same from pr union all select b, a, c, same from pr), tk as (select *, row_number() over (partition by src order by c desc, dst) as r from bth), edges as (select distinct least(src,dst) as src, greatest(src,dst) as dst, case when c >= 0.45 then 'duplicates' when same then 'echoes_same_source' else 'echoes' end as type from tk where r <= 8)"


@R.add("g01_relate", sql("queries", _COS + " select * from edges"))
def _(spark, d):
    return G.relate(_vectors(spark, d), 0.35, 0.45, 8)


@R.add("g03_related", sql("queries", _COS + """, b2 as (select src as segment_id, dst as other, type from edges union select dst, src, type from edges) select * from (select segment_id, other, type, cast(row_number() over (partition by segment_id order by (segment_id + other) % 7 desc, other, type) as int) as rank from b2 where segment_id % 3 = 0 and other % 5 > 0) where rank <= 3"""))
def _(spark, d):
    vec = _vectors(spark, d)
    edges = G.relate(vec, 0.35, 0.45, 8).withColumn("confidence", (F.col("src") + F.col("dst")) % 7)
    return G.related(edges, vec.where("segment_id % 3 = 0").select("segment_id"), vec.where("segment_id % 5 > 0").select("segment_id"), 3)


_REACH = _COS + ", und as (select src, dst from edges union select dst, src from edges), reach as (select src as node, src as seen from und union select r.node, u.dst from reach r join und u on u.src = r.seen)"


@R.add("g04_components", sql("queries", _REACH + " select node, min(seen) as comp from reach group by 1", recursive=True))
def _(spark, d):
    return G.components(G.relate(_vectors(spark, d), 0.35, 0.45, 8))


@R.add("a13_cluster_hints", sql("queries", _REACH + " select count(*) as n_clusters, max(n) as largest from (select comp, count(*) as n from (select node, min(seen) as comp from reach group by 1) group by 1)", recursive=True))
def _(spark, d):
    return G.cluster_hints(G.relate(_vectors(spark, d), 0.35, 0.45, 8))


@R.add("g05_index_edges", sql("words", ", ids as (select asset_id*1000 + pos as reply_id, i, (asset_id*1000 + pos)*100000 + i as segment_id from words), ed as (select reply_id, i as from_i, i*2 as to_i from ids) select ed.reply_id, a.segment_id as src, b.segment_id as dst from ed join ids a on a.reply_id = ed.reply_id and a.i = from_i join ids b on b.reply_id = ed.reply_id and b.i = to_i"))
def _(spark, d):
    reply = F.col("asset_id") * 1000 + F.col("pos")
    ids = V.words(spark, d).select(reply.alias("reply_id"), "i", (reply * 100_000 + F.col("i")).alias("segment_id"))
    return G.index_edges(ids.select("reply_id", F.col("i").alias("from_i"), (F.col("i") * 2).alias("to_i")), ids)


@R.add("g06_edge_packets", sql("queries", _COS + " select segment_id, string_agg(cast(other as varchar), ',' order by other) as others from (select *, row_number() over (partition by segment_id order by other) as r from (select src as segment_id, dst as other from edges union select dst, src from edges)) where r <= 5 group by 1"))
def _(spark, d):
    return G.edge_packets(G.relate(_vectors(spark, d), 0.35, 0.45, 8))


@R.add("g07_recontextualization_links", sql("plan_items", ", it as (select plan_id, pos, asset_id % 5 as beat_id, case when pos % 2 = 0 then segment_id % 5 end as rc from plan_items), f as (select plan_id, beat_id, min(pos) as fp from it group by 1, 2) select it.plan_id, it.pos, case when fp < pos then fp end as setup_pos, case when coalesce(fp < pos, false) then null else 'no earlier setup' end as warning from it left join f on f.plan_id = it.plan_id and f.beat_id = it.rc where rc is not null"))
def _(spark, d):
    items = V.plan_items(spark, d).select("plan_id", "pos", (F.col("asset_id") % 5).alias("beat_id"), F.when(F.col("pos") % 2 == 0, F.col("segment_id") % 5).alias("recontextualizes"))
    return G.recontextualization_links(items)


@R.add("g08_plan_lineage", "with recursive p as (select o_orderkey as plan_id, case when o_orderkey % 4 > 0 then o_orderkey // 4 end as parent from orders), up as (select plan_id, parent as ancestor, 1 as depth from p where parent is not null union all select up.plan_id, p.parent, depth + 1 from up join p on p.plan_id = up.ancestor where p.parent is not null and depth < 100) select * from up")
def _(spark, d):
    plans = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), F.when(F.col("o_orderkey") % 4 > 0, F.expr("o_orderkey div 4")).alias("parent_plan_id"))
    return G.plan_lineage(plans)


@R.add("g09_embedding_text", sql("segments", " select segment_id, substr(concat_ws(' ', nullif(substr(summary,1,200),''), nullif(role,''), nullif(substr(summary,201,200),'')), 1, 300) as text from segments"))
def _(spark, d):
    return V.segments(spark, d).select("segment_id", G.embedding_text(F.substring("summary", 1, 200), F.col("role"), F.substring("summary", 201, 200)).alias("text"))


@R.add("g10_id_from_uri", "select page_id, replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '-', '_') as id from pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", G.id_from_uri(F.col("url"), "https?://", "[?#].*").alias("id"))

