"""Queries over ingest, work selection, replies and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import work as P
from ..sources import ingest as S
from ..sources import views as V
from ..sources.shared import shared_dir
from ..streaming import feeds as R_
from .registry import Registry
from .sql import sql

R = Registry()

_SCAN = "select page_id, url as path, cast(length(html) as bigint) as size, sha256(html) as sha from pages where page_id in (select min(page_id) from pages group by url)"


def _scan(spark, d):
    pages = V.table(spark, d, "pages")
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return pages.join(first, ["url", "page_id"]).select("page_id", F.col("url").alias("path"), F.length("html").cast("long").alias("size"), F.sha2("html", 256).alias("sha"))


@R.add("s02_duplicates", "select sha, count(*) as n, min(path) as first_path from (select 'p' || page_id as path, sha256(split_part(html, '<title>', 1)) as sha from pages) group by 1 having count(*) > 1")
def _(spark, d):
    pages = V.table(spark, d, "pages")
    return S.duplicates(pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), F.sha2(F.split_part("html", F.lit("<title>"), F.lit(1)), 256).alias("sha")))


@R.add("s03_stable_id", "select page_id, 'asset_' || left(sha256(url), 16) as asset_id from pages")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.stable_id(F.col("url")).alias("asset_id"))


@R.add("s04_normalize_probe", "select event_id, event_id*10 as duration_ms, case when event_id % 5 = 0 then null else round((24000 + event_id % 3)/1001.0, 6) end as fps, cast(event_id % 100 + 1 as int) as width, event_id % 2 = 0 as has_audio from events")
def _(spark, d):
    i = F.col("event_id")
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), (i % 100 + 1).alias("width"), F.lit(10).alias("height"), F.concat_ws("/", (24_000 + i % 3).cast("string"), F.when(i % 5 == 0, "0").otherwise("1001")).alias("avg_frame_rate"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("int").alias("height"), F.lit("0/0").alias("avg_frame_rate"))
    raw = F.to_json(F.struct(F.struct(F.format_string("%d.%02d", F.expr("event_id div 100"), i % 100).alias("duration")).alias("format"), F.when(i % 2 == 0, F.array(audio, video)).otherwise(F.array(video)).alias("streams")))
    got = V.table(spark, d, "events").select("event_id", S.normalize_probe(raw).alias("p"))
    return got.select("event_id", "p.duration_ms", "p.fps", "p.width", "p.has_audio")


@R.add("s05_classify_ingest", f"with scan as ({_SCAN}) select path, size, case when page_id % 3 = 0 then 'created' when page_id % 5 = 0 then 'updated' else 'unchanged' end as outcome from scan")
def _(spark, d):
    scan = _scan(spark, d)
    old = scan.where("page_id % 3 > 0").select("path", F.when(F.col("page_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha")
    return S.classify_ingest(scan, old).select("path", "size", "outcome")


@R.add("s06_upsert_assets", f"with scan as ({_SCAN}) select path, case when page_id % 3 = 0 then 'asset_' || left(sha256(path), 16) else 'old' || cast(page_id as varchar) end as asset_id, case when page_id % 2 = 0 then size else size + 1 end as size, sha, case when page_id % 3 = 0 then 2 else 1 end as first_seen from scan where page_id % 2 = 0 or page_id % 3 > 0")
def _(spark, d):
    scan = _scan(spark, d)
    old = scan.where("page_id % 3 > 0").select("path", F.concat(F.lit("old"), F.col("page_id").cast("string")).alias("asset_id"), (F.col("size") + 1).alias("size"), "sha", F.lit(1).alias("first_seen"))
    return S.upsert(scan.where("page_id % 2 = 0").withColumn("seen", F.lit(2)), old)


@R.add("s07_ingest_summary", f"with scan as ({_SCAN}) select case when page_id % 3 = 0 then 'created' else 'unchanged' end as outcome, count(*) as n from scan group by 1")
def _(spark, d):
    scan = _scan(spark, d)
    return S.classify_ingest(scan, scan.where("page_id % 3 > 0")).groupBy("outcome").agg(F.count("*").alias("n"))


@R.add("s08_list_assets", "select url as path, case when page_id % 4 > 0 then cast(page_id % 4 as varchar) || 'x' || cast(page_id % 7 as varchar) else '-' end as resolution, case when page_id % 5 > 0 then 'c' || cast(page_id % 5 as varchar) else 'unknown' end as codec, case when page_id % 2 = 0 then 'audio' else 'no audio' end as audio from pages")
def _(spark, d):
    i = F.col("page_id")
    rows = V.table(spark, d, "pages").select(F.col("url").alias("path"), F.when(i % 4 > 0, i % 4).alias("width"), (i % 7).alias("height"), F.when(i % 5 > 0, F.concat(F.lit("c"), (i % 5).cast("string"))).alias("codec"), (i % 2 == 0).alias("has_audio"))
    return S.list_assets(rows)


def _raw(i):
    item = F.concat(F.lit('{"start_sec": '), (i % 100).cast("string"), F.lit('.5, "end_sec": '), F.when(i % 4 == 0, "null").otherwise((i % 100 + i % 3).cast("string")), F.lit(', "text": " t'), (i % 7).cast("string"), F.lit(' ", "confidence": '), F.when(i % 5 == 0, "0").otherwise("0.25"), F.lit("}"))
    return F.when(i % 10 == 9, F.lit("sorry, no answer")).when(i % 3 == 0, F.concat(F.lit("Here:\n```json\n["), item, F.lit("]\n```"))).when(i % 3 == 1, F.concat(F.lit('{"segments": ['), item, F.lit("]}"))).otherwise(F.concat(F.lit('{"observations": ['), item, F.lit("]}")))


def _replies(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("reply_id"), _raw(F.col("event_id")).alias("raw"))


@R.add("s09_quarantine", "select event_id as reply_id, 'sorry, no answer' as raw from events where event_id % 10 = 9")
def _(spark, d):
    return P.parse_replies(_replies(spark, d))[1]


@R.add("s11_explode_items", "select event_id as reply_id, 0 as i, (event_id % 100)*1000 + 500 as s, case when event_id % 4 = 0 then (event_id % 100)*1000 + 1500 else greatest((event_id % 100 + event_id % 3)*1000, (event_id % 100)*1000 + 600) end as e, 't' || cast(event_id % 7 as varchar) as text, case when event_id % 5 = 0 then 0.5 else 0.25 end::double as confidence from events where event_id % 10 <> 9")
def _(spark, d):
    return P.explode_items(P.parse_replies(_replies(spark, d))[0])


@R.add("s12_insert_select", sql("segments", " select segment_id, coalesce(case when segment_id % 2 = 0 then 'b_roll' end, 'candidate') as role, case when segment_id % 3 = 0 then s else s + 10 end as trim_s, greatest(case when segment_id % 4 = 0 then e else s + 20 end, case when segment_id % 3 = 0 then s else s + 10 end + 100) as trim_e from segments"))
def _(spark, d):
    i = F.col("segment_id")
    rows = V.segments(spark, d).select("segment_id", "s", "e", F.when(i % 2 == 0, "b_roll").alias("role"), F.when(i % 3 == 0, 0).otherwise(F.col("s") + 10).alias("trim_s"), F.when(i % 4 != 0, F.col("s") + 20).alias("trim_e"))
    return P.insert_select(rows).select("segment_id", "role", "trim_s", "trim_e")


@R.add("s14_replace_by_source", sql("observations", " select asset_id, facet as source, obs_id from observations where not (facet = 'click' and asset_id in (select asset_id from observations where facet = 'click' and obs_id % 2 = 0)) union all select asset_id, facet, obs_id + 1000000 from observations where facet = 'click' and obs_id % 2 = 0"))
def _(spark, d):
    rows = V.observations(spark, d).select("asset_id", F.col("facet").alias("source"), "obs_id")
    return S.replace_by_source(rows, rows.where("source = 'click' and obs_id % 2 = 0").withColumn("obs_id", F.col("obs_id") + 1_000_000))


@R.add("s15_export_cards", sql("spans words", ", x as (select sp.asset_id*1000 + sp.pos as segment_id, string_agg('- ' || w.text, chr(10) order by w.s, w.text) as body from spans sp join words w on w.asset_id = sp.asset_id and w.s < sp.e and sp.s < w.e group by 1) select sp.asset_id*1000 + sp.pos as segment_id, '# ' || cast(sp.asset_id*1000 + sp.pos as varchar) || chr(10) || coalesce(body, '') as card from spans sp left join x on x.segment_id = sp.asset_id*1000 + sp.pos"))
def _(spark, d):
    segments = V.spans(spark, d).select("asset_id", "s", "e", (F.col("asset_id") * 1000 + F.col("pos")).alias("segment_id"))
    return S.export_cards(segments, V.words(spark, d), 10_000)


@R.add("p01_pending", f"with scan as ({_SCAN}) select page_id as asset_id, path from scan where page_id % 3 > 0 order by path, page_id limit 25")
def _(spark, d):
    rows = _scan(spark, d).select(F.col("page_id").alias("asset_id"), "path")
    return P.pending(rows, rows.where("asset_id % 3 = 0"), 25)


@R.add("p03_pending_facets", f"with scan as ({_SCAN}) select page_id as asset_id, facet, 'mock:' || facet || ':v1' as source from scan, (values ('emotion_tone'),('objects_text'),('audio_character')) f(facet) where not (page_id % 2 = 0 and facet = 'objects_text')")
def _(spark, d):
    assets = _scan(spark, d).select(F.col("page_id").alias("asset_id"))
    done = assets.where("asset_id % 2 = 0").withColumn("source", F.lit("mock:objects_text:v1"))
    return P.pending_facets(assets, ["emotion_tone", "objects_text", "audio_character"], done, "mock", "v1").select("asset_id", "facet", "source")


@R.add("p04_video_ref", f"with scan as ({_SCAN}) select page_id as asset_id, case when page_id % 4 = 0 then 'proxy/' || cast(page_id as varchar) || '/a' else path end as ref from scan")
def _(spark, d):
    assets = _scan(spark, d).select(F.col("page_id").alias("asset_id"), "path")
    made = assets.where("asset_id % 4 = 0").select("asset_id", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("n")).select("asset_id", F.concat(F.lit("proxy/"), F.col("asset_id").cast("string"), F.lit("/"), "n").alias("path"))
    return P.video_ref(assets, made)


@R.add("p05_path_contains", "select page_id, url as path from pages where contains(lower(url), '/en/1')")
def _(spark, d):
    return P.path_contains(V.table(spark, d, "pages").select("page_id", F.col("url").alias("path")), "/EN/1")


@R.add("p06_eligible_large", sql("point_assets", " select asset_id, asset_id*1000 as size, case when asset_id % 2 = 0 then duration_ms end as duration_ms, 'ready' as status from point_assets where asset_id % 3 > 0 and (asset_id*1000 >= 50000 or coalesce(case when asset_id % 2 = 0 then duration_ms end, 0) >= 1000000)"))
def _(spark, d):
    i = F.col("asset_id")
    rows = V.point_assets(spark, d).select("asset_id", (i * 1000).alias("size"), F.when(i % 2 == 0, F.col("duration_ms")).alias("duration_ms"), F.when(i % 3 > 0, "ready").otherwise("failed").alias("status"))
    return P.eligible_large(rows, 50_000, 1_000_000)


@R.add("p12_moment_range", "select doc_id, case when n_chars > 0 then cast(least(16, greatest(4, round_even(n_chars/30.0, 0))) as int) else 4 end as low, case when n_chars > 0 then least(16, greatest(cast(least(16, greatest(4, round_even(n_chars/30.0, 0))) as int) + 1, cast(round_even(n_chars/20.0, 0) as int))) else 8 end as high from documents")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", P.moment_range(F.col("n_chars")).alias("r")).select("doc_id", "r.low", "r.high")


@R.add("q31_conform_replies", "select event_id as reply_id, case when event_id % 3 = 0 then 'assemble' when event_id % 3 = 1 then 'subtract' else 'assemble' end as kind, case when event_id % 4 > 0 then cast((event_id % 4)*1000 as bigint) else 60000 end as target_ms, array_to_string(list_filter([case when event_id % 3 = 2 then 'unknown kind' end, case when event_id % 4 = 0 then 'no target' end], lambda x: x is not null), ',') as warnings, event_id % 3 = 2 and event_id % 4 = 0 as fallback from events")
def _(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "assemble").when(i % 3 == 1, "subtract").otherwise("?")
    raw = F.concat(F.lit('{"kind": "'), kind, F.lit('", "target_sec": '), (i % 4).cast("string"), F.lit("}"))
    got = P.conform(V.table(spark, d, "events").select(i.alias("reply_id"), raw.alias("raw")), ["assemble", "subtract", "transform"], "assemble")
    return got.withColumn("warnings", F.array_join("warnings", ","))


def _reply(units: list[dict]) -> list[str]:
    """A stand-in annotator: one line for each unit, none for every seventh asset, no JSON for every eleventh."""
    out = []
    for u in units:
        if u["asset_id"] % 11 == 0:
            out.append("busy")
        elif u["asset_id"] % 7 == 0:
            out.append("[]")
        else:
            out.append('{"spans": [{"start_sec": 1, "end_sec": 2.5, "text": "unit %d"}]}' % u["chunk"])
    return out


@R.add("u01_annotate", sql("point_assets", " select asset_id, chunk, chunk*1000000 + 1000 as s, chunk*1000000 + 2500 as e, 'unit ' || cast(chunk as varchar) as text, 'mock' as source from point_assets, (values (0),(1)) c(chunk) where asset_id % 11 > 0 and asset_id % 7 > 0 and asset_id % 5 > 0"))
def _(spark, d):
    assets = V.point_assets(spark, d)
    units = assets.select("asset_id", F.concat(F.lit("f"), F.col("asset_id").cast("string")).alias("path"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("chunk"))
    units = units.withColumns({"offset": F.col("chunk") * 1_000_000, "length": F.lit(1_000_000).cast("long")})
    done = assets.where("asset_id % 5 = 0").select("asset_id", F.lit("mock").alias("source"))
    return P.annotate(units, done, _reply, "mock")[0].select("asset_id", "chunk", "s", "e", "text", "source")


def _drain(spark, build, d, last=None):
    """All rows of ``build``(stream of the events) over what is there now, through tables of the shared folder.

    Then the stream is taken up again with rows that say that nothing more comes (``last``; else one row a year on, of
    no asset, which moves the watermark), so that what was open comes out too.
    """
    work = f"{shared_dir(spark)}/cl_{uuid.uuid4().hex}"
    events = V.table(spark, d, "events").select(*_event())
    after = last if last is not None else events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("asset_id"), F.lit(None).cast("long").alias("obs_id"), (F.col("ts") + F.expr("interval 365 days")).alias("ts"), F.lit("end").alias("reason"))
    after = after.select(*[F.col(f.name).cast(f.dataType) for f in events.schema])
    after.limit(0).coalesce(1).write.parquet(f"{work}/after")
    more = spark.readStream.schema(events.schema).parquet(f"{work}/after")
    out = build(_stream(spark, d).unionByName(more))
    for again in range(2):
        q = out.writeStream.format("parquet").option("path", f"{work}/rows").option("checkpointLocation", f"{work}/progress").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if not again:
            after.write.mode("append").parquet(f"{work}/after")
    return spark.read.schema(out.schema).parquet(f"{work}/rows")


def _event():
    reasons = F.create_map(*[F.lit(x) for kv in V.REASONS.items() for x in kv])
    return [F.col("user_id").alias("asset_id"), F.col("event_id").alias("obs_id"), F.col("ts").cast("timestamp").alias("ts"), reasons[F.col("event_type")].alias("reason")]


def _stream(spark, d):
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}").select(*_event())


@R.add("r02_tumbling_activity", "select user_id as asset_id, epoch_ms(date_trunc('hour', ts)) as start_ms, count(*) as n from events group by 1, 2")
def _(spark, d):
    rows = _drain(spark, lambda s: R_.tumbling_activity(s, "1 hour", "1 minute"), d)
    return rows.select("asset_id", F.unix_millis("start").alias("start_ms"), "n")


@R.add("r03_speech_sessions", """with g as (select user_id as asset_id, epoch_us(ts) as t, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as gap from events),
 i as (select *, sum(case when gap is null or gap > 599999000 then 1 else 0 end) over (partition by asset_id order by t rows unbounded preceding) as k from g)
 select asset_id, min(t) // 1000 as start_ms, (max(t) + 599999000) // 1000 as finish_ms, count(*) as n from i group by asset_id, k""")
def _(spark, d):
    rows = _drain(spark, lambda s: R_.speech_sessions(s, 600_000, "1 minute"), d)
    return rows.select("asset_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("finish").alias("finish_ms"), "n")


@R.add("r06_first_replies", "select user_id as asset_id, event_id as obs_id from events")
def _(spark, d):
    return _drain(spark, lambda s: R_.first_replies(s, "10 minutes").select("asset_id", "obs_id"), d).where("asset_id is not null")


@R.add("r06_newest_slices", "select user_id as asset_id, event_type as source, event_id % 3 as version, event_id as i from events qualify event_id % 3 = max(event_id % 3) over (partition by user_id, event_type)")
def _(spark, d):
    """Each user's events of a type are a slice of three versions, which come newest, oldest, middle, and newest once more."""
    work = f"{shared_dir(spark)}/cl_{uuid.uuid4().hex}"
    rows = V.table(spark, d, "events").select(F.col("user_id").alias("asset_id"), F.col("event_type").alias("source"), (F.col("event_id") % 3).alias("version"), F.col("event_id").alias("i"))
    for n, version in enumerate((2, 0, 1, 2)):
        rows.where(F.col("version") == version).coalesce(1).write.parquet(f"{work}/in/part={n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in").select(*rows.columns)
    R_.replace_slices(stream, f"{work}/table", f"{work}/checkpoint").awaitTermination()
    return R_.newest_slices(spark.read.parquet(f"{work}/table")).select("asset_id", "source", "version", "i")


@R.add("r01_incremental_ingest", "select page_id as asset_id, md5(url) as path_key, length(html) as size from pages where page_id in (select max(page_id) from pages group by url)")
def _(spark, d):
    """Pages come as files; each batch is merged into the table by path, the newest page of a path wins, and a batch seen twice changes nothing."""
    work = f"{shared_dir(spark)}/cl_{uuid.uuid4().hex}"
    pages = V.table(spark, d, "pages")
    schema = pages.schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/page[s].parquet")  # a pattern: a file, or a folder of files
    state = {"at": None, "n": 0}

    def apply(batch):
        fresh = batch.select("page_id", "url", F.length("html").cast("long").alias("size"))
        old = spark.read.parquet(state["at"]) if state["at"] else fresh.limit(0)
        both = old.unionByName(fresh).groupBy("url").agg(F.max(F.struct("page_id", "size")).alias("r"))
        state["n"] += 1
        at = f"{work}/assets-{state['n']}"
        both.select("r.page_id", "url", "r.size").write.mode("overwrite").parquet(at)
        state["at"] = at

    for _ in range(2):  # the second finds nothing new
        R_.ingest(stream, apply, f"{work}/progress").awaitTermination()
    table = spark.read.schema("page_id long, url string, size long").parquet(state["at"])
    return table.select(F.col("page_id").cast(schema["page_id"].dataType).alias("asset_id"), F.md5("url").alias("path_key"), "size")
