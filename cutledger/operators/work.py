"""What is left to do, replies of annotators, and the job that ties them together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import remap_items


def pending(eligible: DataFrame, done: DataFrame, limit: int | None = None, force: bool = False) -> DataFrame:
    """Eligible assets (asset_id, path) not in ``done`` (all with ``force``); the limit counts after that, by path, so repeated runs get through the backlog."""
    rows = eligible if force else eligible.join(done.select("asset_id"), "asset_id", "left_anti")
    return rows.orderBy("path", "asset_id").limit(limit) if limit is not None else rows


def source_key(provider: str, facet: Column, version: str) -> Column:
    return F.concat_ws(":", F.lit(provider), facet, F.lit(version))


def pending_facets(assets: DataFrame, facets: list[str], done: DataFrame, provider: str, version: str) -> DataFrame:
    """asset_id, facet, source of each asset and facet without a source in ``done`` (asset_id, source)."""
    rows = assets.select("asset_id", F.explode(F.array(*map(F.lit, facets))).alias("facet"))
    rows = rows.withColumn("source", source_key(provider, F.col("facet"), version))
    return rows.join(done.select("asset_id", "source"), ["asset_id", "source"], "left_anti")


def video_ref(assets: DataFrame, artifacts: DataFrame) -> DataFrame:
    """asset_id, ref: the derived file if there is one (the first by path), else the original."""
    one = artifacts.groupBy("asset_id").agg(F.min("path").alias("_p"))
    return assets.join(one, "asset_id", "left").select("asset_id", F.coalesce("_p", "path").alias("ref"))


def eligible_large(assets: DataFrame, size: int, duration: int) -> DataFrame:
    return assets.where((F.coalesce("size", F.lit(0)) >= size) | (F.coalesce("duration_ms", F.lit(0)) >= duration)).where("status = 'ready'")


def path_contains(assets: DataFrame, part: str) -> DataFrame:
    """Assets whose path holds the part, ASCII case aside; no character is a wildcard."""
    return assets.where(F.contains(F.lower("path"), F.lit(part.lower())))


def moment_range(seconds: Column) -> Column:
    """struct(low, high): moments to ask for; (4, 8) where the duration is missing; halves round to even."""
    low = F.least(F.lit(16), F.greatest(F.lit(4), F.bround(seconds / 30))).cast("int")
    high = F.least(F.lit(16), F.greatest(low + 1, F.bround(seconds / 20).cast("int")))
    ok = seconds > 0
    return F.struct(F.when(ok, low).otherwise(4).alias("low"), F.when(ok, high).otherwise(8).alias("high"))


_ITEM = "struct<start_sec:double,end_sec:double,text:string,confidence:double>"


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantine) of replies (reply_id, raw): fences stripped, JSON read; a bare list is a list of items.

    parsed: reply_id, items (array). quarantine: reply_id, raw of what isn't JSON of an object or a list.
    """
    body = F.trim(F.coalesce(F.nullif(F.regexp_extract("raw", r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col("raw")))
    rows = replies.withColumn("body", body).withColumn("v", F.try_parse_json("body"))
    kind = F.substring("body", 1, 1)
    ok = F.col("v").isNotNull() & kind.isin("{", "[")
    wrapped = F.from_json("body", f"struct<observations:array<{_ITEM}>,segments:array<{_ITEM}>,spans:array<{_ITEM}>>")
    items = F.when(kind == "[", F.from_json("body", f"array<{_ITEM}>")).otherwise(F.coalesce(wrapped["observations"], wrapped["segments"], wrapped["spans"]))
    return rows.where(ok).select("reply_id", items.alias("items")), rows.where(~F.coalesce(ok, F.lit(False))).select("reply_id", "raw")


def explode_items(parsed: DataFrame, least: int = 100, default: int = 1000) -> DataFrame:
    """reply_id, i, s, e, text, confidence of the items with text: start 0 or more, end start + ``default`` where missing, ``least`` long; confidence 0.5 where missing or 0."""
    rows = parsed.select("reply_id", F.posexplode("items").alias("i", "x")).where("x is not null")
    s = F.greatest(F.coalesce(F.round(F.col("x.start_sec") * 1000), F.lit(0)), F.lit(0)).cast("long")
    e = F.coalesce(F.round(F.col("x.end_sec") * 1000).cast("long"), s + default)
    rows = rows.withColumns({"s": s, "e": F.greatest(e, s + least), "text": F.trim("x.text"), "confidence": F.coalesce(F.nullif("x.confidence", F.lit(0.0)), F.lit(0.5))})
    return rows.where("text <> ''").select("reply_id", "i", "s", "e", "text", "confidence")


def conform(replies: DataFrame, kinds: list[str], default: str) -> DataFrame:
    """reply_id, kind, target_ms, warnings, fallback of typed replies (reply_id, raw JSON with kind, target_sec): unknown kinds and bad targets fall back, with a warning each."""
    p = F.from_json("raw", "struct<kind:string,target_sec:double>")
    rows = replies.withColumn("p", p)
    known = F.coalesce(F.col("p.kind").isin(kinds), F.lit(False))
    good = F.coalesce(F.col("p.target_sec") > 0, F.lit(False))
    warnings = F.array_compact(F.array(F.when(~known, F.lit("unknown kind")), F.when(~good, F.lit("no target"))))
    return rows.select("reply_id", F.when(known, F.col("p.kind")).otherwise(default).alias("kind"), F.when(good, F.round(F.col("p.target_sec") * 1000)).otherwise(60_000).cast("long").alias("target_ms"), warnings.alias("warnings"), (~known & ~good).alias("fallback"))


def insert_select(rows: DataFrame) -> DataFrame:
    """Selects with role 'candidate' where missing, trims from the segment where missing or 0, 100 ms long at least."""
    s = F.coalesce(F.nullif("trim_s", F.lit(0)), F.col("s"))
    e = F.greatest(F.coalesce(F.nullif("trim_e", F.lit(0)), F.col("e")), s + 100)
    return rows.withColumns({"role": F.coalesce("role", F.lit("candidate")), "trim_s": s, "trim_e": e})


def annotate(units: DataFrame, done: DataFrame, fn: Callable[[list[dict]], list[str]], source: str, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, quarantine, done): units (asset_id, path, chunk, offset, length) of pending assets go to ``fn``, a batch at a time; it returns a JSON reply for each.

    Items come back on the asset's clock. An asset counts as done once all its replies could be read, found or not;
    a failed one stays pending. Returned tables are lazy: write the replies once before reading all three.
    """
    assets = pending(units.select("asset_id", "path").distinct(), done.where(F.col("source") == source), limit)
    todo = units.join(assets.select("asset_id"), "asset_id", "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["asset_id", "chunk"]].assign(raw=fn(f.to_dict("records")))

    asked = todo.select("asset_id", "path", "chunk", "offset", "length").mapInPandas(run, "asset_id long, chunk long, raw string")
    keyed = asked.withColumn("reply_id", F.struct("asset_id", "chunk"))
    parsed, bad = parse_replies(keyed)
    items = explode_items(parsed).select("reply_id.asset_id", "reply_id.chunk", "s", "e", "text", "confidence")
    rows = remap_items(items, units.select("asset_id", "chunk", "offset", "length")).withColumn("source", F.lit(source))
    failed = bad.select("reply_id.asset_id").distinct()
    finished = assets.select("asset_id").join(failed, "asset_id", "left_anti").withColumn("source", F.lit(source))
    return rows, bad.select("reply_id.asset_id", "reply_id.chunk", "raw"), finished


def eligible_long(assets: DataFrame, duration: int) -> DataFrame:
    return assets.where((F.col("duration_ms") > duration) & (F.col("status") == "ready"))


def completion_marks(runs: DataFrame) -> DataFrame:
    """asset_id, found of runs that ended well (status 'ok'), with or without a find; failed runs leave no mark."""
    return runs.where("status = 'ok'").groupBy("asset_id").agg((F.max("n_found") > 0).alias("found"))


def usable_segments(segments: DataFrame, assets: DataFrame) -> DataFrame:
    """Usable segments that start before their asset ends; without a duration, before their own end."""
    rows = segments.where("usable").join(assets.select("asset_id", "duration_ms"), "asset_id", "left")
    return rows.where(F.col("s") < F.coalesce("duration_ms", "e")).drop("duration_ms")


def word_units(units: Column, s: Column, e: Column) -> Column:
    """Units (text, s, e) with text and clamped to the segment; a missing end is the segment's; empty ones dropped."""
    clamped = F.transform(units, lambda u: F.struct(F.trim(u["text"]).alias("text"), F.greatest(s, F.coalesce(u["s"], s)).alias("s"), F.least(e, F.coalesce(u["e"], e)).alias("e")))
    return F.filter(clamped, lambda u: (F.coalesce(u["text"], F.lit("")) != "") & (u["e"] > u["s"]))


def explode_asr(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, words) of recogniser output (asset_id, segments array of s, e, text, words array of text, s, e, confidence).

    Spans are 50 ms long at least, with the mean confidence of their words; words need text and both times.
    """
    rows = replies.select("asset_id", F.posexplode("segments").alias("pos", "x"))
    heard = F.filter(F.col("x.words"), lambda w: (F.coalesce(F.trim(w["text"]), F.lit("")) != "") & w["s"].isNotNull() & w["e"].isNotNull())
    mean = F.aggregate(heard, F.lit(0.0), lambda a, w: a + w["confidence"]) / F.nullif(F.size(heard), F.lit(0))
    spans = rows.select("asset_id", "pos", F.col("x.s").alias("s"), F.greatest(F.col("x.e"), F.col("x.s") + 50).alias("e"), F.trim("x.text").alias("text"), F.round(mean, 4).alias("confidence")).where("text <> ''")
    words = rows.select("asset_id", "pos", F.posexplode(heard).alias("i", "w")).select("asset_id", "pos", "i", F.trim("w.text").alias("text"), "w.s", "w.e")
    return spans, words


def ledger(rows: DataFrame, kind: str, *keys: str) -> DataFrame:
    """kind, the keys, and each row's JSON body, ready to append."""
    return rows.select(F.lit(kind).alias("kind"), *keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias("body"))
