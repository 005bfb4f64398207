"""Scans, ingest outcomes, idempotent rewrites, cards: tables keyed by path or (asset, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings of media, any case.
EXTENSIONS = ["mp4", "mov", "mkv", "avi", "m4v"]


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, modified, sha of the media files under a folder, each path once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(EXTENSIONS))
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha")).dropDuplicates(["path"])


def stable_id(path: Column) -> Column:
    """asset_ and the first 16 hex digits of the path's sha256."""
    return F.concat(F.lit("asset_"), F.substring(F.sha2(path, 256), 1, 16))


def duplicates(files: DataFrame) -> DataFrame:
    """sha, n, first_path of contents that more than one path has."""
    return files.groupBy("sha").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


_PROBE = "struct<format:struct<duration:string,size:string,tags:struct<creation_time:string>>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,tags:struct<creation_time:string>>>>"


def normalize_probe(raw: Column) -> Column:
    """struct(duration_ms, fps, width, height, video_codec, audio_codec, has_audio, created) of a probe's JSON: first video and first audio stream; a rate of x/0 is null."""
    p = F.from_json(raw, _PROBE)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), 0)
    audio = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), 0)
    rate = F.split(video["avg_frame_rate"], "/")
    down = F.coalesce(F.get(rate, 1).try_cast("double"), F.lit(1.0))
    fps = F.when(down != 0, F.round(F.get(rate, 0).try_cast("double") / F.when(down != 0, down), 6))
    ms = F.round(p["format"]["duration"].try_cast("double") * 1000).cast("long")
    created = F.coalesce(p["format"]["tags"]["creation_time"], video["tags"]["creation_time"])
    return F.struct(ms.alias("duration_ms"), fps.alias("fps"), video["width"].alias("width"), video["height"].alias("height"), video["codec_name"].alias("video_codec"), audio["codec_name"].alias("audio_codec"), audio.isNotNull().alias("has_audio"), created.alias("created"))


def classify_ingest(scan: DataFrame, existing: DataFrame) -> DataFrame:
    """Scan rows (path, size, sha) with outcome: created, updated or unchanged against what is known."""
    old = existing.select("path", F.col("size").alias("_size"), F.col("sha").alias("_sha"))
    same = (F.col("size") == F.col("_size")) & (F.col("sha") == F.col("_sha"))
    return scan.join(old, "path", "left").withColumn("outcome", F.when(F.col("_sha").isNull(), "created").when(same, "unchanged").otherwise("updated")).drop("_size", "_sha")


def upsert(scan: DataFrame, existing: DataFrame) -> DataFrame:
    """The assets after a scan: known ones keep asset_id and first_seen, new values where scanned, those not scanned stay."""
    a, b = existing.alias("a"), scan.alias("b")
    rows = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    return rows.select(pick("path").alias("path"), F.coalesce("a.asset_id", stable_id(F.col("b.path"))).alias("asset_id"), pick("size").alias("size"), pick("sha").alias("sha"), F.coalesce("a.first_seen", "b.seen").alias("first_seen"))


def list_assets(assets: DataFrame) -> DataFrame:
    """path, resolution (WxH or -), codec (or unknown), audio label, by path."""
    size = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))).otherwise("-")
    return assets.select("path", size.alias("resolution"), F.coalesce("codec", F.lit("unknown")).alias("codec"), F.when(F.col("has_audio"), "audio").otherwise("no audio").alias("audio")).orderBy("path")


def replace_by_source(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after each (asset_id, source) slice in ``fresh`` took the place of the old one."""
    return existing.join(fresh.select("asset_id", "source").distinct(), ["asset_id", "source"], "left_anti").unionByName(fresh)


def export_cards(segments: DataFrame, spans: DataFrame, bucket: int) -> DataFrame:
    """segment_id, card: a markdown card for each segment, with the lines of spans (text) that overlap it, in order."""
    from ..operators.intervals import overlap_join

    hit = overlap_join(segments.select("asset_id", "s", "e", "segment_id"), spans.select("asset_id", "s", "e", "text"), bucket)
    lines = hit.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("b_s", "text"))).alias("ls"))
    rows = segments.join(lines, "segment_id", "left")
    body = F.array_join(F.transform(F.coalesce("ls", F.array().cast("array<struct<b_s:bigint,text:string>>")), lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    return rows.select("segment_id", F.concat(F.lit("# "), F.col("segment_id").cast("string"), F.lit("\n"), body).alias("card"))
