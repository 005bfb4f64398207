"""Interval algebra on asset timelines, as joins, windows and grouped aggregates.

Times are integer milliseconds: s (start, inclusive) and e (end, exclusive). Every table has asset_id; assets has
duration_ms. All joins carry asset_id, and overlap joins a time bucket too, so a long asset spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .scans import scan, time_band

#: Pause between words that separates runs, and margins, in ms.
PAUSE, UNIT_TAIL, UNIT_HEAD = 120, 100, 50


def fixed_windows(assets: DataFrame, width: int) -> DataFrame:
    """asset_id, win, s, e: max(1, ceil(duration / width)) windows, the last one cut at the duration."""
    n = F.greatest(F.ceil(F.col("duration_ms") / width), F.lit(1)).cast("long")
    rows = assets.select("asset_id", "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("win"))
    return rows.select("asset_id", "win", (F.col("win") * width).alias("s"), F.least((F.col("win") + 1) * width, F.col("duration_ms")).alias("e"))


def overlap_join(a: DataFrame, b: DataFrame, bucket: int, how: str = "inner") -> DataFrame:
    """Pairs of rows of one asset with a.s < b.e and b.s < a.e; columns of ``b`` other than asset_id must have names of their own, but its s and e become b_s, b_e.

    Each side is dealt to the time buckets it touches; a pair counts in the later of the two first buckets only.
    """
    right = _dealt(b.withColumnRenamed("s", "b_s").withColumnRenamed("e", "b_e"), bucket, "b_s", "b_e", "_fb")
    if how == "left":
        keyed = a.withColumn("_row", F.monotonically_increasing_id())
        hit = overlap_join(keyed, b, bucket)
        return keyed.join(hit.drop(*[c for c in a.columns]), "_row", "left").drop("_row")
    left = _dealt(a, bucket, "s", "e", "_fa")
    out = left.join(right, ["asset_id", "_bucket"]).where("s < b_e and b_s < e and _bucket = greatest(_fa, _fb)")
    return out.drop("_bucket", "_fa", "_fb")


def first_overlaps(a: DataFrame, b: DataFrame, bucket: int, n: int) -> DataFrame:
    """key, b_s, text: the first ``n`` rows of ``b`` (asset_id, s, e, text; by start, then text) that overlap a row of ``a`` (key, asset_id, s, e), at least.

    As ``overlap_join`` deals them, but a bucket sends ``n`` rows of ``b`` for a row of ``a`` at most: a key that touches more
    buckets may have more than ``n``, and among them are its first.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": left.column("key").slice(0, 0), "b_s": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        right = right.take(pc.sort_indices(right, [("b_s", "ascending"), ("text", "ascending")], null_placement="at_start"))
        s, e, fa, bucket_ = (left.column(c).to_numpy() for c in ("s", "e", "_fa", "_bucket"))
        b_s, b_e, fb = (right.column(c).to_numpy() for c in ("b_s", "b_e", "_fb"))
        rows, places = [], []
        for i in range(len(s)):
            upto = int(np.searchsorted(b_s, e[i], "left"))
            hit = b_e[:upto] > s[i]
            if fa[i] != bucket_[i]:  # those of earlier buckets were met there
                hit &= fb[:upto] == bucket_[i]
            at = np.flatnonzero(hit)[:n]
            rows.append(np.full(len(at), i))
            places.append(at)
        return pa.table({"key": left.column("key").take(pa.array(np.concatenate(rows))), "b_s": right.column("b_s").take(pa.array(np.concatenate(places))), "text": right.column("text").take(pa.array(np.concatenate(places)))})

    right = _dealt(b.select("asset_id", F.col("s").cast("long").alias("b_s"), F.col("e").cast("long").alias("b_e"), "text").where("asset_id is not null and b_s is not null and b_e is not null"), bucket, "b_s", "b_e", "_fb")
    left = _dealt(a.select("asset_id", "key", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).where("asset_id is not null and s is not null and e is not null"), bucket, "s", "e", "_fa")
    return left.groupBy("asset_id", "_bucket").cogroup(right.groupBy("asset_id", "_bucket")).applyInArrow(run, f"key {dict(a.dtypes)['key']}, b_s long, text string")


def _dealt(df: DataFrame, bucket: int, s: str, e: str, first: str) -> DataFrame:
    """A row for each time bucket that it touches, with the first of them."""
    low = F.floor(F.col(s) / bucket)
    return df.withColumn(first, low).withColumn("_bucket", F.explode(F.sequence(low, F.greatest(low, F.floor((F.col(e) - 1) / bucket)))))


def coverage_ratio(windows: DataFrame, ranges: DataFrame, width: int, name: str = "ratio") -> DataFrame:
    """Windows with the share that ranges cover, in ten-thousandths (long), at most 10000; overlapping ranges count twice first."""
    hit = overlap_join(windows.select("asset_id", "win", "s", "e"), ranges.select("asset_id", "s", "e"), width)
    part = F.least("e", "b_e") - F.greatest("s", "b_s")
    sums = hit.groupBy("asset_id", "win").agg(F.sum(part).alias("_covered"))
    share = F.least(F.lit(10_000).cast("long"), F.floor((F.coalesce("_covered", F.lit(0)) * 20_000 + (F.col("e") - F.col("s"))) / (2 * (F.col("e") - F.col("s")))).cast("long"))
    return windows.join(sums, ["asset_id", "win"], "left").withColumn(name, F.when(F.col("e") > F.col("s"), share).otherwise(F.lit(0).cast("long"))).drop("_covered")


def window_activity(windows: DataFrame, silences: DataFrame, width: int) -> DataFrame:
    """silence (ten-thousandths), active = 10000 - silence (null where has_audio is false), priority = active or 0."""
    rows = coverage_ratio(windows, silences, width, "silence")
    active = F.when(F.col("has_audio"), 10_000 - F.col("silence"))
    return rows.withColumn("active", active).withColumn("priority", F.coalesce("active", F.lit(0).cast("long")))


def window_labels(activity: DataFrame) -> DataFrame:
    """asset_id, win, label, score, action: no_audio, or silence (0.8 or more), audio_active (0.2), high_energy (0.95)."""
    one = lambda ok, label, score, action: F.when(ok, F.struct(F.lit(label).alias("label"), score.alias("score"), F.lit(action).alias("action")))
    full = F.lit(10_000).cast("long")
    audio = F.col("has_audio")
    found = F.array_compact(F.array(
        one(~audio, "no_audio", full, "review"),
        one(audio & (F.col("silence") >= 8000), "silence", F.col("silence"), "cut_candidate"),
        one(audio & (F.col("active") >= 2000), "audio_active", F.col("active"), "keep_candidate"),
        one(audio & (F.col("active") >= 9500), "high_energy", F.col("active"), "review"),
    ))
    return activity.select("asset_id", "win", F.inline(found))


def pair_open_close(points: DataFrame, assets: DataFrame, opens: str = "gap_start", closes: str = "gap_end") -> DataFrame:
    """Ranges from an opening point to the next closing one; a later opening before it replaces the first; an unclosed
    one runs to the duration; closings without an opening are ignored. Clipped to the asset, empty ranges dropped."""
    return _pairs(points, assets, opens, closes).where("not orphan").select("asset_id", F.greatest("s", F.lit(0)).alias("s"), F.least("e", "duration_ms").alias("e")).where("e > s")


def gap_intervals(points: DataFrame, assets: DataFrame, least: int, opens: str = "gap_start", closes: str = "gap_end") -> DataFrame:
    """As ``pair_open_close``, but a closing point without an opening gives a range from 0 (``orphan``); ranges of under ``least`` are dropped."""
    return _pairs(points, assets, opens, closes).select("asset_id", "s", "e", "orphan").where(F.col("e") - F.col("s") >= least)


def _pairs(points: DataFrame, assets: DataFrame, opens: str, closes: str) -> DataFrame:
    rows = points.where(F.col("reason").isin(opens, closes))
    rows = scan(rows, ["t", "point_id"], band=time_band("t"), before=("lag", F.col("reason")), since=("lag", F.col("t")), next=("lead", F.col("reason"))).join(assets.select("asset_id", "duration_ms"), "asset_id")
    opened = F.coalesce(F.col("before") == opens, F.lit(False))
    closed = rows.where(F.col("reason") == closes).select("asset_id", "duration_ms", F.when(opened, F.col("since")).otherwise(0).alias("s"), F.col("t").alias("e"), (~opened).alias("orphan"))
    tail = rows.where((F.col("reason") == opens) & F.col("next").isNull()).select("asset_id", "duration_ms", F.col("t").alias("s"), F.col("duration_ms").alias("e"), F.lit(False).alias("orphan"))
    return closed.unionByName(tail)


def chunk_plan(assets: DataFrame, length: int, least: int) -> DataFrame:
    """asset_id, chunk, s, e: contiguous chunks; one for an asset of at most ``least``; a tail under 15 % of ``length`` joins the chunk before."""
    d = F.coalesce("duration_ms", F.lit(0))
    n = F.when((d <= least) | (d <= 0), 1).otherwise(F.ceil(d / length)).cast("long")
    tail = d - (n - 1) * length
    n = F.when((n >= 2) & (tail * 100 < length * 15), n - 1).otherwise(n)
    rows = assets.withColumn("n", n).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    last = F.col("chunk") == F.col("n") - 1
    return rows.select("asset_id", "chunk", (F.col("chunk") * length).alias("s"), F.when(last, F.greatest(d, F.lit(0))).otherwise((F.col("chunk") + 1) * length).cast("long").alias("e"))


def resolve_units(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """asset_id, chunk, offset, length: an asset's chunks, or the whole asset at offset 0 where it has none."""
    rows = assets.select("asset_id", "duration_ms").join(chunks.select("asset_id", "chunk", "s", "e"), "asset_id", "left")
    return rows.select("asset_id", F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"), F.coalesce("s", F.lit(0).cast("long")).alias("offset"), F.coalesce(F.greatest(F.col("e") - F.col("s"), F.lit(0)), F.col("duration_ms")).alias("length"))


def remap_items(items: DataFrame, units: DataFrame, least: int = 50, default: int = 1000) -> DataFrame:
    """Items (asset_id, chunk, s, e, ...) moved from their unit's clock to the asset's: clamped to the unit, ``least`` long, a missing end is start + ``default``."""
    rows = items.join(units, ["asset_id", "chunk"])
    roof = F.when(F.col("length") > 0, F.col("length"))
    s0, s1 = F.coalesce("s", F.lit(0)), F.greatest(F.coalesce("s", F.lit(0)), F.lit(0))
    start = F.coalesce(F.least(s1, roof), s1)
    long = F.greatest(start + least, F.coalesce("e", s0 + default))
    end = F.coalesce(F.least(long, roof), long)
    return rows.withColumns({"s": (start + F.col("offset")).cast("long"), "e": (end + F.col("offset")).cast("long")}).drop("offset", "length")


def remap_edges(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Edges (asset_id, chunk, from_i, to_i) shifted by the number of segments in earlier chunks; those out of their own chunk's range are dropped. ``counts``: asset_id, chunk, n."""
    before = Window.partitionBy("asset_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = edges.join(shift, ["asset_id", "chunk"]).where("from_i >= 0 and to_i >= 0 and from_i < n and to_i < n")
    return rows.select("asset_id", "chunk", (F.col("from_i") + F.col("shift")).alias("from_i"), (F.col("to_i") + F.col("shift")).alias("to_i"))


def clamp_ranges(items: DataFrame, assets: DataFrame, least: int, default: int) -> DataFrame:
    """s, e clipped to the asset, at least ``least`` long, a missing end start + ``default``."""
    rows = items.join(assets.select("asset_id", "duration_ms"), "asset_id", "left")
    s = F.greatest(F.coalesce("s", F.lit(0)), F.lit(0))
    s = F.when(F.col("duration_ms").isNotNull(), F.least(s, F.col("duration_ms"))).otherwise(s)
    e = F.greatest(F.coalesce("e", s + default), s + least)
    e = F.when(F.col("duration_ms").isNotNull(), F.greatest(F.least(e, F.col("duration_ms")), s)).otherwise(e)
    return rows.withColumns({"s": s.cast("long"), "e": e.cast("long")}).drop("duration_ms")


def word_boundary_points(words: DataFrame, assets: DataFrame, pause: int = PAUSE) -> DataFrame:
    """asset_id, t, reason: starts after, ends before a pause of ``pause`` or more (the first start and last end always), inside the asset."""
    rows = scan(words, ["s", "e", "pos", "i"], prev=("lag", F.col("e")), next=("lead", F.col("s"))).join(assets.select("asset_id", "duration_ms"), "asset_id", "left")
    start = F.when(F.col("prev").isNull() | (F.col("s") - F.col("prev") >= pause), F.struct(F.col("s").alias("t"), F.lit("word_start").alias("reason")))
    end = F.when(F.col("next").isNull() | (F.col("next") - F.col("e") >= pause), F.struct(F.col("e").alias("t"), F.lit("word_end").alias("reason")))
    return rows.select("asset_id", "duration_ms", F.inline(F.array_compact(F.array(start, end)))).where("t > 0 and (duration_ms is null or t < duration_ms)").select("asset_id", "t", "reason")


def speech_runs(words: DataFrame, pause: int = PAUSE) -> DataFrame:
    """asset_id, run, s, e, n_words: runs of words with pauses of under ``pause``, by the end of the word before."""
    order = ["s", "e", "pos", "i"]
    fresh = F.coalesce((F.col("s") - F.col("prev") >= pause).cast("int"), F.lit(1))
    rows = scan(scan(words, order, keep=True, prev=("lag", F.col("e"))), order, run=("sum_to", fresh))
    return rows.groupBy("asset_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n_words"))


def snap_points(targets: DataFrame, points: DataFrame, tolerance: int, t: str = "t") -> DataFrame:
    """Targets (asset_id, target_id, ``t``, ...) with the nearest point within ``tolerance`` (the later at a tie): snapped, reason; null where none is.

    An equi-join on asset and a bucket of the tolerance's width; the nearest comes from an aggregate, not a sort.
    """
    near = points.select("asset_id", F.col("t").alias("_pt"), F.col("reason").alias("_reason")).withColumn("_b", F.floor(F.col("_pt") / tolerance))
    spread = targets.select("asset_id", "target_id", F.col(t).alias("_t")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_t") / tolerance) - 1, F.floor(F.col("_t") / tolerance) + 1)))
    gap = F.abs(F.col("_pt") - F.col("_t"))
    best = spread.join(near, ["asset_id", "_b"]).where(gap <= tolerance).groupBy("asset_id", "target_id").agg(F.min(F.struct(gap.alias("gap"), F.negative("_pt").alias("back"), F.col("_reason").alias("reason"))).alias("best"))
    best = best.select("asset_id", "target_id", F.negative("best.back").alias("snapped"), "best.reason")
    return targets.join(best, ["asset_id", "target_id"], "left")


def snap_ranges(ranges: DataFrame, points: DataFrame, tolerance: int = 1000, least: int = 500, margin: int = 150) -> DataFrame:
    """Ranges (asset_id, target_id, s, e) with new_s, new_e, s_reason, e_reason.

    Starts avoid gap_start and word_end, ends avoid gap_end and word_start, unless the asset has no other points.
    Snaps to a gap or a word keep ``margin`` of the pause. A range left under ``least`` long is not snapped at all.
    """
    flags = points.groupBy("asset_id").agg(*[F.max(~F.col("reason").isin(*bad)).alias(n) for n, bad in (("some_in", ("gap_start", "word_end")), ("some_out", ("gap_end", "word_start")))])
    marked = points.join(flags, "asset_id")
    ins = marked.where(~F.col("reason").isin("gap_start", "word_end") | ~F.col("some_in"))
    outs = marked.where(~F.col("reason").isin("gap_end", "word_start") | ~F.col("some_out"))
    rows = snap_points(ranges, ins, tolerance, "s").withColumnsRenamed({"snapped": "to_s", "reason": "s_reason"})
    rows = snap_points(rows, outs, tolerance, "e").withColumnsRenamed({"snapped": "to_e", "reason": "e_reason"})
    quiet_in = F.col("s_reason").isin("gap_end", "word_start")
    quiet_out = F.col("e_reason").isin("gap_start", "word_end")
    new_s = F.when(quiet_in, F.greatest(F.col("to_s") - margin, F.lit(0))).otherwise(F.coalesce("to_s", "s"))
    new_e = F.when(quiet_out, F.col("to_e") + margin).otherwise(F.coalesce("to_e", "e"))
    ok = new_e - new_s >= least
    return rows.select("asset_id", "target_id", "s", "e", F.when(ok, new_s).otherwise(F.col("s")).alias("new_s"), F.when(ok, new_e).otherwise(F.col("e")).alias("new_e"), F.when(ok, F.col("s_reason")).alias("s_reason"), F.when(ok, F.col("e_reason")).alias("e_reason"))


def anchor_trim(s: Column, e: Column, budget: Column, units: Column, hint: Column) -> Column:
    """struct(s, e) of the part that stays when a range is cut to ``budget``: around the unit that ``hint`` quotes, else the first unit in the range, else the middle.

    ``units``: array of (text, s, e) in order. A budget within 10 ms of the range leaves it whole.
    """
    inside = F.filter(units, lambda u: (u["e"] > u["s"]) & (u["s"] >= s - 10) & (u["s"] < e))
    quoted = F.filter(inside, lambda u: (u["text"] != "") & F.contains(F.lower(hint), F.lower(u["text"])))
    chosen = F.coalesce(F.get(quoted, 0), F.get(inside, 0))
    latest = e - budget
    start = F.when(chosen.isNotNull(), F.least(chosen["s"] - 300, latest)).otherwise(F.floor((s + e - budget) / 2))
    start = F.greatest(s, F.least(start, latest))
    whole = budget >= e - s - 10
    return F.struct(F.when(whole, s).otherwise(start).cast("long").alias("s"), F.when(whole, e).otherwise(start + budget).cast("long").alias("e"))


def islands(ranges: DataFrame, fresh: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``island``: a new one starts at a range whose start s and largest end before, ``prev``, make ``fresh(s, prev)`` hold, or at the first.

    ``fresh`` has to stay true as s grows. Islands are found within time bands first. Of those, what starts too close to the
    largest end of the bands before goes on with the island that was open there, which a row a band tells.
    """
    within = Window.partitionBy("asset_id", "_band").orderBy("s", "e")
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.withColumn("_band", time_band()).withColumn("_prev", F.max("e").over(before))
    rows = rows.withColumn("_fresh", F.col("_prev").isNull() | fresh(F.col("s"), F.col("_prev")))
    rows = rows.withColumns({"_n": F.sum(F.col("_fresh").cast("int")).over(upto), "_from": F.max(F.when(F.col("_fresh"), F.col("s"))).over(upto), "_max": F.max("e").over(upto), "_last": F.lead(F.lit(1)).over(within).isNull()})
    rows = written(rows.drop("_prev", "_fresh"), "islands")
    along = Window.partitionBy("asset_id").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("_end").isNull() | fresh(F.col("_from"), F.col("_end")), F.struct("_band", "_n"))
    bands = rows.where("_last").select("asset_id", "_band", "_from", "_n", F.max("_max").over(along).alias("_end"))
    bands = bands.select("asset_id", "_band", "_end", F.last(own, ignorenulls=True).over(along).alias("_open"))
    out = rows.join(bands, ["asset_id", "_band"]).withColumn("island", F.coalesce(own, "_open"))
    return out.select(*ranges.columns, "island")


def union_length(ranges: DataFrame, assets: DataFrame) -> DataFrame:
    """asset_id, covered: length of the union of an asset's ranges, clipped to its duration."""
    rows = ranges.select("asset_id", "s", "e").join(assets.select("asset_id", "duration_ms"), "asset_id")
    rows = rows.select("asset_id", F.greatest("s", F.lit(0)).alias("s"), F.when(F.col("duration_ms") > 0, F.least("e", "duration_ms")).otherwise(F.col("e")).alias("e")).where("e > s")
    merged = islands(rows, lambda s, prev: s > prev).groupBy("asset_id", "island").agg((F.max("e") - F.min("s")).alias("len"))
    return merged.groupBy("asset_id").agg(F.sum("len").alias("covered"))


def speech_density(assets: DataFrame, words: DataFrame, spans: DataFrame) -> DataFrame:
    """asset_id, basis, covered, duration_ms: words if any word covers anything, else spans, else 'none' with null."""
    by_word, by_span = union_length(words, assets), union_length(spans, assets)
    some = by_word.agg((F.count("*") > 0).alias("any_word")).crossJoin(by_span.agg((F.count("*") > 0).alias("any_span")))  # one row each
    rows = assets.select("asset_id", "duration_ms").join(by_word.withColumnRenamed("covered", "w"), "asset_id", "left").join(by_span.withColumnRenamed("covered", "p"), "asset_id", "left").crossJoin(F.broadcast(some))
    basis = F.when(F.col("any_word"), "word_alignments").when(F.col("any_span"), "transcript_spans").otherwise("none")
    covered = F.when(F.col("any_word"), F.coalesce("w", F.lit(0))).when(F.col("any_span"), F.coalesce("p", F.lit(0)))
    return rows.select("asset_id", basis.alias("basis"), covered.alias("covered"), "duration_ms")


def speechless_gaps(words: DataFrame, assets: DataFrame, least: int) -> DataFrame:
    """Gaps of ``least`` or more before the first word, between the end of one word and the start of the next, and after the last; assets without words have none."""
    rows = scan(words, ["s", "e", "pos", "i"], prev=("lag", F.col("e")), next=("lead", F.lit(1)))
    rows = rows.withColumns({"prev": F.coalesce("prev", F.lit(0)), "last": F.col("next").isNull()}).join(assets.select("asset_id", "duration_ms"), "asset_id")
    gaps = rows.select("asset_id", F.col("prev").alias("s"), F.col("s").alias("e")).unionByName(rows.where("last").select("asset_id", F.col("e").alias("s"), F.col("duration_ms").alias("e")))
    return gaps.where(F.col("e") - F.col("s") >= least)


def merge_removals(regions: DataFrame, gap: int) -> DataFrame:
    """Regions (asset_id, s, e, evidence array, why array, perhaps sliver) merged where the next starts less than ``gap`` after the largest end so far; evidence in order, whys once each."""
    rows = islands(regions.where("e > s"), lambda s, prev: s - prev >= gap)
    parts = F.array_sort(F.collect_list(F.struct("s", "e", "evidence", "why")))
    marks = [F.max(c).alias(c) for c in regions.columns if c == "sliver"]
    out = rows.groupBy("asset_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), parts.alias("parts"), *marks)
    flat = lambda n: F.flatten(F.transform("parts", lambda p: p[n]))
    return out.select("asset_id", "s", "e", flat("evidence").alias("evidence"), F.array_distinct(flat("why")).alias("why"), *[c for c in regions.columns if c == "sliver"])


def apply_margin(regions: DataFrame, margin: int, least: int) -> DataFrame:
    """Regions shrunk by ``margin`` on both sides; those left under ``least`` are dropped."""
    return regions.withColumns({"s": F.col("s") + margin, "e": F.col("e") - margin}).where(F.col("e") - F.col("s") >= least)


def complement(regions: DataFrame, assets: DataFrame) -> DataFrame:
    """asset_id, s, e: what the regions leave of [0, duration]; an asset without regions stays whole."""
    both = assets.select("asset_id", "duration_ms").join(regions.select("asset_id", F.col("s").alias("_s"), F.col("e").alias("_e")), "asset_id", "left")
    clip = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.least(F.col(c), F.col("duration_ms"))))
    rows = both.select("asset_id", "duration_ms", clip("_s").alias("s"), clip("_e").alias("e"))
    # kept, as a scan reads its rows twice and regions are the end of a chain
    rows = scan(rows, ["s", "e"], keep=True, cursor=("max_before", F.col("e")), next=("lead", F.lit(1)))
    rows = rows.withColumns({"cursor": F.coalesce("cursor", F.lit(0)), "last": F.col("next").isNull()})
    part = lambda s, e: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))
    parts = F.array(part(F.col("cursor"), F.col("s")), F.when(F.col("last"), part(F.greatest("cursor", F.coalesce("e", F.lit(0))), F.col("duration_ms"))))
    return rows.select("asset_id", F.inline(F.filter(parts, lambda p: p["e"] > p["s"])))


def absorb_slivers(removals: DataFrame, kept: DataFrame, assets: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(removals, with ``sliver`` where a kept part went into one, and kept) after kept parts of under ``least`` became removals, unless all of an asset's kept parts are so short."""
    short = F.col("e") - F.col("s") < least
    kept = written(kept, "kept")
    slivers = kept.where(short).join(kept.where(~short).select("asset_id").distinct(), "asset_id", "left_semi")
    why = F.concat(F.lit("kept sliver "), (F.col("e") - F.col("s")).cast("string"), F.lit(" ms is too short to keep"))
    slivers = slivers.select("asset_id", "s", "e", F.array().cast("array<string>").alias("evidence"), F.array(why).alias("why"), F.lit(True).alias("sliver"))
    merged = written(merge_removals(removals.select("asset_id", "s", "e", "evidence", "why", F.lit(False).alias("sliver")).unionByName(slivers), 1), "removals")
    return merged, complement(merged, assets)


def speech_islands(words: DataFrame, pause: int) -> DataFrame:
    """asset_id, s, e, units (array of s, e in order): words up to a pause of ``pause`` or more after the largest end before."""
    rows = islands(words.select("asset_id", "s", "e"), lambda s, prev: s - prev >= pause)
    return rows.groupBy("asset_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("units")).drop("island")


def guard_regions(kept: DataFrame, words: DataFrame, assets: DataFrame, bucket: int = 10_000) -> DataFrame:
    """Kept parts whose bounds fall inside a word let the word finish: start to 50 ms before it, end to 100 ms after it; a moved end may meet the next word.

    A bound meets only the words of its island, as an end moves by UNIT_TAIL past a word and so never over a pause of that length.
    """
    speech = speech_islands(words, UNIT_TAIL)
    key = ["asset_id", "s", "e"]

    def met(bound: str) -> DataFrame:
        points = kept.select("asset_id", F.col("s").alias("_s"), F.col("e").alias("_e"), F.col(bound).alias("s"), (F.col(bound) + 1).alias("e")).distinct()
        return overlap_join(points, speech, bucket).select("asset_id", F.col("_s").alias("s"), F.col("_e").alias("e"), F.col("units").alias(f"{bound}_units"))

    rows = kept.join(assets.select("asset_id", "duration_ms"), "asset_id").join(met("s"), key, "left").join(met("e"), key, "left")
    around = F.get(F.filter("s_units", lambda u: (u["s"] < F.col("s")) & (F.col("s") < u["e"])), 0)
    step = lambda end, u: F.when((u["s"] < end) & (end < u["e"]), F.least("duration_ms", u["e"] + UNIT_TAIL)).otherwise(end).cast("long")
    s = F.when(around.isNotNull(), F.greatest(F.lit(0), around["s"] - UNIT_HEAD)).otherwise(F.col("s")).cast("long")
    e = F.aggregate(F.coalesce("e_units", F.array().cast("array<struct<s:bigint,e:bigint>>")), F.col("e").cast("long"), step)
    return rows.select("asset_id", s.alias("s"), e.alias("e"))


def merge_kept(kept: DataFrame) -> DataFrame:
    """Kept parts joined where they touch."""
    return islands(kept, lambda s, prev: s > prev).groupBy("asset_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).where("e > s").select("asset_id", "s", "e")


def attach_evidence(kept: DataFrame, candidates: DataFrame, assets: DataFrame, bucket: int = 10_000) -> DataFrame:
    """asset_id, s, e, n_evidence, why: what ``kept`` leaves, with evidence and whys of the candidates that overlap it."""
    removed = written(complement(kept, assets), "gone")
    # the number is summed beside the parts, so that neither is dealt out where a caller drops what is made of it
    hits = overlap_join(removed, candidates.select("asset_id", "s", "e", "evidence", "why", F.size("evidence").alias("_n")), bucket)
    parts = F.array_sort(F.collect_list(F.struct("b_s", "b_e", "evidence", "why")))
    found = hits.groupBy("asset_id", "s", "e").agg(parts.alias("parts"), F.sum("_n").alias("_n"))
    rows = removed.join(found, ["asset_id", "s", "e"], "left")
    n = F.coalesce("_n", F.lit(0))
    whys = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["why"])))
    why = F.when(F.size(F.coalesce(whys, F.array().cast("array<string>"))) == 0, F.lit("margin or sliver consolidation around kept content")).otherwise(F.array_join(whys, "; "))
    return rows.select("asset_id", "s", "e", n.cast("long").alias("n_evidence"), why.alias("why"))


def kept_regions(candidates: DataFrame, assets: DataFrame, words: DataFrame | None = None, points: DataFrame | None = None, margin: int = 200, gap: int = 500, keep: int = 500, removal: int = 200, tolerance: int = 0) -> tuple[DataFrame, DataFrame]:
    """(kept, sources of what is removed): merge, margin, complement, slivers, snap, word guard, merge.

    What later steps read more than once is written to the shared folder.
    """
    clip = candidates.join(assets.select("asset_id", "duration_ms"), "asset_id")
    clip = clip.withColumns({"s": F.greatest(F.lit(0), "s"), "e": F.least("e", "duration_ms")}).where("e > s").drop("duration_ms")
    merged = written(merge_removals(clip, gap), "merged")
    padded = apply_margin(merged, margin, removal)
    kept = complement(padded, assets)
    final, after = absorb_slivers(padded, kept, assets, keep)
    sources = merged.unionByName(final.where("sliver").select(*merged.columns))
    if points is not None and tolerance > 0:
        named = after.withColumn("target_id", F.xxhash64("s", "e"))
        moved = snap_ranges(named, points, tolerance, keep).join(assets.select("asset_id", "duration_ms"), "asset_id")
        s = F.when((F.col("s") > 0) & F.col("s_reason").isNotNull(), F.greatest(F.lit(0), "new_s")).otherwise(F.col("s"))
        e = F.when((F.col("e") < F.col("duration_ms")) & F.col("e_reason").isNotNull(), F.least("duration_ms", "new_e")).otherwise(F.col("e"))
        after = moved.select("asset_id", s.alias("s"), e.alias("e"))
    if words is not None:
        after = guard_regions(written(after, "kept"), words, assets)
    return written(merge_kept(after), "kept"), sources


def subtract_regions(candidates: DataFrame, assets: DataFrame, words: DataFrame | None = None, points: DataFrame | None = None, **rules: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed with evidence), by the ``rules`` of ``kept_regions``; together they partition [0, duration]."""
    kept, sources = kept_regions(candidates, assets, words, points, **rules)
    return kept, attach_evidence(kept, sources, assets)


def kept_items(kept: DataFrame, removed: DataFrame, words: DataFrame, segments: DataFrame, bucket: int = 10_000) -> DataFrame:
    """asset_id, pos, s, e, at (timeline offset), n_words inside, segment_id (first that overlaps), cut_before, cut_after (a removal within 50 ms)."""
    rows = scan(kept, ["s", "e"], pos=("sum_to", F.lit(1)), at=("sum_to", F.col("e") - F.col("s")))
    rows = rows.withColumns({"pos": F.col("pos").cast("int"), "at": F.col("at") - (F.col("e") - F.col("s"))})
    key = ["asset_id", "s", "e"]
    inside = overlap_join(kept, words.select("asset_id", "s", "e"), bucket).where("b_s >= s and b_e <= e").groupBy(*key).agg(F.count("*").alias("n_words"))
    first = overlap_join(kept, segments.select("asset_id", "s", "e", "segment_id"), bucket).groupBy(*key).agg(F.min(F.struct("b_s", "segment_id")).alias("f")).select(*key, "f.segment_id")
    ends, starts = removed.select("asset_id", F.col("e").alias("edge")), removed.select("asset_id", F.col("s").alias("edge"))
    slot = lambda c: F.floor(c / 50)

    def near(side: DataFrame, c: str) -> DataFrame:
        around = kept.withColumn("_slot", F.explode(F.array(slot(F.col(c)) - 1, slot(F.col(c)), slot(F.col(c)) + 1)))
        return around.join(side.withColumn("_slot", slot(F.col("edge"))), ["asset_id", "_slot"]).where(F.abs(F.col("edge") - F.col(c)) <= 50).select(*key).distinct()

    rows = rows.join(inside, key, "left").join(first, key, "left").join(near(ends, "s").withColumn("cut_before", F.lit(True)), key, "left").join(near(starts, "e").withColumn("cut_after", F.lit(True)), key, "left")
    return rows.withColumns({"n_words": F.coalesce("n_words", F.lit(0)), "cut_before": F.coalesce("cut_before", F.lit(False)), "cut_after": F.coalesce("cut_after", F.lit(False))})


def respect_word_units(s: Column, e: Column, most: Column, units: Column) -> Column:
    """The end, moved so that it cuts no unit (array of s, e in order): to 100 ms after it where ``most`` allows, else to 50 ms before it (500 ms after the start at least)."""

    def step(end: Column, u: Column) -> Column:
        out = F.when(u["e"] + UNIT_TAIL <= s + most, u["e"] + UNIT_TAIL).otherwise(F.greatest(s + 500, u["s"] - UNIT_HEAD))
        return F.when((u["s"] < end) & (end < u["e"]), out).otherwise(end).cast("long")

    return F.aggregate(units, e.cast("long"), step)


def clamped_range(s: Column, e: Column, asset_ms: Column) -> Column:
    """struct(s, e) of a final item: within its asset where that is known, 100 ms long at least."""
    start = F.when(asset_ms.isNotNull(), F.least(s, F.greatest(F.lit(0), asset_ms - 100))).otherwise(s)
    end = F.when(asset_ms.isNotNull(), F.least(F.greatest(start + 100, e), asset_ms)).otherwise(e)
    return F.struct(start.cast("long").alias("s"), F.when(end - start < 100, start + 100).otherwise(end).cast("long").alias("e"))


def rational_time(ms: Column, rate: Column) -> Column:
    """struct(value, rate): frames at ``rate`` (30 where it is missing or not positive), to the thousandth."""
    r = F.when(rate > 0, rate).otherwise(F.lit(30.0))
    return F.struct(F.round(ms * r / 1000, 3).alias("value"), r.cast("double").alias("rate"))
