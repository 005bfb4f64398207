"""Filling a timeline exactly: an item that is cut is anchored and snapped again, and the rest goes on from its new length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import anchor_trim, overlap_join

_POINTS = "array<struct<t:bigint,reason:string>>"
_UNITS = "array<struct<text:string,s:bigint,e:bigint>>"
_ITEM = "struct<rank:bigint,s:bigint,e:bigint,at:bigint,cut:boolean>"


def with_surroundings(candidates: DataFrame, points: DataFrame, units: DataFrame, tolerance: int, bucket: int = 10_000) -> DataFrame:
    """Candidates (query_id, rank, asset_id, s, e, ...) with what a cut may move to: points (array of t, reason) and units (text, s, e) in reach of the range, and whether their asset has points where clips may start, or end."""
    key = ["query_id", "rank"]
    wide = candidates.select(*key, "asset_id", F.greatest(F.lit(0), F.col("s") - tolerance).alias("s"), (F.col("e") + tolerance + 1).alias("e"))
    near = overlap_join(wide, points.select("asset_id", F.col("t").alias("s"), (F.col("t") + 1).alias("e"), "reason"), bucket)
    near = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("b_s").cast("long").alias("t"), "reason"))).alias("points"))
    said = overlap_join(wide, units.select("asset_id", "s", "e", "text"), bucket)
    said = said.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("b_s").alias("s"), F.col("b_e").alias("e"), "text"))).alias("_units"))
    flags = points.groupBy("asset_id").agg(*[F.max(~F.col("reason").isin(*bad)).alias(n) for n, bad in (("some_in", ("gap_start", "word_end")), ("some_out", ("gap_end", "word_start")))])
    rows = candidates.join(near, key, "left").join(said, key, "left").join(flags, "asset_id", "left")
    units_of = F.transform("_units", lambda u: F.struct(u["text"].alias("text"), u["s"].cast("long").alias("s"), u["e"].cast("long").alias("e")))
    none = lambda t: F.array().cast(t)
    return rows.withColumns({"points": F.coalesce(F.col("points").cast(_POINTS), none(_POINTS)), "units": F.coalesce(units_of.cast(_UNITS), none(_UNITS))}).drop("_units")


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nearest(points: Column, t: Column, banned: tuple[str, str], some: Column, tolerance: int) -> Column:
    """struct(gap, back, reason) of the nearest point within ``tolerance`` (the later at a tie), banned reasons only where the asset has no other."""
    fit = F.filter(points, lambda p: (~p["reason"].isin(*banned) | ~F.coalesce(some, F.lit(False))) & (F.abs(p["t"] - t) <= tolerance))
    return F.array_min(F.transform(fit, lambda p: F.struct(F.abs(p["t"] - t).alias("gap"), (-p["t"]).alias("back"), p["reason"].alias("reason"))))


def snapped(c: Column, s: Column, e: Column, tolerance: int, least: int, margin: int) -> Column:
    """struct(s, e) of a range moved to its candidate's points, as ``snap_ranges`` does; as it was where it would be too short."""
    found = F.struct(_nearest(c["points"], s, ("gap_start", "word_end"), c["some_in"], tolerance).alias("a"), _nearest(c["points"], e, ("gap_end", "word_start"), c["some_out"], tolerance).alias("b"))

    def moved(v: Column) -> Column:
        to_s, to_e = -v["a"]["back"], -v["b"]["back"]
        new_s = F.when(v["a"]["reason"].isin("gap_end", "word_start"), F.greatest(to_s - margin, F.lit(0))).otherwise(F.coalesce(to_s, s))
        new_e = F.when(v["b"]["reason"].isin("gap_start", "word_end"), to_e + margin).otherwise(F.coalesce(to_e, e))
        ok = new_e - new_s >= least
        return F.struct(F.when(ok, new_s).otherwise(s).cast("long").alias("s"), F.when(ok, new_e).otherwise(e).cast("long").alias("e"))

    return _let(found, moved)


def exact_fill(candidates: DataFrame, budget: int, longest: int, tolerance: int = 500, least: int = 500, margin: int = 150) -> DataFrame:
    """query_id, rank, s, e, at, cut: candidates in rank order until the timeline is full.

    ``candidates``: query_id, rank, s, e, cap (or null), asset_ms (or null), hint, and what ``with_surroundings`` adds. A clip
    is kept within its asset, and as long as its range, ``longest``, its cap and what is left allow, 100 ms at least. One that
    has to be cut is cut around the word unit that its hint quotes, else its first, else to its middle, and snapped to cut points
    again, which may change its length (never past longest and cap): the next one starts where it really ends. A fold over
    a query's candidates, of which there are tens.
    """
    fields = {"rank": "bigint", "s": "bigint", "e": "bigint", "cap": "bigint", "asset_ms": "bigint", "hint": "string", "points": _POINTS, "units": _UNITS, "some_in": "boolean", "some_out": "boolean"}
    one = F.struct(*[F.col(c).cast(t).alias(c) for c, t in fields.items()])
    packed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("_c"))

    def step(state: Column, c: Column) -> Column:
        start = F.when(c["asset_ms"].isNotNull(), F.least(c["s"], F.greatest(F.lit(0), c["asset_ms"] - 100))).otherwise(c["s"])
        end = F.when(c["asset_ms"].isNotNull(), F.least(F.greatest(start + 100, c["e"]), c["asset_ms"])).otherwise(c["e"])
        most = F.least(F.lit(longest), F.coalesce(F.nullif(c["cap"], F.lit(0)), F.lit(longest)))

        def sized(r: Column) -> Column:
            length = F.greatest(F.lit(100), F.least(r["most"], r["e"] - r["s"], F.lit(budget) - state["cursor"]))
            return F.struct(r["s"].alias("s"), r["e"].alias("e"), r["most"].alias("most"), length.cast("long").alias("length"), (length < r["e"] - r["s"] - 10).alias("cut"))

        def placed(r: Column) -> Column:
            kept = anchor_trim(r["s"], r["e"], r["length"], c["units"], c["hint"])
            new = _let(kept, lambda k: snapped(c, k["s"], k["e"], tolerance, least, margin))
            held = _let(new, lambda k: F.struct(k["s"].alias("s"), (k["s"] + F.greatest(F.lit(100), F.least(k["e"], k["s"] + r["most"]) - k["s"])).cast("long").alias("e")))
            whole = F.struct(r["s"].alias("s"), (r["s"] + r["length"]).cast("long").alias("e"))
            return _let(F.when(r["cut"], held).otherwise(whole), lambda k: F.struct(c["rank"].alias("rank"), k["s"].alias("s"), k["e"].alias("e"), state["cursor"].alias("at"), r["cut"].alias("cut")).cast(_ITEM))

        item = _let(F.struct(start.cast("long").alias("s"), end.cast("long").alias("e"), most.cast("long").alias("most")), lambda r: _let(sized(r), placed))
        added = _let(item, lambda i: F.struct((state["cursor"] + i["e"] - i["s"]).cast("bigint").alias("cursor"), F.concat(state["items"], F.array(i)).cast(f"array<{_ITEM}>").alias("items")))
        return F.when(state["cursor"] < budget, added).otherwise(state)

    zero = F.struct(F.lit(0).cast("bigint").alias("cursor"), F.array().cast(f"array<{_ITEM}>").alias("items"))
    return packed.select("query_id", F.explode(F.aggregate("_c", zero, step)["items"]).alias("i")).select("query_id", "i.*")
