"""Sequence planning for many plans at once; times in ms, intensities and weights in ten-thousandths.

Tables of items have plan_id and pos. Windows and folds run per plan, which has tens of items.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DIRECTIONS, SHOT_SIZES, strings, terms
from .intervals import respect_word_units
from .revise import place_of

# Weight and cap multiplier (hundredths) of a role where a beat has no intensity.
PACING = {"hook": (80, 100), "reaction": (80, 100), "performance": (110, 150), "emotion": (120, 175), "payoff": (140, 200)}
DEFAULT_PACING = (100, 150)
MIN_ENDING = 2000
MUSIC = ["music_bed", "abrupt_song_change"]


def by_pos():  # noqa: ANN201
    return Window.partitionBy("plan_id").orderBy("pos")


def whole():  # noqa: ANN201
    return Window.partitionBy("plan_id")


def expand_beats(beats: DataFrame) -> DataFrame:
    """Slots of beats (plan_id, beat_no, beat_id, pattern, lanes array, count, lo, hi): slot_id, occurrence, total, lane, intensity.

    alternate goes round the lanes (default twice each), repeat and others keep the first; the number comes from
    ``count``, else from an id such as b3-b7, else from the pattern. Intensity ramps from lo to hi (or stays lo).
    """
    span = F.regexp_extract("beat_id", r"^[a-zA-Z_]*(\d+)\s*-\s*[a-zA-Z_]*(\d+)$", 1), F.regexp_extract("beat_id", r"^[a-zA-Z_]*(\d+)\s*-\s*[a-zA-Z_]*(\d+)$", 2)
    low, high = (F.expr(f"try_cast({'lo_id' if i == 0 else 'hi_id'} as bigint)") for i in range(2))
    rows = beats.withColumns({"lo_id": span[0], "hi_id": span[1]})
    default = F.when(F.col("pattern") == "alternate", 2 * F.size("lanes")).otherwise(2)
    n = F.when(F.coalesce("count", F.lit(0)) != 0, F.greatest(F.lit(1), "count")).when(high >= low, high - low + 1).otherwise(F.greatest(F.lit(1), default))
    total = F.when(F.col("pattern").isin("alternate", "repeat"), n).otherwise(1).cast("int")
    rows = rows.withColumn("total", total).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    lane = F.when(F.col("pattern") == "alternate", F.get("lanes", F.expr("i % size(lanes)"))).otherwise(F.get("lanes", 0))
    slot = F.when(F.col("total") > 1, F.concat("beat_id", F.lit("#"), (F.col("i") + 1).cast("string"))).otherwise(F.col("beat_id"))
    rows = rows.withColumn("intensity", resolve_intensity(F.col("lo"), F.col("hi"), F.col("i"), F.col("total")))
    pos = F.row_number().over(Window.partitionBy("plan_id").orderBy("beat_no", "i")) - 1
    return rows.select("plan_id", pos.alias("pos"), slot.alias("slot_id"), "beat_id", (F.col("i") + 1).alias("occurrence"), "total", lane.alias("lane"), "intensity")


def resolve_intensity(lo: Column, hi: Column, i: Column, total: Column) -> Column:
    """Linear from lo to hi over the occurrences, rounded down, clamped to 0..10000; lo alone where hi is missing; null where lo is."""
    ramp = F.when(hi.isNull() | (total <= 1), lo).otherwise(lo + F.floor((hi - lo) * i / F.greatest(total - 1, F.lit(1))))
    return F.when(lo.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10_000), ramp))).cast("long")


def intensity_weight(intensity: Column) -> Column:
    """16000 - intensity (clamped)."""
    return (F.lit(16_000) - F.greatest(F.lit(0), F.least(F.lit(10_000), intensity))).cast("long")


def slot_targets(slots: DataFrame) -> DataFrame:
    """Adds weight, target and cap: each slot's share of the plan's ``budget`` (1500 at least), cap a multiple of it; by intensity, else by role."""
    table = F.create_map(*[x for k, (w, m) in PACING.items() for x in (F.lit(k), F.struct(F.lit(w * 100).alias("w"), F.lit(m).alias("m")))])
    fall = F.coalesce(F.try_element_at(table, F.col("role")), F.struct(F.lit(DEFAULT_PACING[0] * 100).alias("w"), F.lit(DEFAULT_PACING[1]).alias("m")))
    weight = F.when(F.col("intensity").isNotNull(), intensity_weight(F.col("intensity"))).otherwise(fall["w"]).cast("long")
    multiple = F.when(F.col("intensity").isNotNull(), DEFAULT_PACING[1]).otherwise(fall["m"])
    rows = slots.withColumns({"weight": weight, "multiple": multiple.cast("long")})
    rows = rows.withColumn("target", F.greatest(F.lit(1500), F.expr("budget * weight") / F.sum("weight").over(whole())).cast("long"))
    return rows.withColumn("cap", F.expr("target * multiple div 100")).drop("multiple")


def fit_durations(items: DataFrame, rounds: int = 5) -> DataFrame:
    """Adds ``fit``: targets within caps, scaled to the plan's ``budget`` up to five times, 500 at least, until within 50 of it."""
    rows = items.withColumn("fit", F.least("target", "cap"))
    for _ in range(rounds):
        total = F.sum("fit").over(whole())
        done = (total <= 0) | (F.abs(total - F.col("budget")) < 50)
        rows = rows.withColumn("_total", total).withColumn("_done", done)
        scaled = F.least(F.col("cap"), F.greatest(F.lit(500), F.expr("fit * budget div greatest(_total, 1)")))
        rows = rows.withColumn("fit", F.when(F.col("_done"), F.col("fit")).otherwise(scaled)).drop("_total", "_done")
    return rows


def reserve_ending(items: DataFrame, column: str = "fit") -> DataFrame:
    """The last item gets min(2000, cap) at least; the others above 1000 give in proportion, and come up to 1000 where they were less."""
    last = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.col("pos").desc())) == 1
    rows = items.withColumn("_last", last)
    least = F.max(F.when(F.col("_last"), F.least(F.lit(MIN_ENDING), "cap"))).over(whole())
    now = F.max(F.when(F.col("_last"), F.col(column))).over(whole())
    pool = F.sum(F.when(~F.col("_last"), F.greatest(F.lit(0), F.col(column) - 1000)).otherwise(0)).over(whole())
    rows = rows.withColumns({"_least": least, "_lack": least - now, "_pool": pool})
    give = F.expr(f"_lack * greatest(0, {column} - 1000) div greatest(_pool, 1)")
    out = F.when(F.col("_lack") <= 0, F.col(column)).when(F.col("_last"), F.col("_least")).when(F.col("_pool") <= 0, F.col(column)).otherwise(F.greatest(F.lit(1000), F.col(column) - give))
    return rows.withColumn(column, out).drop("_last", "_least", "_lack", "_pool")


def reflow(items: DataFrame, column: str = "fit") -> DataFrame:
    """Adds index (from 0), at and until: places on the timeline, one after the other."""
    end = F.sum(column).over(by_pos())
    return items.withColumns({"index": F.row_number().over(by_pos()) - 1, "until": end}).withColumn("at", F.col("until") - F.col(column))


def guard_units(items: DataFrame, column: str = "fit") -> DataFrame:
    """Lengths that would end inside a word unit (``units``: array of s, e on the source; ``start``: where the item starts there) let it finish within cap, or end before it."""
    end = respect_word_units(F.col("start"), F.col("start") + F.col(column), F.col("cap"), F.col("units"))
    return items.withColumn(column, (end - F.col("start")).cast("long"))


def assign_timing(items: DataFrame) -> DataFrame:
    """Fit, ending, word guard (where items have start and units), places."""
    rows = reserve_ending(fit_durations(items))
    return reflow(guard_units(rows) if "units" in items.columns else rows)


def shot_share(items: DataFrame) -> DataFrame:
    """Adds share: the slot's target over its number of shots (500 at least)."""
    n = F.count("*").over(Window.partitionBy("plan_id", "slot_id"))
    return items.withColumn("_n", n).withColumn("share", F.greatest(F.lit(500), F.expr("target div _n"))).drop("_n")


def validate_ordering(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (plan_id, kind, a, b) that the items' beats break: before, after, adjacent, never_adjacent; beats not cast are skipped."""
    at = items.groupBy("plan_id", "beat_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("pos").alias("all"))
    side = lambda n: at.select("plan_id", F.col("beat_id").alias(n), F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi"), F.col("all").alias(f"{n}_all"))
    rows = rules.join(side("a"), ["plan_id", "a"]).join(side("b"), ["plan_id", "b"])
    near = F.exists("a_all", lambda p: F.array_contains("b_all", p + 1) | F.array_contains("b_all", p - 1))
    kind = F.col("kind")
    bad = F.when(kind == "before", F.col("a_hi") >= F.col("b_lo")).when(kind == "after", F.col("a_lo") <= F.col("b_hi")).when(kind == "adjacent", ~near).when(kind == "never_adjacent", near)
    return rows.where(bad).select("plan_id", "kind", "a", "b")


def continuity_warnings(items: DataFrame) -> DataFrame:
    """plan_id, pos, warning: the same source as the item before; audio flagged (``check_audio``)."""
    same = F.col("asset_id") == F.lag("asset_id").over(by_pos())
    rows = items.withColumn("_same", same).withColumn("_first", F.row_number().over(by_pos()) == 1)
    found = F.array_compact(F.array(F.when(F.col("_same"), F.lit("redundant_source")), F.when(F.col("check_audio") & ~F.col("_first"), F.lit("check_audio"))))
    return rows.select("plan_id", "pos", F.explode(found).alias("warning"))


def pair_features(items: DataFrame) -> DataFrame:
    """Features of each item against the one before: shot_delta, energy_delta, setting_match, motion_match (of ``motion``, a text), lane; null where either side is unknown."""
    ways = F.array_intersect(terms(F.coalesce("motion", F.lit("")), keep_stop=True), strings(DIRECTIONS))
    items = items.withColumn("_ways", F.when(F.size(ways) > 0, ways))
    rows = items.withColumns({f"_{c}": F.lag(c).over(by_pos()) for c in ("shot_size", "energy", "setting", "lane", "pos", "_ways")}).where("_pos is not null")
    place = lambda c: F.nullif(F.array_position(strings(SHOT_SIZES), F.col(c)), F.lit(0))
    lane = F.when(F.col("lane").isNull() & F.col("_lane").isNull(), "none").when(F.col("lane") == F.col("_lane"), "same").otherwise("other")
    return rows.select("plan_id", "pos", (place("shot_size") - place("_shot_size")).alias("shot_delta"), (F.col("energy") - F.col("_energy")).alias("energy_delta"), (F.lower("setting") == F.lower("_setting")).alias("setting_match"), F.arrays_overlap("_ways", "__ways").alias("motion_match"), lane.alias("lane_relation"))


def continuity_compatible(a: Column, b: Column) -> Column:
    """Whether two maps (key -> tokens) share a token for every key of the first."""
    return F.forall(F.map_keys(a), lambda k: F.coalesce(F.arrays_overlap(F.try_element_at(a, k), F.try_element_at(b, k)), F.lit(False)))


def novelty_assign(candidates: DataFrame, group: int = 64) -> DataFrame:
    """plan_id, pos, segment_id, score: slots filled in order, each by its best candidate after penalties for what the plan used: 30 a segment, 10 a source.

    candidates: plan_id, pos, segment_id, asset_id, score; few for each slot. Ties by segment id. The greedy order
    can't be split within a plan; plans are many to a group, whose number follows the plans.
    """
    n = candidates.select("plan_id").distinct().count()
    groups = max(candidates.sparkSession.sparkContext.defaultParallelism, n // group)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["plan_id", "pos", "segment_id"])
        out: list[tuple] = []
        plan = pos = best = None
        segments, assets = set(), set()
        for p, at, seg, asset, score in f[["plan_id", "pos", "segment_id", "asset_id", "score"]].itertuples(index=False, name=None):
            if (p, at) != (plan, pos):
                if best:
                    out.append((plan, pos, best[1], best[0]))
                    segments.add(best[1])
                    assets.add(best[2])
                if p != plan:
                    segments, assets = set(), set()
                plan, pos, best = p, at, None
            score = score - 30 * (seg in segments) - 10 * (asset in assets)
            if best is None or score > best[0]:
                best = (score, seg, asset)
        if best:
            out.append((plan, pos, best[1], best[0]))
        return pd.DataFrame(out, columns=["plan_id", "pos", "segment_id", "score"])

    dealt = candidates.select("plan_id", "pos", "segment_id", "asset_id", F.col("score").cast("long").alias("score"), F.pmod(F.xxhash64("plan_id"), F.lit(groups)).alias("_g"))
    return dealt.groupBy("_g").applyInPandas(run, "plan_id long, pos long, segment_id long, score long")


def pin_anchors(slots: DataFrame, anchors: DataFrame) -> DataFrame:
    """plan_id, anchor_id, pos of anchors (plan_id, anchor_id, position, description), in the order of their ids.

    first and last go to the ends; 'after:<description>' to the slot behind that of an earlier anchor (behind the first
    slot if that isn't placed), unless it is taken; the others fill the slots that are left, in order. Those without
    a slot have null.
    """
    places = slots.groupBy("plan_id").agg(F.array_sort(F.collect_set("pos")).alias("_at"))
    own = F.array_sort(F.collect_list(F.struct("anchor_id", "position", "description")))
    rows = anchors.groupBy("plan_id").agg(own.alias("_own")).join(places, "plan_id").withColumn("_n", F.size("_at"))
    kind = "array<struct<anchor_id:bigint,description:string,i:int,loose:boolean>>"

    def step(acc: Column, a: Column) -> Column:
        after = F.startswith(a["position"], F.lit("after:"))
        name = F.trim(F.substring(a["position"], 7, 2**31 - 1))
        known = F.get(F.filter(acc, lambda x: (x["description"] == name) & x["i"].isNotNull()), 0)
        behind = F.least(F.coalesce(known["i"], F.lit(0)) + 1, F.col("_n") - 1)
        i = F.when(a["position"] == "first", 0).when(a["position"] == "last", F.col("_n") - 1).when(after & ~F.exists(acc, lambda x: F.coalesce(x["i"] == behind, F.lit(False))), behind)
        loose = ~after & ~a["position"].isin("first", "last")
        one = F.struct(a["anchor_id"].cast("long").alias("anchor_id"), a["description"].alias("description"), i.cast("int").alias("i"), loose.alias("loose"))
        return F.concat(acc, F.array(one))

    done = rows.withColumn("_x", F.explode(F.aggregate("_own", F.array().cast(kind), step))).select("plan_id", "_at", "_x.*")
    fixed = done.where("not loose").select("plan_id", "anchor_id", F.get("_at", F.col("i")).alias("pos"))
    free = slots.select("plan_id", "pos").join(fixed.where("pos is not null").select("plan_id", "pos"), ["plan_id", "pos"], "left_anti").withColumn("k", F.row_number().over(by_pos()))
    loose = done.where("loose").withColumn("k", F.row_number().over(Window.partitionBy("plan_id").orderBy("anchor_id")))
    return fixed.unionByName(loose.join(free, ["plan_id", "k"], "left").select("plan_id", "anchor_id", "pos"))


def overlay_candidates(items: DataFrame, pool: DataFrame) -> DataFrame:
    """plan_id, pos, segment_id: for each item the best other segment of the pool (plan_id, segment_id, voiceless, visual, score): voiceless first, then visual, then any."""
    tier = F.when(F.col("voiceless"), 0).when(F.col("visual"), 1).otherwise(2)
    # an item takes its plan's best, or, where that is its own, the best of another segment: items never meet the pool row by row
    packed = pool.where("segment_id is not null").groupBy("plan_id").agg(F.collect_list(F.struct(tier.alias("t"), F.negative("score").alias("s"), "segment_id")).alias("_pool"))
    best = packed.withColumn("_a", F.array_min("_pool"))
    best = best.withColumn("_b", F.array_min(F.filter("_pool", lambda c: c["segment_id"] != F.col("_a")["segment_id"])))
    rows = items.where("segment_id is not null").select("plan_id", "pos", F.col("segment_id").alias("own")).join(best, "plan_id")
    return rows.select("plan_id", "pos", F.when(F.col("_a.segment_id") != F.col("own"), F.col("_a.segment_id")).otherwise(F.col("_b.segment_id")).alias("segment_id")).where("segment_id is not null")


def overlay_fit(rows: DataFrame) -> DataFrame:
    """Overlays (s, e available, asset_ms or null, length of the primary) long enough to cover it: video_s, video_e."""
    end = F.least(F.col("e"), F.coalesce(F.col("asset_ms") - 50, F.col("e")))
    kept = rows.withColumn("_end", end).where(F.col("_end") - F.col("s") + 10 >= F.col("length"))
    start = F.greatest(F.col("s"), F.least(F.coalesce("snap_s", "s"), F.col("_end") - F.col("length")))
    return kept.withColumn("video_s", start).withColumn("video_e", F.col("video_s") + F.col("length")).drop("_end")


def timeline_fill(candidates: DataFrame, budget: int, longest: int) -> DataFrame:
    """query_id, rank, length, at: candidates in rank order until the budget is full, each cut to ``longest`` and to what is left; those of no length are passed over."""
    want = F.least(F.lit(longest), F.greatest(F.lit(0), F.col("e") - F.col("s")))
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = candidates.withColumn("_want", want).where("_want > 0").withColumn("at", F.sum("_want").over(order) - F.col("_want"))
    return rows.where(F.col("at") < budget).withColumn("length", F.least("_want", budget - F.col("at"))).select("query_id", "rank", "length", "at")


def decide_transition(items: DataFrame) -> DataFrame:
    """plan_id, pos, kind, ms, why: the first rule that holds between an item and the one before."""
    rows = items.withColumns({f"_{c}": F.lag(c).over(by_pos()) for c in ("asset_id", "audio", "flags", "pos")})
    flags = F.concat("flags", F.coalesce("_flags", F.array().cast("array<string>")))
    music = lambda c: F.coalesce(F.col(c).isin(MUSIC), F.lit(False))
    talk = lambda c: F.coalesce(F.col(c) == "clean_dialogue", F.lit(False))
    rule = (
        F.when(F.col("_pos").isNull(), F.struct(F.lit("cut").alias("kind"), F.lit(0).alias("ms"), F.lit("opening").alias("why")))
        .when(F.col("asset_id") == F.col("_asset_id"), F.struct(F.lit("crossfade").alias("kind"), F.lit(350).alias("ms"), F.lit("same source").alias("why")))
        .when(F.array_contains(flags, "abrupt_audio_or_no_audio"), F.struct(F.lit("crossfade").alias("kind"), F.lit(300).alias("ms"), F.lit("abrupt audio").alias("why")))
        .when(music("_audio") & music("audio"), F.struct(F.lit("crossfade").alias("kind"), F.lit(400).alias("ms"), F.lit("music to music").alias("why")))
        .when(F.array_contains(flags, "check_audio_transition") & ~talk("audio"), F.struct(F.lit("crossfade").alias("kind"), F.lit(400).alias("ms"), F.lit("flagged audio").alias("why")))
        .when(talk("audio") | talk("_audio"), F.struct(F.lit("cut").alias("kind"), F.lit(0).alias("ms"), F.lit("dialogue").alias("why")))
        .otherwise(F.struct(F.lit("cut").alias("kind"), F.lit(0).alias("ms"), F.lit("no risk").alias("why")))
    )
    return rows.select("plan_id", "pos", rule.alias("r")).select("plan_id", "pos", "r.*")


def decide_caption(text: Column, needed: Column, role: Column) -> Column:
    """Whether a caption burns: never without text; where it is needed, or for context and archive roles."""
    return F.when(F.coalesce(text, F.lit("")) == "", False).when(needed, True).otherwise(role.isin("context", "archive"))


def third(items: DataFrame) -> DataFrame:
    """Adds region: opening and ending are max(1, n // 3) items each, middle the rest."""
    n, i = F.count("*").over(whole()), F.row_number().over(by_pos())
    size = F.greatest(F.lit(1), F.floor(n / 3))
    return items.withColumn("region", F.when(i <= size, "opening").when(i > n - size, "ending").otherwise("middle"))


def retime(items: DataFrame, region: str, percent: int, column: str = "fit") -> DataFrame:
    """Items of a region scaled by ``percent``, within cap, 500 at least, no word unit cut (where items have start and units); ``changed`` marks them."""
    rows = third(items).withColumn("changed", F.lit(True) if region == "all" else F.col("region") == region)
    new = F.least(F.col("cap"), F.greatest(F.lit(500), F.expr(f"{column} * {percent} div 100")))
    if "units" in items.columns:
        new = respect_word_units(F.col("start"), F.col("start") + new, F.col("cap"), F.col("units")) - F.col("start")
    return rows.withColumn(column, F.when(F.col("changed"), new).otherwise(F.col(column)).cast("long")).drop("region")


def apply_script(items: DataFrame, script: list[tuple]) -> DataFrame:
    """Edit operations in order, each on all plans at once: ('retime', region, percent), ('drop', pos), ('replace', pos, table of plan_id, segment_id), ('insert', pos, table of plan_id, segment_id, asset_id, cap, fit), ('swap_ending', table of plan_id, rank, segment_id: the last item becomes the first of these that it isn't).

    Positions are those of the moment (from 1); a table gives each plan's substitute, plans without one stay.
    """
    rows = items.select("plan_id", F.row_number().over(by_pos()).cast("double").alias("pos"), "segment_id", "asset_id", "cap", "fit", F.lit(False).alias("changed"))
    for op in script:
        if op[0] == "retime":
            was = F.col("_was")
            rows = retime(rows.withColumnRenamed("changed", "_was"), op[1], op[2]).withColumn("changed", F.col("changed") | was).drop("_was")
        elif op[0] == "drop":
            rows = rows.where(F.col("pos") != op[1])
        elif op[0] == "replace":
            new = op[2].select("plan_id", F.col("segment_id").alias("_new"))
            hit = (F.col("pos") == op[1]) & F.col("_new").isNotNull()
            rows = rows.join(new, "plan_id", "left").withColumns({"segment_id": F.when(hit, F.col("_new")).otherwise(F.col("segment_id")), "changed": F.col("changed") | hit}).drop("_new")
        elif op[0] == "swap_ending":
            last = F.max("pos").over(whole()) == F.col("pos")
            rows = rows.withColumn("_last", last)
            ends = rows.where("_last").select("plan_id", F.col("segment_id").alias("_old")).join(op[1], "plan_id").where("segment_id <> _old")
            ends = ends.groupBy("plan_id").agg(F.min_by("segment_id", "rank").alias("_new"))
            hit = F.col("_last") & F.col("_new").isNotNull()
            rows = rows.join(ends, "plan_id", "left").withColumns({"segment_id": F.when(hit, F.col("_new")).otherwise(F.col("segment_id")), "changed": F.col("changed") | hit}).drop("_new", "_last")
        elif op[0] == "insert":
            new = op[2].select("plan_id", F.lit(op[1] - 0.5).alias("pos"), "segment_id", "asset_id", "cap", "fit", F.lit(True).alias("changed"))
            rows = rows.unionByName(new.join(rows.select("plan_id").distinct(), "plan_id", "left_semi"))
        else:
            raise ValueError(op[0])
        rows = rows.withColumn("pos", F.row_number().over(by_pos()).cast("double"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def plan_diff(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """plan_id, n_changed, n_kept, n_added, n_removed, by position and the given columns."""
    mark = F.xxhash64(*columns)
    rows = before.select("plan_id", "pos", mark.alias("x")).join(after.select("plan_id", "pos", mark.alias("y")), ["plan_id", "pos"], "full")
    count = lambda ok, name: F.count_if(ok).alias(name)
    return rows.groupBy("plan_id").agg(count(F.col("x") != F.col("y"), "n_changed"), count(F.col("x") == F.col("y"), "n_kept"), count(F.col("x").isNull(), "n_added"), count(F.col("y").isNull(), "n_removed"))


def resolve_item_ref(refs: DataFrame, items: DataFrame) -> DataFrame:
    """ref_id, pos of refs (plan_id, ref_id, ref): a number counts from 0 (from the end if negative), else the first item whose slot, beat or segment id it is."""
    one = F.struct("pos", *[F.col(c).cast("string").alias(c) for c in ("slot_id", "beat_id", "segment_id")])
    packed = items.groupBy("plan_id").agg(F.sort_array(F.collect_list(one)).alias("_items"))
    rows = refs.join(packed, "plan_id", "left").where("_items is not null or try_cast(ref as bigint) is null")
    return rows.select("plan_id", "ref_id", place_of(F.col("_items"), F.col("ref")).alias("pos"))


def explain_items(items: DataFrame) -> DataFrame:
    """plan_id, pos, why: role, intensity and the first two reasons."""
    reasons = F.array_join(F.slice("reasons", 1, 2), "; ")
    note = F.when(F.row_number().over(by_pos()) == 1, "Open cleanly.").when(F.array_contains("flags", "check_audio_transition"), "Crossfade the audio.").otherwise("Plain cut.")
    return items.select("plan_id", "pos", F.concat(F.col("role"), F.lit(" beat: "), F.when(reasons != "", reasons).otherwise(F.lit("selected for the directive")), F.lit(". "), note).alias("why"))


def sequence_item(rows: DataFrame, budget: int) -> DataFrame:
    """Items' clip and room: trims within the asset less 50 ms, target 1000 at least, cap from target, clip no longer than its range, target or budget."""
    end = F.least(F.col("e"), F.coalesce(F.col("asset_ms") - 50, F.col("e")))
    start = F.when(F.col("asset_ms").isNotNull(), F.least(F.col("s"), F.greatest(F.lit(0), end - 100))).otherwise(F.col("s"))
    rows = rows.withColumn("_s", start).withColumn("_e", end).withColumn("raw", F.greatest(F.lit(100), F.col("_e") - F.col("_s")))
    rows = rows.withColumn("goal", F.greatest(F.lit(1000), F.coalesce(F.nullif("target", F.lit(0)), F.col("raw"))))
    rows = rows.withColumn("clip", F.least(F.col("raw"), F.greatest(F.lit(2000), "goal"), F.greatest(F.lit(2000), F.lit(budget))))
    return rows.withColumn("room", F.least(F.coalesce(F.nullif("cap", F.lit(0)), F.expr("goal * 150 div 100")), F.col("_e") - F.col("_s"))).drop("_s", "_e", "raw")


def enumerate_slots(ranked: DataFrame, matches: Column, cap: int, chronological: bool) -> DataFrame:
    """query_id, pos, segment_id: a slot for each ranked segment that matches, ``cap`` at most by rank, then in time or rank order."""
    best = Window.partitionBy("query_id").orderBy("rank")
    kept = ranked.where(matches).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= cap)
    order = Window.partitionBy("query_id").orderBy(*(["asset_id", "s", "segment_id"] if chronological else ["rank"]))
    return kept.select("query_id", (F.row_number().over(order) - 1).alias("pos"), "segment_id")


def candidate_items(hits: DataFrame, selects: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, segment_id: matched segments that have a select, by its score (not the match's), k at most; queries without one get the best selects of all."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "segment_id")
    own = hits.select("query_id", "segment_id").distinct().join(selects, "segment_id")
    none = hits.select("query_id").distinct().join(own.select("query_id").distinct(), "query_id", "left_anti")
    best = selects.orderBy(F.col("score").desc(), "segment_id").limit(k)
    both = own.unionByName(none.crossJoin(F.broadcast(best)).select(*own.columns))  # k rows
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "segment_id")


def planned_items(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Plan items as timeline candidates with their asset's duration and rate (30 where unknown); unknown assets stay."""
    return items.join(assets.select("asset_id", "duration_ms", "fps"), "asset_id", "left").withColumn("fps", F.coalesce("fps", F.lit(30.0)))


def resolve_parent_plan(requests: DataFrame, plans: DataFrame, timelines: DataFrame) -> DataFrame:
    """request_id, plan_id, status: an explicit plan id, the plan of 'timeline:<id>', or the newest plan that is ok and has items; 'missing' where there is none."""
    by_line = timelines.select(F.concat(F.lit("timeline:"), F.col("timeline_id").cast("string")).alias("parent"), F.col("plan_id").alias("_line"))
    named = plans.select(F.col("plan_id").cast("string").alias("parent"), F.col("plan_id").alias("_named"))
    newest = plans.where("ok and n_items > 0").agg(F.max_by("plan_id", F.struct("created", "plan_id")).alias("_newest"))  # one row
    rows = requests.join(by_line, "parent", "left").join(named, "parent", "left").crossJoin(F.broadcast(newest))
    plan = F.coalesce("_line", "_named", F.when(F.col("parent").isNull(), F.col("_newest")))
    return rows.select("request_id", plan.alias("plan_id"), F.when(plan.isNull(), "missing").otherwise("ok").alias("status"))
