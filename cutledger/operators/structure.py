"""Structure replies: lanes, beats and rules of a planned sequence, checked against each other, with warnings in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that replies may use.
PATTERNS = ["alternate", "enumerate", "repeat"]
ORDERINGS = ["adjacent", "after", "before", "never_adjacent"]
#: The most segments that an enumerating beat takes, where it doesn't say.
CAP = 12

_BEAT = "struct<" + ",".join(f"{n}:string" for n in ("id", "function", "pattern", "lane", "lanes", "count", "cap", "intensity_target", "fill", "motif", "recontextualizes", "overlay", "visual_need", "word_need", "casting_filter", "withhold")) + ">"
_OUT = "struct<id:string,function:string,lane:string,pattern:string,lanes:array<string>,count:int,cap:int,lo:bigint,hi:bigint,shots_min:int,shots_max:int,continuity:array<string>,motif:string,occurrence:int,transform:string,recontextualizes:string,overlay:string,need:string,filter:string,withhold:array<string>>"
_WORDS = "array<string>"


def _none(kind: str = _WORDS) -> Column:
    return F.array().cast(kind)


def _is(text: Column, mark: str) -> Column:
    return F.coalesce(F.startswith(F.ltrim(text), F.lit(mark)), F.lit(False))


def _text(c: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(F.when(_is(c, "["), F.from_json(c, _WORDS)), _none()), lambda t: F.trim(t)), lambda t: t != "")


def _warn(bad: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))).otherwise(_none())


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _share(c: Column) -> Column:
    """A number from 0 to 1, clamped, in ten-thousandths."""
    return F.when(c.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 10_000)).cast("bigint")


def _beat(raw: Column, i: Column, lanes: Column) -> Column:
    """struct(beat, warnings) of one entry; beat is null for one that isn't an object."""

    def read(y: Column) -> Column:
        name = F.coalesce(_text(y["id"]), F.concat(F.lit("beat_"), (i + 1).cast("string")))
        asked = F.nullif(F.lower(F.trim(y["pattern"])), F.lit(""))
        pattern = F.when(asked.isin(PATTERNS), asked)
        lane = _text(y["lane"])
        known = lambda t: (F.size(lanes) == 0) | F.array_contains(lanes, t)
        named = _list(y["lanes"])
        fit, unfit = F.filter(named, known), F.filter(named, lambda t: ~known(t))
        few = (pattern == "alternate") & (F.size(fit) < 2)
        number, ends = y["intensity_target"].try_cast("double"), F.when(_is(y["intensity_target"], "["), F.from_json(y["intensity_target"], "array<double>"))
        pair = F.coalesce((F.size(ends) == 2) & ends[0].isNotNull() & ends[1].isNotNull(), F.lit(False))
        fill = F.when(_is(y["fill"], "{"), F.from_json(y["fill"], "struct<shots:string,continuity:string>"))
        shots = F.when(_is(fill["shots"], "["), F.from_json(fill["shots"], "array<int>"))
        low = F.greatest(F.lit(1), F.when(F.size(shots) == 2, F.coalesce(shots[0], F.lit(1))).otherwise(F.coalesce(fill["shots"].try_cast("int"), F.lit(1))))
        high = F.greatest(low, F.when(F.size(shots) == 2, F.coalesce(shots[1], F.lit(1))).otherwise(low))
        motif = F.when(_is(y["motif"], "{"), F.from_json(y["motif"], "struct<slot:string,occurrence:string,transform:string>"))
        overlay = F.when(_is(y["overlay"], "{"), F.from_json(y["overlay"], "struct<need:string,audio:string>"))
        audio = F.lower(F.trim(F.coalesce(F.nullif(overlay["audio"], F.lit("")), F.lit("keep_primary"))))
        once = lambda c: F.nullif(c.try_cast("int"), F.lit(0))
        beat = F.struct(
            name.alias("id"), F.coalesce(_text(y["function"]), F.lit("unnamed")).alias("function"), F.when(known(lane), lane).alias("lane"), F.when(~F.coalesce(few, F.lit(False)), pattern).alias("pattern"),
            F.when(pattern == "alternate", fit).otherwise(named).alias("lanes"), y["count"].try_cast("int").alias("count"), F.coalesce(once(y["cap"]), F.lit(CAP)).alias("cap"),
            F.coalesce(_share(number), F.when(pair, _share(ends[0]))).alias("lo"), F.when(pair, _share(ends[1])).alias("hi"),
            F.when(fill.isNotNull(), low).alias("shots_min"), F.when(fill.isNotNull(), high).alias("shots_max"), F.when(fill.isNotNull(), _list(fill["continuity"])).alias("continuity"),
            _text(motif["slot"]).alias("motif"), F.when(_text(motif["slot"]).isNotNull(), F.coalesce(once(motif["occurrence"]), F.lit(1))).alias("occurrence"), F.when(_text(motif["slot"]).isNotNull(), _text(motif["transform"])).alias("transform"),
            _text(y["recontextualizes"]).alias("recontextualizes"), _text(overlay["need"]).alias("overlay"), _text(y["visual_need"]).alias("need"), _text(y["casting_filter"]).alias("filter"), _list(y["withhold"]).alias("withhold"),
        ).cast(_OUT)
        of = F.concat(F.lit("beat "), name, F.lit(": "))
        warnings = F.concat(
            _warn(_text(y["function"]).isNull(), of, "no function"), _warn(asked.isNotNull() & pattern.isNull(), of, "unknown pattern ", asked), _warn(lane.isNotNull() & ~known(lane), of, "unknown lane ", lane),
            _warn((pattern == "alternate") & (F.size(unfit) > 0), of, "unknown lanes ", F.array_join(unfit, ",")), _warn(few, of, "alternates fewer than two lanes"),
            _warn(y["intensity_target"].isNotNull() & number.isNull() & ~pair, of, "invalid intensity"), _warn(y["fill"].isNotNull() & fill.isNull(), of, "invalid fill"),
            _warn(y["motif"].isNotNull() & _text(motif["slot"]).isNull(), of, "motif without a slot"), _warn(y["overlay"].isNotNull() & _text(overlay["need"]).isNull(), of, "overlay without a need"),
            _warn(_text(overlay["need"]).isNotNull() & (audio != "keep_primary"), of, "unknown overlay audio ", audio),
        )
        return F.struct(beat.alias("beat"), warnings.alias("warnings"))

    bad = F.struct(F.lit(None).cast(_OUT).alias("beat"), F.array(F.concat(F.lit("entry "), (i + 1).cast("string"), F.lit(": not an object"))).alias("warnings"))
    return F.when(_is(raw, "{"), _let(F.from_json(raw, _BEAT), read)).otherwise(bad)


def fallback_beats(duration_ms: Column) -> Column:
    """Plain beats for want of better: one for each ten seconds, three at least, rising from 0.35 to 0.7, the last at 0.3."""
    n = F.greatest(F.lit(3), F.bround(duration_ms / 10_000).cast("int"))

    def one(i: Column) -> Column:
        last = i == n - 1
        function = F.when(i == 0, "open").when(last, "close").otherwise(F.concat(F.lit("develop_"), i.cast("string")))
        lo = F.when(last, F.lit(3000)).otherwise(F.round((3500 + 3500 * i / (n - 1)) / 10) * 10).cast("bigint")
        given = {"id": F.concat(F.lit("fb"), (i + 1).cast("string")), "function": function, "lanes": _none(), "cap": F.lit(CAP), "lo": lo, "withhold": _none()}
        names = [f.split(":")[0] for f in _OUT[7:-1].split(",")]
        return F.struct(*[given.get(k, F.lit(None)).alias(k) for k in names]).cast(_OUT)

    return F.transform(F.sequence(F.lit(0), n - 1), one)


def conform_structures(replies: DataFrame) -> DataFrame:
    """reply_id, logline, lanes, beats, rules, reserve_ending, fallback, warnings of replies (reply_id, raw, directive, duration_ms).

    Entries are checked against each other: a beat's lanes against the lanes, what it recontextualizes and what a rule
    orders against the beats. What names nothing known is dropped with a warning; warnings come in the order lanes, beats,
    references, rules. A reply that isn't an object with a list of beats, or has no valid beat, becomes
    ``fallback_beats`` of its duration (null as none).
    """
    lists = ("lanes", "beats", "ordering_constraints")
    # lists are read one by one, so that one which isn't a list takes no other with it
    parts = F.from_json("raw", "struct<logline:string,ending_policy:string," + ",".join(f"{n}:string" for n in lists) + ">")
    entries = lambda c: F.coalesce(F.when(_is(c, "["), F.from_json(c, _WORDS)), _none())
    rows = replies.select("reply_id", "directive", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), parts.alias("x"))
    rows = rows.select("reply_id", "directive", "duration_ms", "x", *[entries(F.col("x")[n]).alias(f"_{n}") for n in lists])
    lane = F.transform("_lanes", lambda t: F.when(_is(t, "{"), F.from_json(t, "struct<id:string,casting_filter:string>")))
    kept = F.transform(F.filter(lane, lambda v: _text(v["id"]).isNotNull()), lambda v: F.struct(F.trim(v["id"]).alias("id"), F.coalesce(F.trim(v["casting_filter"]), F.lit("")).alias("filter")))
    rows = rows.withColumn("lanes", kept).withColumn("_w_lanes", F.array_repeat(F.lit("lane without an id"), F.size("_lanes") - F.size("lanes")))
    rows = rows.withColumn("_ids", F.transform("lanes", lambda v: v["id"]))
    rows = rows.withColumn("_read", F.transform("_beats", lambda t, i: _beat(t, i, F.col("_ids"))))
    rows = rows.withColumn("_kept", F.filter(F.transform("_read", lambda v: v["beat"]), lambda b: b.isNotNull())).withColumn("_known", F.transform("_kept", lambda b: b["id"]))
    lost = F.filter("_kept", lambda b: b["recontextualizes"].isNotNull() & ~F.array_contains("_known", b["recontextualizes"]))
    referred = F.transform(lost, lambda b: F.concat(F.lit("beat "), b["id"], F.lit(": recontextualizes unknown beat "), b["recontextualizes"]))
    beats = F.transform("_kept", lambda b: b.withField("recontextualizes", F.when(F.array_contains("_known", b["recontextualizes"]), b["recontextualizes"])))
    asked = F.filter(F.transform("_ordering_constraints", lambda t: F.when(_is(t, "{"), F.from_json(t, "struct<type:string,a:string,b:string>"))), lambda r: r.isNotNull())
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rules = F.transform(asked, lambda r: F.struct(F.lower(plain(r["type"])).alias("type"), plain(r["a"]).alias("a"), plain(r["b"]).alias("b")))
    fine = lambda r: F.array_contains("_known", r["a"]) & F.array_contains("_known", r["b"])
    odd = F.transform(F.filter(rules, lambda r: ~r["type"].isin(ORDERINGS) | ~fine(r)), lambda r: F.when(~r["type"].isin(ORDERINGS), F.concat(F.lit("rule of unknown type "), r["type"])).otherwise(F.concat(F.lit("rule of unknown beats "), r["a"], F.lit("/"), r["b"])))
    warnings = F.concat("_w_lanes", F.flatten(F.transform("_read", lambda v: v["warnings"])), referred, odd)
    good = F.size("_kept") > 0
    pick = lambda value, other: F.when(good, value).otherwise(other)
    why = F.when(F.size("_beats") > 0, "no valid beats").otherwise("malformed reply")
    reserve = F.from_json("x.ending_policy", "struct<reserve_ending:string>")["reserve_ending"]
    return rows.select(
        "reply_id", pick(F.coalesce(_text(F.col("x.logline")), F.lit("no logline")), F.concat(F.lit("linear: "), "directive")).alias("logline"),
        pick(F.col("lanes"), F.array().cast("array<struct<id:string,filter:string>>")).alias("lanes"), pick(beats, fallback_beats(F.col("duration_ms"))).alias("beats"),
        pick(F.filter(rules, lambda r: r["type"].isin(ORDERINGS) & fine(r)), F.array().cast("array<struct<type:string,a:string,b:string>>")).alias("rules"),
        pick(F.coalesce(reserve.try_cast("boolean"), F.lit(True)), F.lit(True)).alias("reserve_ending"), (~good).alias("fallback"), pick(warnings, F.array(why)).alias("warnings"),
    )
