"""Typed replies of annotators and planners: JSON read leniently, ranges clamped, unknown values replaced with a warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Names that replies may use.
FACETS = ["people_appearance", "groups_interactions", "actions_events", "setting_context", "cinematography", "emotion_tone", "objects_text", "audio_character"]
MODES = ["compose", "enumerate", "subtract", "transform"]
OUTPUTS = ["timeline", "revision", "report"]
PROVENANCES = ["user_explicit", "user_implicit", "agent"]
EDITS = ["retime", "replace_item", "drop_item", "swap_ending", "insert_beat"]


def _ms(seconds: Column) -> Column:
    """Milliseconds of a number in text, null for what isn't one."""
    return F.round(seconds.try_cast("double") * 1000).cast("long")


def _range(start: Column, end: Column, default: int, duration: Column) -> tuple[Column, Column]:
    """Start (0 where missing) and end (``default`` later where missing or 0), 100 ms apart at least, inside the duration where that is known."""
    s = F.greatest(F.lit(0), F.coalesce(_ms(start), F.lit(0)))
    e = F.greatest(s + 100, F.coalesce(F.nullif(_ms(end), F.lit(0)), s + default))
    known = F.coalesce(duration > 0, F.lit(False))
    inside = F.least(s, F.greatest(F.lit(0), duration - 100))
    return F.when(known, inside).otherwise(s).cast("long"), F.when(known, F.least(F.greatest(inside + 100, e), duration)).otherwise(e).cast("long")


def _objects(items: Column) -> Column:
    return F.filter(items, lambda x: F.startswith(F.ltrim(x), F.lit("{")))


def _truth(raw: Column, missing: bool) -> Column:
    return F.when(raw.isNull(), F.lit(missing)).otherwise(~F.lower(F.trim(raw)).isin("false", "0", "0.0", "", "[]", "{}"))


def explode_segments(replies: DataFrame) -> DataFrame:
    """reply_id, i, s, e, kind, summary, transcript, people, roles, quality, usable, needs_caption of the segments (with a summary) of replies (reply_id, raw, duration_ms); i is the raw place."""
    items = F.from_json("raw", "struct<segments:array<string>>")["segments"]
    names = ["start_sec", "end_sec", "summary", "kind", "transcript_summary", "people", "story_roles", "quality_score", "usable", "needs_caption"]
    rows = replies.select("reply_id", "duration_ms", F.posexplode(items).alias("i", "j")).where(F.startswith(F.ltrim("j"), F.lit("{")))
    rows = rows.withColumn("x", F.from_json("j", "struct<" + ",".join(f"{n}:string" for n in names) + ">"))
    s, e = _range(F.col("x.start_sec"), F.col("x.end_sec"), 8000, F.col("duration_ms"))
    out = rows.select(
        "reply_id", "i", s.alias("s"), e.alias("e"), X.text_or(F.col("x.kind"), F.lit("candidate_moment")).alias("kind"), F.trim("x.summary").alias("summary"), F.nullif(F.trim("x.transcript_summary"), F.lit("")).alias("transcript"),
        X.json_list(F.col("x.people")).alias("people"), X.json_list(F.col("x.story_roles")).alias("roles"), F.col("x.quality_score").try_cast("double").alias("quality"), _truth(F.col("x.usable"), True).alias("usable"), _truth(F.col("x.needs_caption"), False).alias("needs_caption"),
    )
    return out.where("summary <> ''")


def _observations(rows: DataFrame) -> DataFrame:
    """rows: reply_id, facet, duration_ms, i, value (JSON of an object)."""
    rows = rows.withColumn("x", F.from_json("value", "struct<start_sec:string,end_sec:string,confidence:string>"))
    s, e = _range(F.col("x.start_sec"), F.col("x.end_sec"), 1000, F.col("duration_ms"))
    return rows.select("reply_id", "facet", "i", s.alias("s"), e.alias("e"), F.col("x.confidence").try_cast("double").alias("confidence"), "value")


def explode_facets(replies: DataFrame) -> DataFrame:
    """reply_id, facet, i, s, e, confidence, value of replies (reply_id, facet, raw, duration_ms) with a list of observations, or of segments; only objects count."""
    x = F.from_json("raw", "struct<observations:array<string>,segments:array<string>>")
    return _observations(replies.select("reply_id", "facet", "duration_ms", F.posexplode(_objects(F.coalesce(x["observations"], x["segments"]))).alias("i", "value")))


def explode_budget(replies: DataFrame) -> DataFrame:
    """As ``explode_facets``, from replies (reply_id, raw, duration_ms) that hold a list for each known facet."""
    parts = replies.select("reply_id", "duration_ms", F.explode(F.from_json("raw", "struct<facets:map<string,string>>")["facets"]).alias("facet", "list"))
    parts = parts.where(F.col("facet").isin(FACETS) & F.startswith(F.ltrim("list"), F.lit("[")))
    return _observations(parts.select("reply_id", "facet", "duration_ms", F.posexplode(_objects(F.from_json("list", "array<string>"))).alias("i", "value")))


def _joined(parts: Column, show) -> Column:  # noqa: ANN001
    return F.array_join(F.transform(parts, show), "|")


def conform_intents(replies: DataFrame) -> DataFrame:
    """reply_id, mode, output, sources, edit_type, requirements, anchors, attributes, fallback, warnings (array) of replies (reply_id, raw, directive).

    A reply without an operation, requirements or an edit type falls back to composing for the directive. Unknown
    modes, outputs, sources, provenances and positions are replaced, each with a warning; requirements without text
    and anchors without a description are dropped with one. requirements: 'text/provenance', anchors:
    'description@position', attributes: as they are, each joined by '|'; a reply without any has its directive.
    """
    names = ["operation", "edit_type", "requirements", "anchors", "evidence_attributes"]
    rows = replies.withColumn("x", F.from_json("raw", "struct<" + ",".join(f"{n}:string" for n in names) + ">"))
    begins = lambda c, mark: F.coalesce(F.startswith(F.ltrim(c), F.lit(mark)), F.lit(False))
    good = begins("x.operation", "{") | begins("x.requirements", "[") | F.coalesce(F.col("x.edit_type") != "", F.lit(False))
    op = F.from_json("x.operation", "struct<mode:string,output:string,sources:string>")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    asked = F.coalesce(F.from_json("x.requirements", "array<struct<text:string,provenance:string,why:string>>"), F.array().cast("array<struct<text:string,provenance:string,why:string>>"))
    named = F.coalesce(F.from_json("x.anchors", "array<struct<description:string,position:string>>"), F.array().cast("array<struct<description:string,position:string>>"))
    rows = rows.select("reply_id", "directive", good.alias("good"), low(op["mode"]).alias("m"), low(op["output"]).alias("o"), F.coalesce(F.nullif(F.trim(op["sources"]), F.lit("")), F.lit("corpus")).alias("src"), "x", asked.alias("asked"), named.alias("named"))
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    kept, held = F.filter("asked", lambda r: has(r["text"])), F.filter("named", lambda a: has(a["description"]))
    known = lambda p: low(p).isin(PROVENANCES)
    sure = lambda p: F.when(known(p), low(p)).otherwise(F.lit("agent"))
    place = lambda p: F.when(low(p) == "", F.lit("anywhere")).otherwise(low(p))
    fits = lambda p: place(p).isin("first", "last", "anywhere") | F.startswith(place(p), F.lit("after:"))
    fine = F.col("src").rlike("^(corpus$|subset:|timeline:)")
    each = lambda n, text: F.array_repeat(F.lit(text), n.cast("int"))
    one = lambda bad, text: F.when(bad, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    warnings = F.concat(
        one((F.col("m") != "") & ~F.col("m").isin(MODES), "unknown mode"), one((F.col("o") != "") & ~F.col("o").isin(OUTPUTS), "unknown output"), one(~fine, "unknown sources"),
        each(F.size("asked") - F.size(kept), "requirement without text"), each(F.size(F.filter(kept, lambda r: ~known(r["provenance"]))), "invalid provenance"),
        each(F.size(F.filter(kept, lambda r: (sure(r["provenance"]) != "user_explicit") & ~has(r["why"]))), "missing why"),
        each(F.size("named") - F.size(held), "anchor without description"), each(F.size(F.filter(held, lambda a: ~fits(a["position"]))), "invalid position"), one(F.size(kept) == 0, "no requirements"),
    )
    own = F.concat("directive", F.lit("/user_explicit"))
    pick = lambda value, other: F.when(F.col("good"), value).otherwise(other)
    attributes = F.filter(F.coalesce(F.from_json("x.evidence_attributes", "array<string>"), F.array().cast("array<string>")), has)
    return rows.select(
        "reply_id",
        pick(F.when(F.col("m").isin(MODES), F.col("m")).otherwise("compose"), F.lit("compose")).alias("mode"),
        pick(F.when(F.col("o").isin(OUTPUTS), F.col("o")).otherwise("timeline"), F.lit("timeline")).alias("output"),
        pick(F.when(fine, F.col("src")).otherwise("corpus"), F.lit("corpus")).alias("sources"),
        pick(F.coalesce(F.nullif("x.edit_type", F.lit("")), F.lit("unspecified_edit")), F.lit("unspecified_edit")).alias("edit_type"),
        pick(F.when(F.size(kept) == 0, own).otherwise(_joined(kept, lambda r: F.concat(F.trim(r["text"]), F.lit("/"), sure(r["provenance"])))), own).alias("requirements"),
        pick(_joined(held, lambda a: F.concat(F.trim(a["description"]), F.lit("@"), F.when(fits(a["position"]), place(a["position"])).otherwise(F.lit("anywhere")))), F.lit("")).alias("anchors"),
        pick(_joined(attributes, lambda a: F.trim(a)), F.lit("")).alias("attributes"),
        (~F.col("good")).alias("fallback"),
        pick(warnings, F.array(F.lit("malformed reply"))).alias("warnings"),
    )


def conform_scripts(replies: DataFrame) -> DataFrame:
    """reply_id, i, op, on, by, timed_by, problem: the entries of edit scripts (reply_id, raw, n_items), a list or an object with operations.

    on: the target, item, query or place that the entry names; by: factor, target duration (timed_by: factor or length), substitute or need. An entry
    with a ``problem`` (unknown operation, bad target or reference, no positive factor, no query or need) isn't to be
    applied. Regions are opening, middle, ending, all, a slot's or beat's name, or [first, last] of the items.
    """
    listed = F.coalesce(F.from_json("raw", "struct<operations:array<string>>")["operations"], F.from_json("raw", "array<string>"))
    names = ["op", "target", "factor", "target_duration_sec", "item", "with", "with_query", "after", "need"]
    rows = replies.select("reply_id", "n_items", F.posexplode(listed).alias("i", "j")).withColumn("x", F.from_json("j", "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"))
    x = {n: F.trim(F.col("x")[n]) for n in names}
    op, n = F.lower(F.coalesce(x["op"], F.lit(""))), F.col("n_items")
    ends = F.from_json(x["target"], "array<int>")
    region = F.when(F.startswith(x["target"], F.lit("[")), (F.size(ends) == 2) & (ends[0] >= 0) & (ends[0] <= ends[1]) & (ends[1] < n)).otherwise(x["target"] != "")
    number = lambda c: c.try_cast("bigint")
    item = lambda c: F.when(number(c).isNotNull(), (number(c) >= -n) & (number(c) < n)).otherwise(c != "")
    yes = lambda c: F.coalesce(c, F.lit(False))
    positive = lambda c: yes(c.try_cast("double") > 0)
    problem = (
        F.when(~F.startswith(F.ltrim("j"), F.lit("{")), "not an object")
        .when(~op.isin(EDITS), "unknown operation")
        .when((op == "retime") & ~yes(region), "invalid target")
        .when((op == "retime") & ~positive(x["factor"]) & ~positive(x["target_duration_sec"]), "no positive factor or duration")
        .when(op.isin("replace_item", "drop_item") & ~yes(item(x["item"])), "invalid item")
        .when((op == "swap_ending") & ~yes(x["with_query"] != ""), "no query")
        .when((op == "insert_beat") & ~(yes(item(x["after"])) & yes(x["need"] != "")), "no place or need")
    )
    on = F.when(op == "retime", x["target"]).when(op.isin("replace_item", "drop_item"), x["item"]).when(op == "swap_ending", x["with_query"]).when(op == "insert_beat", x["after"])
    by = F.when(op == "retime", F.when(positive(x["factor"]), x["factor"]).otherwise(x["target_duration_sec"])).when(op == "replace_item", X.text_or(x["with"], F.lit("recast"))).when(op == "insert_beat", x["need"])
    timed_by = F.when(op == "retime", F.when(positive(x["factor"]), "factor").otherwise("length"))
    return rows.select("reply_id", "i", op.alias("op"), on.alias("on"), by.alias("by"), timed_by.alias("timed_by"), problem.alias("problem"))
