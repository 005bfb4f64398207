"""PII (operator 5): personal data by pattern, and terms that reveal it by corpus co-occurrence. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

KINDS = ("email", "ip", "card", "phone")
#: The four patterns, written so that no start inside a run is tried twice and nothing recurses: a start inside
#: a run can match only where its first can, or right after a match (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
_SPAN = "array<struct<kind:string,start:int,end:int,tag:string>>"

#: Characters on each side of an entity that are its context; documents and distinct contexts that must show a
#: term beside an entity; share of the term's documents, and bits of pointwise information, that disclose it;
#: share from which it is removed, not generalised.
CONTEXT, LEAST_DOCS, LEAST_CONTEXTS, DISCLOSES, BITS, REMOVED = 80, 3, 3, 0.5, 6.0, 0.9
#: Values that are summed together, and characters of a piece of text that are counted through together.
CHUNK, PIECE = 128, 2048


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, zero: Column, add) -> Column:  # noqa: ANN001
    """For each of ``values`` (not negative) what ``add``, a sum or a maximum, makes of ``zero`` and all values before it.

    Chunks are summed, then what comes before a chunk, then what comes before a value in it: no array grows with each
    value, so a text of many spans costs little more than as many of few.
    """
    def found(v: Column) -> Column:
        chunk = lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.aggregate(chunk(k), F.lit(0), add))
        each = lambda begin, k: _let(chunk(k), lambda c: F.transform(c, lambda x, i: F.aggregate(F.slice(c, F.lit(1), i), begin, add)))
        starts = lambda t: F.transform(t, lambda x, k: F.aggregate(F.slice(t, F.lit(1), k), zero, add))
        return F.when(F.size(v) > 0, _let(sums, lambda t: F.flatten(F.transform(starts(t), each)))).otherwise(F.array().cast("array<int>"))

    return _let(values, found)


def _marked(text: Column, pattern: str, kind: str, tag) -> Column:  # noqa: ANN001
    """Spans of the matches for which ``tag`` (of the match) isn't null: each match is put between two marks, then lengths are summed."""
    bare = F.translate(text, "\x01\x02", "\x03\x03")
    parts = F.split(F.regexp_replace(bare, pattern, "\x01$0\x02"), "\x01", -1)

    def located(parts: Column) -> Column:
        # a part but for the first is a match, a mark, and what follows
        rest = F.slice(parts, F.lit(2), F.size(parts) - 1)
        starts = lambda r: _before(F.transform(r, lambda p: F.length(p) - 1), F.length(F.get(parts, F.lit(0))), lambda t, n: t + n)

        def span(part: Column, start: Column) -> Column:
            match = F.substring_index(part, "\x02", 1)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), tag(match).alias("tag"))

        spans = _let(rest, lambda r: F.zip_with(r, starts(r), span))
        return F.filter(spans, lambda x: x["tag"].isNotNull()).cast(_SPAN)

    return _let(parts, lambda p: F.when(F.size(p) > 1, located(p)).otherwise(F.array().cast(_SPAN)))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, as a place deep in a text is found only by counting from its start."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), lambda k: F.substring(text, k * PIECE + 1, F.lit(PIECE)))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor(F.greatest(end - 1, start) / PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, tag) by kind as in KINDS, then start; code points, end exclusive; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    need = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    each = []
    for kind in KINDS:
        spans = _marked(text, PATTERNS[kind], kind, lambda m, k=kind: F.when(_valid(k, m), F.lit(f"[{k.upper()}]")))
        each.append(F.when(need[kind], spans).otherwise(F.array().cast(_SPAN)) if kind in need else spans)
    return F.concat(*each)


def joined(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its tag; of overlapping spans the first (the longer at a tie) gives the tag."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.negative(s["end"]).alias("back"), s["tag"].alias("tag"))))
    reach = lambda o: _before(F.transform(o, lambda s: -s["back"]), F.lit(0), lambda t, e: F.greatest(t, e))

    def done(o: Column, pieces: Column) -> Column:
        # a span gives its tag, and the text since the last one, if none before reaches into it
        parts = F.zip_with(o, reach(o), lambda s, at: F.when(s["start"] >= at, F.concat(_part(pieces, at, s["start"]), s["tag"])).otherwise(F.lit("")))
        end = F.array_max(F.transform(o, lambda s: -s["back"]))
        return F.concat(F.array_join(parts, ""), _part(pieces, end, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(order, lambda o: _let(_pieces(text), lambda p: done(o, p))))


def _contexts(text: Column, spans: Column) -> Column:
    """For each base span its entity (kind and bare value), its context's key and the context's whole words."""

    def one(pieces: Column, s: Column) -> Column:
        value = _part(pieces, s["start"], s["end"])
        bare = F.when(s["kind"] == "email", F.lower(value)).when(s["kind"] == "ip", value).otherwise(F.regexp_replace(value, "[^0-9]", ""))
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        left = _part(pieces, low, s["start"])
        right = _part(pieces, s["end"], s["end"] + CONTEXT)
        # words that the window cuts are dropped
        left = F.when(low > 0, F.regexp_replace(left, r"^\S+", "")).otherwise(left)
        right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"\S+$", "")).otherwise(right)
        both = F.lower(F.concat_ws(" ", left, right))
        terms = F.array_distinct(F.regexp_extract_all(both, F.lit(TERM), F.lit(0)))
        return F.struct(F.xxhash64(s["kind"], bare).alias("entity"), F.xxhash64(both).alias("context"), terms.alias("terms"))

    return _let(_pieces(text), lambda p: F.transform(spans, lambda s: one(p, s)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, spans, contexts of each row of ``docs`` (doc_id, text), written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    rows = rows.withColumn("contexts", F.when(F.size("spans") > 0, _contexts(F.col("text"), F.col("spans"))))
    return cut(rows.select("doc_id", F.xxhash64("text").alias("text_key"), "spans", "contexts"), "pii")


def disclosing(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """text_key, tags (term -> replacement) for the texts that hold a disclosing term.

    A term discloses an entity if at least LEAST_DOCS distinct texts and LEAST_CONTEXTS distinct contexts show it
    beside the entity, those are DISCLOSES or more of all distinct texts with the term, and knowing the term tells
    BITS or more about the entity. Equal texts count once, so copies of a page prove nothing. All texts count.
    """
    seen = scanned.where("contexts is not null").select("text_key", F.explode("contexts").alias("c")).select("text_key", "c.entity", "c.context", F.explode("c.terms").alias("term"))
    seen = cut(seen.distinct(), "beside")
    pairs = seen.groupBy("entity", "term").agg(F.count_distinct("text_key").alias("both"), F.count_distinct("context").alias("contexts"))
    pairs = pairs.where((F.col("both") >= LEAST_DOCS) & (F.col("contexts") >= LEAST_CONTEXTS))
    # a term's texts are at least those that show it beside any entity: what fails on these fails on all
    beside = seen.select("term", "text_key").distinct().groupBy("term").agg(F.count("*").alias("near"))
    entities = seen.select("entity", "text_key").distinct().groupBy("entity").agg(F.count("*").alias("entity_texts"))
    likely = cut(pairs.join(beside, "term").where(F.col("both") >= DISCLOSES * F.col("near")).join(entities, "entity"), "likely")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(text.alias("text")).select(F.xxhash64("text").alias("text_key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    holds = cut(words.join(likely.select("term").distinct(), "term").distinct(), "holds")
    counts = holds.groupBy("term").agg(F.count("*").alias("texts"))
    total = docs.select(F.xxhash64(text).alias("text_key")).distinct().agg(F.count("*").alias("all_texts"))
    share = F.col("both") / F.col("texts")
    bits = F.log2(F.col("both") * F.col("all_texts") / (F.col("texts") * F.col("entity_texts")))
    told = likely.join(counts, "term").crossJoin(total).where((share >= DISCLOSES) & (bits >= BITS))  # total is one row
    told = told.groupBy("term").agg(F.when(F.max(share) >= REMOVED, F.lit("")).otherwise(F.lit("[TERM]")).alias("tag"))
    return cut(holds.join(told, "term").groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "tag"))).alias("tags")), "tags")


def term_spans(text: Column, tags: Column) -> Column:
    """Spans of the disclosing terms of a text, whole words only."""
    found = _marked(text, TERM, "term", lambda m: F.try_element_at(tags, F.lower(m)))
    return F.when(tags.isNull(), F.array().cast(_SPAN)).otherwise(found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by pattern), terms (spans of disclosing terms) for each row of ``docs``.

    Base spans are the leftmost matches of each kind that don't overlap; those that fail their check are dropped
    without another try. Kinds may overlap each other. A null text counts as empty and has no span; equal rows
    have equal spans; other columns are ignored. Spans count code points, whole texts.
    """
    scanned = scan(docs)
    tags = disclosing(docs, scanned)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    located = docs.select(text.alias("text")).withColumn("text_key", F.xxhash64("text")).join(tags, "text_key").dropDuplicates(["text_key"])
    located = cut(located.select("text_key", term_spans(F.col("text"), F.col("tags")).alias("terms")), "terms")
    return scanned.join(located, "text_key", "left").select("doc_id", F.col("spans").alias("base"), F.coalesce("terms", F.array().cast(_SPAN)).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by [EMAIL], [IP], [CARD], [PHONE], and disclosing terms by [TERM] or nothing.

    All rows and columns stay, in order; a null text stays null. n_chars, where there, is counted anew.
    """
    tags = disclosing(docs, scan(docs))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    text = F.col("_row")["text"]
    spans = F.concat(base_spans(text), term_spans(text, F.col("tags")))
    done = packed.join(tags, "text_key", "left").withColumn("spans", spans).select("_row", F.when(text.isNotNull(), redact(text, F.col("spans"))).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
