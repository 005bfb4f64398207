"""Corpus profiles: counts, histograms, top terms, inventories and summaries as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpoints

ARC = ["hook", "context", "performance", "reaction", "emotion", "payoff"]


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by each key alone and in all: level (the key's name or 'total'), value, n. One pass, partial sums first."""
    part = df.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(F.count("*").alias("n"))
    one = F.array(F.struct(F.lit("total").alias("level"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("level"), F.coalesce(F.col(k), F.lit("")).alias("value")) for k in keys])
    return part.select("n", F.inline(one)).groupBy("level", "value").agg(F.sum("n").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: the rows of each table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def context_summary(cards: DataFrame, material: DataFrame, captions: DataFrame) -> DataFrame:
    """level, value, n: cards by source, material by kind, captions in all."""
    by = lambda t, c, name: t.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("level"), "value", "n")
    whole = captions.agg(F.count("*").alias("n")).select(F.lit("captions").alias("level"), F.lit("").alias("value"), "n")
    return by(cards, "source", "cards").unionByName(by(material, "kind", "material")).unionByName(whole)


def facet_summary(observations: DataFrame) -> DataFrame:
    """facet, source, n by both, by each alone, and in all (null marks what is summed over)."""
    return observations.groupingSets([["facet", "source"], ["facet"], ["source"], []], "facet", "source").agg(F.count("*").alias("n"))


def distinct_and_rows(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("n_keys"), F.count("*").alias("n_rows"))


def asset_inventory(assets: DataFrame) -> DataFrame:
    """One row: n, n_ready, total_ms of ready assets, n_audio."""
    ready = F.col("status") == "ready"
    return assets.agg(F.count("*").alias("n"), F.count_if(ready).alias("n_ready"), F.sum(F.when(ready, F.col("duration_ms")).otherwise(0)).alias("total_ms"), F.count_if(F.col("has_audio")).alias("n_audio"))


def segment_inventory(segments: DataFrame) -> DataFrame:
    """One row for usable segments: n, shortest, exact median and longest of max(0, e - s)."""
    length = F.greatest(F.lit(0), F.col("e") - F.col("s"))
    return segments.where("usable").agg(F.count("*").alias("n"), F.min(length).alias("shortest"), F.median(length).alias("median"), F.max(length).alias("longest"))


def quotable_lines(units: DataFrame, k: int) -> DataFrame:
    """The first k distinct lines (case aside) by file, start and place: each by a minimum per line, then a top-k."""
    first = units.where("e > s and trim(text) <> ''").groupBy(F.lower("text").alias("line")).agg(F.min(F.struct("asset_id", "s", "pos", "text")).alias("f"))
    return first.select("line", "f.*").orderBy("asset_id", "s", "pos", "line").limit(k)


TIMES = ["start_sec", "end_sec", "confidence"]


def json_leaves(rows: DataFrame, raw: str, *keep: str, skip: list[str]) -> tuple[DataFrame, DataFrame]:
    """String leaves of JSON values of any depth, and phrases of their objects; what can't be read has neither.

    Leaves: keep, at (places on the way down, keys in order), text (trimmed, not blank). Phrases: keep, text: the lower-cased
    values in the order of their keys of each object that has two values or more, all of them strings that aren't
    blank. Keys in ``skip`` are left out with all below them. ``keep`` names a row. A step down is one lateral join; it
    ends when no value is nested. Lineage is cut by checkpoint().
    """
    spark = rows.sparkSession
    checkpoints(spark)
    text = lambda v: F.expr(f"case when schema_of_variant({v}) = 'STRING' then trim(variant_get({v}, '$', 'string')) end")
    level = rows.select(*keep, F.array().cast("array<int>").alias("at"), F.try_parse_json(raw).alias("v")).where("v is not null")
    leaves = level.select(*keep, "at", text("v").alias("text")).where("text <> ''")
    phrases = leaves.select(*keep, "text").limit(0)
    while True:
        nested = level.where("schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%'")
        kids = spark.sql("select t.*, x.pos, x.key, x.value from {t} t, lateral variant_explode(t.v) x", t=nested)
        kids = kids.where(F.coalesce(~F.col("key").isin(skip), F.lit(True))).withColumn("text", text("value")).drop("v").checkpoint()
        if kids.isEmpty():
            return leaves, phrases
        down = F.concat("at", F.array("pos"))
        leaves = leaves.unionByName(kids.where("text <> ''").select(*keep, down.alias("at"), "text"))
        whole = kids.where("key is not null").groupBy(*keep, "at").agg(F.count("*").alias("n"), F.count_if(F.col("text") != "").alias("k"), F.array_sort(F.collect_list(F.struct("key", F.lower("text").alias("text")))).alias("parts"))
        phrases = phrases.unionByName(whole.where("n > 1 and n = k").select(*keep, F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text")))
        level = kids.select(*keep, down.alias("at"), F.col("value").alias("v"))


def facet_histograms(observations: DataFrame, k: int) -> DataFrame:
    """facet, term, n, rank: the k most frequent terms (ties by term) of each facet's JSON values (obs_id, facet, value), any shape.

    String leaves of at most 48 characters that aren't numbers are terms; an object whose values are all strings
    gives their phrase too, in the order of its keys.
    """
    leaves, phrases = json_leaves(observations, "value", "obs_id", "facet", skip=[*TIMES, "evidence"])
    terms = leaves.select("facet", F.lower("text").alias("term")).where(~F.replace("term", F.lit("."), F.lit("")).rlike("^[0-9]+$"))
    rows = terms.unionByName(phrases.select("facet", F.col("text").alias("term"))).where(F.length("term") <= 48)
    n = rows.groupBy("facet", "term").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "term"))).where(F.col("rank") <= k)


def observation_text(observations: DataFrame, key: str, raw: str, include_evidence: bool = True) -> DataFrame:
    """key, text: the string leaves of each row's JSON value, depth first, keys in order, joined by blanks; times and confidence left out."""
    leaves, _ = json_leaves(observations, raw, key, skip=TIMES + ([] if include_evidence else ["evidence"]))
    found = leaves.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return observations.select(key).join(found, key, "left").select(key, F.coalesce(F.array_join(F.transform("parts", lambda x: x["text"]), " "), F.lit("")).alias("text"))


def role_candidates(segments: DataFrame, k: int) -> DataFrame:
    """kind ('opener': hook, 'ender': payoff, conclusion, climax), rank, segment_id: the k best of each by quality, start, id."""
    kind = F.when(F.col("role") == "hook", "opener").when(F.col("role").isin("payoff", "conclusion", "climax"), "ender")
    order = Window.partitionBy("kind").orderBy(F.col("quality").desc(), "s", "segment_id")
    return segments.where("usable").withColumn("kind", kind).where("kind is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("kind", "rank", "segment_id")


def collection_summary(segments: DataFrame, k: int) -> DataFrame:
    """field, value, n, rank: the k most frequent roles, moods and sources (ties by value)."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("role", "mood", "asset_id")]
    n = segments.select(F.inline(F.array(*fields))).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value"))).where(F.col("rank") <= k)


def story_arc(segments: DataFrame) -> DataFrame:
    """asset_id, arc: the roles of ARC that an asset has, in ARC's order; its own roles (six at most, by name) if it has none of those."""
    have = segments.groupBy("asset_id").agg(F.array_sort(F.collect_set("role")).alias("have"))
    known = F.filter(F.array(*map(F.lit, ARC)), lambda r: F.array_contains("have", r))
    return have.select("asset_id", F.array_join(F.when(F.size(known) > 0, known).otherwise(F.slice("have", 1, 6)), ">").alias("arc"))


def material_bank(evidence: DataFrame) -> DataFrame:
    """kind, name, n, first_ids (five at most), confidence (hundredths): 45 + 10 a piece of evidence, 100 at most."""
    order = Window.partitionBy("kind", "name").orderBy("doc_id")
    five = evidence.distinct().withColumn("r", F.row_number().over(order)).where("r <= 5")
    out = five.groupBy("kind", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return out.select("kind", "name", "n", F.array_join("ids", ",").alias("first_ids"), F.least(F.lit(100), 45 + 10 * F.col("n")).cast("long").alias("confidence"))


def segment_warnings() -> Column:
    """Warnings of a segment (s, e in ms, quality in tenths, n_edges): long, weak, unlinked."""
    return F.array_compact(F.array(F.when(F.col("e") - F.col("s") > 30_000, F.lit("long_segment")), F.when(F.col("quality") < 5, F.lit("low_quality")), F.when(F.col("n_edges") == 0, F.lit("no_relationships"))))


def captions() -> Column:
    """At most two captions of a segment: 'Role: source' and the first 96 characters of its text."""
    head = F.concat(F.initcap(F.translate("role", "_", " ")), F.lit(": "), F.col("asset_id").cast("string"))
    return F.array_compact(F.array(head, F.when(F.trim("summary") != "", F.substring(F.trim("summary"), 1, 96))))


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key: an aggregate on (time, tie), no sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(at, tie)).alias("r")).select(key, "r.*")


def corpus_conflicts(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """request_id, asked, there: requests for more than the ready assets' total length, unless ``listed``."""
    total = assets.where("status = 'ready'").agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("there"))
    return requests.where("not listed").crossJoin(F.broadcast(total)).where("asked > there").select("request_id", "asked", "there")  # total is one row


def override(computed: DataFrame, supplied: DataFrame, key: str, column: str) -> DataFrame:
    """A supplied value that isn't blank takes the place of the computed one."""
    rows = computed.join(supplied.select(key, F.col(column).alias("_s")), key, "left")
    return rows.withColumn(column, F.coalesce(F.when(F.trim("_s") != "", F.col("_s")), F.col(column))).drop("_s")


def context_cards(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """segment_id, card (JSON): role, warnings and the first four neighbours of each segment."""
    both = edges.select(F.col("src").alias("segment_id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("segment_id"), F.col("src").alias("other"))).distinct()
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("segment_id").orderBy("other"))).where("r <= 4")
    near = top.groupBy("segment_id").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("near"))
    rows = segments.join(near, "segment_id", "left").withColumn("n_edges", F.when(F.col("near").isNull(), 0).otherwise(1))
    return rows.select("segment_id", F.to_json(F.struct("role", F.array_join(segment_warnings(), ",").alias("warnings"), F.coalesce("near", F.lit("")).alias("near"))).alias("card"))


def review_list(reviews: DataFrame) -> DataFrame:
    """review_id, at, score of reviews (raw JSON with score), newest first; what can't be read has a null score."""
    return reviews.select("review_id", "at", F.from_json("raw", "struct<score:double>")["score"].alias("score")).orderBy(F.col("at").desc(), F.col("review_id").desc())


def byte_savings(artifacts: DataFrame) -> DataFrame:
    """One row: bytes before and after, over the artifacts (before, after)."""
    return artifacts.agg(F.sum("before").alias("before"), F.sum("after").alias("after"), (F.sum("before") - F.sum("after")).alias("saved"))


def timeline_items(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Items with their asset's path, by plan and position; items of unknown assets stay."""
    return items.join(assets.select("asset_id", "path"), "asset_id", "left").orderBy("plan_id", "pos")
