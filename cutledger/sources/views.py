"""The shapes that operators work on, derived from the star-schema tables: asset timelines in integer milliseconds.

Each view has the same rows as the SQL of that name in ``cutledger.plans.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: event_type -> reason of a cut point.
REASONS = {"click": "gap_start", "view": "gap_end", "error": "shot_change", "signup": "word_start", "purchase": "word_end"}
DURATION_MS = 70_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, s, e, flag: one interval a line item, many overlapping."""
    li = table(spark, sf_dir, "lineitem")
    s = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 5000) % 60_000
    return li.select(F.col("l_orderkey").alias("asset_id"), s.cast("long").alias("s"), (s + (F.col("l_quantity") * 200).cast("long")).cast("long").alias("e"), F.col("l_returnflag").alias("flag"))


def interval_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id")).distinct().withColumn("duration_ms", F.lit(DURATION_MS).cast("long"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, pos, speaker, text, s, e: turns of a conversation laid end to end, 60 ms a character."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("len", (F.length("text") * 60).cast("long"))
    end = F.sum("len").over(Window.partitionBy("asset_id").orderBy("pos"))
    return rows.withColumn("e", end).select("asset_id", "pos", "speaker", "text", (F.col("e") - F.col("len")).alias("s"), "e")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, pos, i, text, s, e: the words of the spans; 400 ms of pause after . ? ! or comma, else 40 ms."""
    rows = spans(spark, sf_dir).select("asset_id", "pos", F.posexplode(F.split("text", " ")).alias("i", "text")).where("text <> ''")
    length = (F.length("text") * 60).cast("long")
    gap = F.when(F.substring("text", -1, 1).isin(".", "?", "!", ","), 400).otherwise(40)
    rows = rows.withColumns({"len": length, "step": (length + gap).cast("long")})
    end = F.sum("step").over(Window.partitionBy("asset_id").orderBy("pos", "i"))
    return rows.withColumn("s", end - F.col("step")).select("asset_id", "pos", "i", "text", "s", (F.col("s") + F.col("len")).alias("e"))


def word_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, duration_ms: a second longer than the last word."""
    return words(spark, sf_dir).groupBy("asset_id").agg((F.max("e") + 1000).alias("duration_ms"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, obs_id, facet, s, e, value: events on their user's timeline."""
    ev = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = ev.groupBy("user_id").agg(F.min("us").alias("first_us"))
    rows = ev.join(first, "user_id").withColumn("s", F.expr("(us - first_us) div 1000"))
    return rows.select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("obs_id"), F.col("event_type").alias("facet"), "s", (F.col("s") + F.floor("value") * 1000).cast("long").alias("e"), F.col("props").alias("value"))


def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, point_id, t, reason."""
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("facet")]
    return observations(spark, sf_dir).select("asset_id", F.col("obs_id").alias("point_id"), F.col("s").alias("t"), reason.alias("reason")).where("reason is not null")


def point_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("asset_id").agg((F.max("e") + 1000).alias("duration_ms"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, asset_id, s, e, summary, mood, role, quality, usable, has_card: documents as candidate moments."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(labels, "doc_id", "left")
    roles = F.array(*map(F.lit, ("hook", "context", "reaction", "performance", "payoff", "archive", "emotion")))
    s = (F.col("doc_id") * 7919 % 600_000).cast("long")
    return rows.select(
        F.col("doc_id").alias("segment_id"), F.col("source").alias("asset_id"), s.alias("s"), (s + 2000 + F.col("n_chars") % 8000).cast("long").alias("e"), F.col("text").alias("summary"),
        F.col("lang").alias("mood"), F.element_at(roles, (F.col("doc_id") % 7 + 1).cast("int")).alias("role"), F.coalesce("quality", F.lit(0)).cast("long").alias("quality"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("usable"), (F.col("doc_id") % 3 == 0).alias("has_card"),
    )


def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, pos, segment_id, asset_id, target, cap (ms), role: orders as plans, their lines as items."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("plan_id"), F.row_number().over(order).cast("long").alias("pos"), F.col("l_partkey").alias("segment_id"), F.col("l_suppkey").alias("asset_id"),
        (F.col("l_quantity") * 100).cast("long").alias("target"), (F.lit(150) * (1 + F.col("l_partkey") % 40)).cast("long").alias("cap"), F.col("l_returnflag").alias("role"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query_text: four words of the text of each 50th document, so the queries grow with the corpus."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 50 = 0")
    parts = F.split("text", " ")
    return docs.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(parts, 2, 4), " ").alias("query_text"))
