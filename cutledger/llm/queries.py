"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

def _bucket(column: str, parts: int):  # noqa: ANN202
    return F.crc32(F.col(column).cast("string")) % parts


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), _read(spark, sf_dir, "labels"), text=False)
    return out.select("doc_id", F.col("_doc").alias("p_text"), F.col("_site").alias("p_site"), F.col("_good").alias("p_good"), F.col("_kept").alias("kept"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated

    return repeated(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    docs = _read(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_bucket("doc_id", 5) == 0, F.lit(True)))
    train = docs.where("not held_out and lang is not null and text is not null").select("text", "lang")
    return identify(docs.select("doc_id", "held_out", "text"), train)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(_bucket("doc_id", 3) == 1, F.lit(True)))
    labels = _read(spark, sf_dir, "labels").where(_bucket("doc_id", 3) != 1)
    out = score(docs, train(docs.where("not held_out"), labels))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int")).select("doc_id", "held_out", "score", "predicted", "offending")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every text, made of the text itself: its middle in capitals, a repeat at a hashed place, its start cut."""
    from .token_counts import counts

    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    half = F.floor(size / 2).cast("int")
    place = F.pmod(F.crc32(text), size + 1).cast("int")
    edit = lambda a, b, t: F.struct(a.alias("start"), b.alias("finish"), t.alias("added"))
    edits = F.array(edit(half, half + 40, F.upper(F.substring(text, half + 1, F.lit(40)))), edit(place, place, F.substring(text, 1, 30)), edit(F.lit(0), F.lit(7), F.lit("")))
    docs = _read(spark, sf_dir, "documents")
    return counts(docs.select("doc_id", "text", edits.alias("edits")), RANKS)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_key")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find, joined

    out = find(_read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long") for k in KINDS]
    counts = [(F.size("base").cast("long") - n).alias(f"n_{k}") for n, k in zip(counts, KINDS, strict=True)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "terms")).alias("spans"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"), least=0.9)


#: Files of public tokenizers; the paths are parameters of the operators.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(_read(spark, sf_dir, "documents"), PIECES)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=4, num=4, den=5).drop("text_key", "group_key")


def op11_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_search import nearest

    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(vectors, F.col("vec_id") % 50 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one of ten documents the words from a hashed place on repeat with a hashed period before runs are looked for."""
    from .periodic import periodic

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    docs = docs.select("doc_id", "text", "words", F.size("words").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    n, g, words = F.col("n"), F.col("g"), F.col("words")
    docs = docs.withColumn("a", F.when(n > 0, g % n).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice(words, F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    again = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a")), F.slice(tail, F.lit(1), n - F.col("a"))), " ")
    out = periodic(docs.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    told = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("b.s")).alias("start"), F.col("b.length"), (-F.col("b.p")).alias("period")
    milli = F.floor(1000 * F.col("b.length") / -F.col("b.p")).cast("long")
    return out.select("doc_id", "n_runs", start, length, period, milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
