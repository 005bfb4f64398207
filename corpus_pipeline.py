"""A training-data pipeline over ``documents``: each stage applies one operator and hands its rows on.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All stages but the
last return the columns of documents. Tables that a stage needs beside its documents are read from sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutledger.llm.decontaminate import contaminated
from cutledger.llm.near_dup import near_duplicates
from cutledger.llm.pieces import encode
from cutledger.llm.pii import sanitise
from cutledger.llm.quality import judge
from cutledger.llm.scratch import cut

#: The model of the last stage.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    A null text counts as an empty one, a null source as a site of its own; both are judged like others. Repeated rows
    are judged, and kept, each. A null doc_id has no label. Other columns pass unchanged, whatever their names; without
    labels all rows stay.
    """
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Rows are told apart by doc_id and text; of rows equal in both one stays. A row without a doc_id stays only if
    its group has none with one. Documents without a word are in no group and all stay.
    """
    rows = cut(near_duplicates(docs, k=5, num=4, den=5).where("group_key is not null").select("doc_id", "text_key", "group_key"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key").alias("w")
    first = rows.groupBy("group_key").agg(F.min(order).alias("w"), F.count("*").alias("n")).where("n > 1").select("group_key", F.col("w.doc_id").alias("_id"), F.col("w.text_key").alias("_key"))
    first = cut(first, "first")
    wins = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    both = rows.join(first, "group_key")
    gone = both.where(~wins).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    twice = both.where(wins).groupBy("_id", "_key").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_key")
    marked = cut(gone.withColumn("_twice", F.lit(False)).unionByName(twice.withColumn("_twice", F.lit(True))), "marked")
    rest = _rows(docs, marked.hint("merge"), "left_anti")
    # rows that repeat a winner: only those are brought together
    once = _rows(docs, marked.where("_twice"), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(once).select(*docs.columns)


def _rows(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are (left_semi) or aren't (left_anti) those of _id and _key in ``marked``.

    A row travels as one struct, so that none of its names can clash with those used here.
    """
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    same = F.col("_row")["doc_id"].cast("long").eqNullSafe(F.col("_id")) & F.xxhash64(F.col("_row")["text"].cast("string")).eqNullSafe(F.col("_key"))
    return row.join(marked, same, how).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold no passage and stay. Rows are told apart by doc_id (null or not) and text: of repeated
    rows all go or all stay. Other columns pass unchanged, whatever their names; without a benchmark all rows stay.
    """
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = cut(hits.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "hits")
    return _rows(docs, hits, "left_anti")


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced.

    A null text stays null, an empty one empty; equal texts are changed alike. n_chars counts the new text; other columns
    pass unchanged, whatever their names.
    """
    return sanitise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, same_text, parity of each document; nulls, empty texts and repeats as ``encode`` says."""
    return encode(docs, PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", privacy),
    ("sentencepiece", tokens),
]

#: Trained weights, sketches and token ids can't be written as SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
