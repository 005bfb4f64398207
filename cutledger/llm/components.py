"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that both sides of the join are plain shuffles, whose hot keys can be split
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    edges = cut(edges, "edges")
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges``: columns a, b (long), any order, repeats and loops allowed. Returns node, comp (smallest node reached).

    Nodes without an edge to another node don't appear. Only two numbers of a round reach the driver.
    """
    tidy = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last = cut(tidy(edges), "edges"), None
    for _ in range(rounds):
        now = cut(tidy(_small(tidy(_large(now)))), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
