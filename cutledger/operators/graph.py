"""Edges between segments: similarity joins, neighbours, components, lineage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpoints, written

#: Vectors of a block at most, blocks at least (where there are vectors for them), and vectors whose products are worked out at once.
BLOCK, FEWEST, TILE = 16_384, 12, 2048
#: Pairs that wait in a task, at most and those of a tile, before only the k best of each vector are kept.
WAITING = 1_000_000


def _best(src: np.ndarray, dst: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each src: by cosine, then dst."""
    order = np.lexsort((dst, -cos, src))
    s = src[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    return order[rank < k]


def _best_of_blocks(t: pa.Table, least: float, k: int) -> pa.Table:
    """src, dst, cosine of the pairs of one pair of blocks: for each vector its k best in it."""
    column = lambda c: t.column(c).to_numpy()
    ids, mine, lo, hi = column("segment_id"), column("mine"), column("lo")[0], column("hi")[0]
    vectors = np.stack([np.asarray(v, dtype=float) for v in column("v")])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    whole, s, e = column("whole"), column("s"), column("e")
    assets = np.unique(t.column("asset").to_pylist(), return_inverse=True)[1]
    left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
    kept = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
    waiting: list[list[np.ndarray]] = []

    def settle() -> None:
        nonlocal kept, waiting
        kept = [np.concatenate(c) for c in zip(kept, *waiting, strict=True)]
        best = _best(ids[kept[0]], ids[kept[1]], kept[2], k)
        kept, waiting = [c[best] for c in kept], []

    for at in range(0, len(left), TILE):
        rows = left[at : at + TILE]
        for by in range(0, len(right), TILE):
            columns = right[by : by + TILE]
            cos = vectors[rows] @ vectors[columns].T
            i, j = np.nonzero(cos >= least)
            c, i, j = cos[i, j], rows[i], columns[j]
            pair = ids[i] < ids[j] if lo == hi else ids[i] != ids[j]
            one_place = whole[i] & whole[j] & (assets[i] == assets[j]) & (s[i] < e[j]) & (s[j] < e[i])
            i, j, c = (x[pair & ~one_place] for x in (i, j, c))
            waiting.append([np.r_[i, j], np.r_[j, i], np.r_[c, c]])
            if sum(len(w[0]) for w in waiting) > WAITING:
                settle()
    settle()
    return pa.table({"src": ids[kept[0]], "dst": ids[kept[1]], "cosine": kept[2]})


def best_pairs(vectors: DataFrame, least: float, k: int) -> DataFrame:
    """src, dst, cosine of at least ``least``, exactly: the k best of each vector (ties to the smaller dst), by matrix products of blocks.

    For thresholds too low for hashing. Work is quadratic in the vectors, as the question is. Each pair of blocks is a group,
    whose memory is two blocks; a vector is sent once for each block as it is, and a group gives k rows a vector at most,
    never its pairs. Where vectors have asset_id, s and e, two segments of one asset that overlap in time are no pair.
    """
    rows = vectors.where("embedding is not null and segment_id is not null")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(FEWEST, n // 256))
    mine = F.pmod(F.xxhash64("segment_id"), F.lit(blocks)).cast("int")
    timed = {"s", "e"} <= set(vectors.columns)
    whole = F.expr("asset_id is not null and s is not null and e is not null") if timed else F.lit(False)
    place = [F.coalesce(F.col(c) if timed else F.lit(None), F.lit(0)).cast("long").alias(c) for c in ("s", "e")]
    asset = F.coalesce(F.col("asset_id").cast("string"), F.lit("")) if timed else F.lit("")
    rows = rows.select("segment_id", F.col("embedding").alias("v"), whole.alias("whole"), asset.alias("asset"), *place, mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    rows = rows.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).drop("other")
    # as many partitions as there are pairs of blocks would be too many, as few as there are cores too uneven
    rows = rows.repartition(max(1, min(blocks * (blocks + 1) // 2, 8 * rows.sparkSession.sparkContext.defaultParallelism)), "lo", "hi")
    near = rows.groupBy("lo", "hi").applyInArrow(lambda t: _best_of_blocks(t, least, k), "src long, dst long, cosine double")
    order = Window.partitionBy("src").orderBy(F.col("cosine").desc(), "dst")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """segment_id, other and ``more`` of edges (src, dst), either way; the edges are worked out once."""
    way = lambda a, b: F.struct(F.col(a).alias("segment_id"), F.col(b).alias("other"))
    return edges.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("_w"), *more).select("_w.*", *more)


def relationship_type(cosine: Column, same_asset: Column, dup: float) -> Column:
    return F.when(cosine >= dup, "duplicates").when(same_asset, "echoes_same_source").otherwise("echoes")


def relate(vectors: DataFrame, least: float, dup: float, k: int, existing: DataFrame | None = None) -> DataFrame:
    """src, dst, type: pairs in the k best of either end, each unordered pair once, those in ``existing`` (src, dst) left out.

    Where vectors have s and e, two segments of one asset that overlap in time are no pair.
    """
    top = best_pairs(vectors, least, k)
    once = top.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "cosine").distinct()
    if existing is not None:
        once = once.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    own = vectors.select("segment_id", "asset_id")
    named = once.join(own.toDF("src", "asset_a"), "src").join(own.toDF("dst", "asset_b"), "dst")
    return named.select("src", "dst", relationship_type(F.col("cosine"), F.col("asset_a") == F.col("asset_b"), dup).alias("type"))


def related(edges: DataFrame, ids: DataFrame, usable: DataFrame, k: int) -> DataFrame:
    """segment_id, other, type, rank: the k neighbours of each id, either way along an edge, that are usable; by confidence, then id. Of repeated edges the most confident counts; edges with other evidence (where they have it) stand for themselves."""
    same = ["evidence"] if "evidence" in edges.columns else []
    both = both_ways(edges, "type", "confidence", *same)
    rows = both.groupBy("segment_id", "other", "type", *same).agg(F.max("confidence").alias("confidence")).join(ids, "segment_id", "left_semi").join(usable.select(F.col("segment_id").alias("other")), "other", "left_semi")
    order = Window.partitionBy("segment_id").orderBy(F.col("confidence").desc(), "other", "type", *same)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("segment_id", "other", "type", *same, "rank")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp: the least node that each node of ``edges`` (src, dst) reaches.

    Each round takes the least label among neighbours, then the label's own label; rounds end when none changes.
    Each round's labels are written to the shared folder, as a checkpoint would work out its rows twice.
    """
    both = written(both_ways(edges.where("src <> dst")).select(F.col("segment_id").alias("src"), F.col("other").alias("dst")).distinct(), "both")
    label = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("comp")), "label")
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        moved = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = written(moved.join(label.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp").select("node", "was", F.least("comp", "far").alias("comp")), "label")
        label = jump.select("node", "comp")
        if not jump.where("was <> comp").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def cluster_hints(edges: DataFrame) -> DataFrame:
    """n_clusters, largest: of the components of the edges."""
    sizes = components(edges).groupBy("comp").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def index_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (reply_id, from_i, to_i) with the ids stored at those places (reply_id, i, segment_id); out of range: dropped."""
    a = ids.select("reply_id", F.col("i").alias("from_i"), F.col("segment_id").alias("src"))
    b = ids.select("reply_id", F.col("i").alias("to_i"), F.col("segment_id").alias("dst"))
    return edges.join(a, ["reply_id", "from_i"]).join(b, ["reply_id", "to_i"]).select("reply_id", "src", "dst")


def edge_packets(edges: DataFrame, k: int = 5) -> DataFrame:
    """segment_id, others: the other ends of its first k edges, by id."""
    both = both_ways(edges).distinct()
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("segment_id").orderBy("other"))).where(F.col("r") <= k)
    return top.groupBy("segment_id").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("others"))


def recontextualization_links(items: DataFrame) -> DataFrame:
    """plan_id, pos, setup_pos, warning: each item that names an earlier beat (recontextualizes) with that beat's first item, if it comes earlier."""
    first = items.groupBy("plan_id", F.col("beat_id").alias("recontextualizes")).agg(F.min("pos").alias("setup_pos"))
    rows = items.where("recontextualizes is not null").join(first, ["plan_id", "recontextualizes"], "left")
    ok = F.col("setup_pos") < F.col("pos")
    return rows.select("plan_id", "pos", F.when(ok, F.col("setup_pos")).alias("setup_pos"), F.when(~F.coalesce(ok, F.lit(False)), F.lit("no earlier setup")).alias("warning"))


def plan_lineage(plans: DataFrame, rounds: int = 40) -> DataFrame:
    """plan_id, ancestor, depth: all plans above each plan along parent_plan_id, by pointer doubling.

    After round n the ancestors up to depth 2^n are known, so a chain of any length takes a logarithm of rounds; a loop
    of parents never ends and is an error. Lineage is cut by checkpoint().
    """
    checkpoints(plans.sparkSession)
    known = plans.where("parent_plan_id is not null").select("plan_id", F.col("parent_plan_id").alias("ancestor"), F.lit(1).alias("depth")).checkpoint()
    for n in range(rounds):
        # the farthest known ancestor's own ancestors come behind it
        far = known.where(F.col("depth") == 2**n).select("plan_id", F.col("ancestor").alias("via"))
        more = far.join(known.select(F.col("plan_id").alias("via"), "ancestor", (F.col("depth") + 2**n).alias("depth")), "via").select("plan_id", "ancestor", "depth").checkpoint()
        if more.isEmpty():
            return known
        known = known.unionByName(more)
    raise RuntimeError("a plan is its own ancestor")


def embedding_text(*parts: Column) -> Column:
    """The first 300 characters of the parts that aren't empty, joined by blanks."""
    return F.substring(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]), 1, 300)


def id_from_uri(uri: Column, prefix: str, suffix: str) -> Column:
    """The id in an address: without prefix and suffix, dashes as underscores."""
    return F.translate(F.regexp_replace(F.regexp_replace(uri, f"^{prefix}", ""), f"{suffix}$", ""), "-", "_")
