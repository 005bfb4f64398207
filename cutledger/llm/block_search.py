"""Approximate nearest neighbours (operator 11): a block matrix join of int8 tiles with error bounds."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tiles
from .scratch import cut

#: Widest part of a row whose int8 products add up exactly in single precision: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, squared length of scale * codes, and a bound on the distance between that and the row, rounding included."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        scale = np.abs(x).max(1) / 127
        codes = np.rint(np.where(scale[:, None] > 0, x / np.where(scale > 0, scale, 1)[:, None], 0)).clip(-127, 127).astype(np.int8)
        near = codes * scale[:, None]
        square = (near * near).sum(1)
        error = np.sqrt(((x - near) ** 2).sum(1)) * (1 + 1e-9) + 1e-7 * np.sqrt(square)
    return codes, scale, square, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two int8 matrices."""
    total = None
    for k in range(0, max(a.shape[1], 1), EXACT):
        part = a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows i of ``x`` and j of ``y`` in double precision, terms added in their order."""
    out = np.empty(len(i))
    with np.errstate(over="ignore"):
        for k in range(0, len(i), 16384):
            gap = (x[i[k : k + 16384]] - y[j[k : k + 16384]]).T
            total = np.zeros(gap.shape[1])
            for part in gap:
                total += part * part
            out[k : k + 16384] = np.sqrt(total)
    return out


def search(asked: dict, blocks: list[dict], most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` nearest rows of ``blocks`` to each row of ``asked``: place in asked, vec_id, its class, distance.

    Of a tile, the int8 products bound all distances from both sides; only pairs that may be below what the heap's last
    entry, or the tile's own upper bounds, allow are worked out in doubles.
    """
    x, n = asked["x"], asked["n"]
    codes, scale, square, error = quantised(x)
    heap = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64, np.int64))  # owner, distance, smallest id, block, row
    last = np.full(n, np.inf)
    for b, block in enumerate(blocks):
        c, s, sq, e = quantised(block["x"])
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.sqrt(np.maximum(square[:, None] + sq - 2 * (scale[:, None] * s) * products(codes, c), 0))
            low, high = d - e - error[:, None], d + e + error[:, None]
        low[np.isnan(low)] = -np.inf
        high[np.isnan(high)] = np.inf
        reach = last if block["n"] < most else np.minimum(last, np.partition(high, most - 1, axis=1)[:, most - 1])
        i, j = np.nonzero(low <= reach[:, None])
        first = block["ids"][block["starts"][:-1]]
        new = (i, distances(x, block["x"], i, j), first[j], np.full(len(i), b), j)
        heap = tuple(np.concatenate(p) for p in zip(heap, new, strict=True))
        keep = tiles.best(heap[0], [heap[1], heap[2]], most)
        heap = tuple(p[keep] for p in heap)
        full = np.flatnonzero(np.bincount(heap[0], minlength=n) >= most)
        ends = np.searchsorted(heap[0], full, side="right") - 1
        last[full] = heap[1][ends]
    owner, gap, _, b, j = heap
    counts = np.array([blocks[p]["starts"][q + 1] - blocks[p]["starts"][q] for p, q in zip(b, j, strict=True)], np.int64)
    ids = [blocks[p]["ids"][blocks[p]["starts"][q] : blocks[p]["starts"][q + 1]] for p, q in zip(b, j, strict=True)]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    cls = np.repeat(np.array([blocks[p]["h"][q] for p, q in zip(b, j, strict=True)], np.int64), counts)
    owner, gap = np.repeat(owner, counts), np.repeat(gap, counts)
    keep = tiles.best(owner, [gap, ids], most)
    return owner[keep], ids[keep], cls[keep], gap[keep]


_FIELDS = {"h": "int64", "g": "int64", "ids": "int64", "starts": "int64"}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of ``vectors`` (vec_id, embedding) at the smallest Euclidean
    distance from each row of ``queries`` (query_id, embedding), nearest first, ties to the smaller vec_id; all, if fewer.

    Nothing is missed: bounds only spare work. score is the distance of the vectors as given, in doubles; one that is too
    large for a double is infinite. A query's own row (its id and its vector) isn't a candidate. Vectors that are null,
    empty, zero, or hold a null or a value that isn't finite take no part, nor do rows without an id; vectors of different
    length don't meet. A row that is repeated counts once; an id that stands for several vectors names several rows, and
    as a query has an answer for each. Other columns are ignored. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    kinds = [f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None for f in (vectors.schema["embedding"], queries.schema["embedding"])]
    kind = "float" if all(isinstance(x, T.FloatType) for x in kinds) else "double"
    width = "float32" if kind == "float" else "float64"
    fields = _FIELDS | {"x": width}

    def rows(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col(name).cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
        return df.where(F.col("vec_id").isNotNull() & tiles.sound("vector", zero=False))

    found = cut(tiles.classes(rows(vectors, "vec_id"), ["vector"], k + 1).withColumn("dim", F.size("vector")), "classes")
    own = rows(queries, "query_id").select(F.xxhash64("vector").alias("h"), F.hash("vector").alias("g"), F.col("vec_id").alias("query_id"), "vector")
    own = cut(own.distinct(), "queries")
    asked = cut(own.groupBy("h", "g").agg(F.first("vector").alias("vector")).withColumn("dim", F.size("vector")), "asked")
    n, wide = found.agg(F.count("*"), F.max("dim")).first()
    n_asked, blocks = ceil(asked.count() / tiles.ASKED), ceil(n / tiles.ROWS)
    parts = tiles.strips(blocks, n_asked, wide or 0, spark.sparkContext.defaultParallelism)

    def pack(table: pa.Table) -> dict[str, np.ndarray]:
        made = {c: table[c].to_numpy() for c in ("h", "g")} | {"x": tiles.matrix(table["vector"], np.dtype(width).type)}
        made["ids"], made["starts"] = tiles.ragged(table["ids"])
        return made

    dealt = lambda df, name, count: df.withColumn(name, F.pmod("h", F.lit(max(count, 1))).cast("int"))
    left = tiles.packed(dealt(asked.withColumn("ids", F.array(F.lit(0).cast("long"))), "i", n_asked), ["dim", "i"], fields, pack)
    right = tiles.packed(dealt(found, "j", blocks), ["dim", "j"], fields, pack)

    def opened(table: pa.Table) -> list[dict]:
        return [b | {"x": b["x"].reshape(b["n"], -1).astype(np.float64)} for b in tiles.unpacked(table, fields)]

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        names, columns = ["h", "g", "vec_id", "cls", "score"], [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64)]
        for block in opened(mine) if theirs.num_rows else []:
            owner, ids, cls, gap = search(block, opened(theirs), k + 1)
            columns = [block["h"][owner], block["g"][owner], ids, cls, gap]
        return pa.table([pa.array(c) for c in columns], names=names)

    meets = F.sequence(F.lit(0), F.lit(max(n_asked, 1) - 1))
    pairs = tiles.join(left, right, meets, parts, run, "h long, g long, vec_id long, cls long, score double")
    place = F.row_number().over(Window.partitionBy("h", "g").orderBy("score", "vec_id"))
    lists = pairs.withColumn("_place", place).where(F.col("_place") <= k + 1).groupBy("h", "g")
    lists = cut(lists.agg(F.sort_array(F.collect_list(F.struct("score", "vec_id", "cls"))).alias("near")), "nearest")
    # every query of a class takes the class's list without its own row, so that a vector that many queries have is no hot group
    other = F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["cls"] != F.col("h")))
    answers = own.select("h", "g", "query_id").join(lists, ["h", "g"]).select("query_id", F.posexplode(F.slice(other, 1, k)).alias("rank", "x"))
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
