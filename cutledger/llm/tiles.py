"""Vectors in packed blocks, and the join of blocks of queries with strips of blocks (operators 11 and 12).

Equal vectors are one row of a block, with the smallest of their ids; blocks are dealt by a hash, so that no label,
group of copies or other hot key makes one larger than the rest. A strip is a bounded number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of candidates and of queries, and the most bytes of vectors in a strip.
ROWS, ASKED, STRIP = 1024, 1024, 16 << 20


def sound(vector: str, zero: bool) -> Column:
    """Is the array there, not empty, without a null or a value that isn't finite (and, without ``zero``, not all zero)?"""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    ok = F.col(vector).isNotNull() & (F.size(vector) > 0) & finite
    return F.coalesce(ok if zero else ok & F.exists(vector, lambda x: x.cast("double") != 0), F.lit(False))


def classes(rows: DataFrame, same: list[str], most: int) -> DataFrame:
    """h, g (together the name of a class of rows equal in ``same``), those columns, and ids: its ``most`` smallest vec_ids.

    Ranks are cut before rows are shuffled, so a vector that a third of all rows have is no hot group.
    """
    named = rows.withColumn("h", F.xxhash64(*same)).withColumn("g", F.hash(*same))
    rank = F.dense_rank().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    firsts = named.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return firsts.groupBy("h", "g").agg(*[F.first(c).alias(c) for c in same], F.sort_array(F.collect_set("vec_id")).alias("ids"))


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Arrays of one length as a matrix."""
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)


def ragged(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays, and n + 1 offsets."""
    flat = lists.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.diff(flat.offsets.to_numpy())
    return flat.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def packed(rows: DataFrame, by: list[str], fields: dict[str, str], pack: Callable[[pa.Table], dict[str, np.ndarray]]) -> DataFrame:
    """A row for each value of ``by``: ``by``, n, and for each of ``fields`` (name -> numpy type) the bytes of an array that ``pack`` makes."""
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("n", T.IntegerType()), *(T.StructField(f, T.BinaryType()) for f in fields)])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        made = pack(table)
        columns = {c: pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(by, key, strict=True)}
        columns["n"] = pa.array([table.num_rows], pa.int32())
        return pa.table(columns | {f: pa.array([np.ascontiguousarray(made[f], kind).tobytes()], pa.binary()) for f, kind in fields.items()})

    return rows.groupBy(*by).applyInArrow(run, schema)


def unpacked(table: pa.Table, fields: dict[str, str]) -> list[dict[str, np.ndarray]]:
    """The blocks of ``table`` as arrays."""
    out = []
    for i in range(table.num_rows):
        block = {f: np.frombuffer(table[f][i].as_buffer(), kind) for f, kind in fields.items()}
        out.append(block | {"n": table["n"][i].as_py()})
    return out


def strips(blocks: int, asked: int, width: int, parallelism: int) -> int:
    """How many strips: each within STRIP bytes, and enough of them to keep all tasks busy."""
    of_one = max(1, STRIP // (ROWS * max(width, 1) * 8))
    return max(1, min(blocks, max(ceil(blocks / of_one), ceil(2 * parallelism / max(asked, 1)))))


def join(asked: DataFrame, blocks: DataFrame, meets: Column, n_strips: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` for each block of ``asked`` (dim, i) and each strip of ``blocks`` (dim, j): blocks of one strip meet it together.

    ``meets``: an array of the i that a block of ``blocks`` has to meet. Packed blocks are sent, not rows; a task holds one
    block of queries and one strip.
    """
    left = asked.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(n_strips - 1))))
    right = blocks.withColumn("strip", F.col("j") % n_strips).withColumn("i", F.explode(meets))
    key = ["dim", "i", "strip"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def best(owner: np.ndarray, order: list[np.ndarray], most: int) -> np.ndarray:
    """Indexes of the first ``most`` entries of each owner by ``order`` (the first array decides first): bounded heaps, all at once."""
    at = np.lexsort([*order[::-1], owner])
    mine = owner[at]
    begins = np.flatnonzero(np.diff(mine, prepend=mine[0] - 1 if len(mine) else 0))
    place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return at[place < most]
