"""Exact links inside families of candidates, with bounded memory for any family size.

A family is what pairs of a common bucket with close estimates hold together. A family of more than ``block`` members is cut in blocks,
and each pair of blocks is compared in one group, so that no group holds more than two blocks. Small families
are compared many to a group. From a group only a spanning forest of its links comes out, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut

BLOCK = 256


def families(buckets: DataFrame, marks: DataFrame, num: int, den: int, errors: float) -> DataFrame:
    """node, comp for every node that is held together with another by pairs of a common bucket whose estimates are close.

    ``buckets``: node, bucket; ``marks``: node, n, regs. Only nodes of buckets with others get their registers, one byte
    of each: equal registers have equal bytes, so no close pair is lost. Inside a bucket all are compared, block by
    block; what a bucket alone brings together, without being close, holds no family together.
    """
    sizes = cut(buckets.groupBy(F.col("bucket").alias("fam")).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = cut(buckets.withColumnRenamed("bucket", "fam").join(sizes, "fam").select("fam", "node"), "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16)
            small = (regs ^ (regs >> np.uint16(8))).astype(np.uint8).tobytes()
            width = len(small) // max(b.num_rows, 1)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array([small[i : i + width] for i in range(0, len(small), width or 1)], pa.binary())], names=["node", "n", "marks"])

    small = marks.join(shared.select("node").distinct(), "node", "left_semi").select("node", "n", "regs").mapInArrow(run, "node long, n long, marks binary")
    members = shared.join(cut(small, "marks"), "node")

    def near(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        marks, n = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(rows), -1), rows["n"].to_numpy()
        apart, mine = (rows["lo"] != rows["hi"]).to_numpy(), rows["mine"].to_numpy()
        group = rows.groupby(["fam", "lo", "hi"], sort=False).ngroup().to_numpy()
        left, right = [], []
        for d in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero((group[:-d] == group[d:]) & ~(apart[d:] & (mine[:-d] == mine[d:])))
            i = i[den * np.minimum(n[i], n[i + d]) >= num * np.maximum(n[i], n[i + d])]
            i = i[(marks[i] == marks[i + d]).sum(1) >= marks.shape[1] * floor(n[i], n[i + d], num / den, errors)]
            left.append(i)
            right.append(i + d)
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))

    def found(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fam", "lo", "hi"], kind="stable")
        return _forest(rows["node"].to_numpy(), *near(rows))

    links = _dealt(members, sizes, BLOCK).groupBy("grp").applyInPandas(found, "a long, b long")
    return cut(components(cut(links.distinct(), "close")), "families")


def floor(n1: np.ndarray, n2: np.ndarray, share: float, errors: float) -> np.ndarray:
    """The least estimate at which a pair of sets of these sizes may still have Jaccard similarity ``share``.

    A small set fills few registers by itself, so its estimate is rougher and its floor lower.
    """
    from .hyperminhash import BUCKETS

    filled = BUCKETS * -np.expm1(-np.maximum(np.minimum(n1, n2), 1) / BUCKETS)
    return share - errors * np.sqrt(share * (1 - share) * (1 / BUCKETS + 1 / np.maximum(filled, 1)))


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Edges (a, b), as few as hold together what the pairs i, j of ``nodes`` do."""
    names, place = np.unique(np.concatenate([nodes[i], nodes[j]]), return_inverse=True)
    label = forest(place[: len(i)], place[len(i) :], len(names))
    moved = label != np.arange(len(names))
    return pd.DataFrame({"a": names[moved], "b": names[label[moved]]}).astype("int64")


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Labels of n nodes after these links: the least index that each reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets; elements of one set only are left out of the work."""
    values = np.concatenate([*a, *b]) if len(a) + len(b) else np.zeros(0)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(values):
        return out.astype(np.int64)
    _, which, count = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    keep = count[which] > 1
    which, owner = (np.cumsum(count > 1) - 1)[which[keep]], owner[keep]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    step = 2048
    for low in range(0, int(which[-1]) + 1 if len(which) else 0, step):
        i, j = np.searchsorted(which, [low, low + step])
        table = np.zeros((len(a) + len(b), step), np.float32)
        table[owner[i:j], which[i:j] - low] = 1
        out += table[: len(a)] @ table[len(a) :].T
    return np.rint(out).astype(np.int64)


def near_links(num: int, den: int, errors: float) -> Callable[[pd.DataFrame, pd.DataFrame, bool], tuple[np.ndarray, np.ndarray]]:
    """Compares members by registers first (estimate at least num/den less ``errors`` standard errors), then by their whole sets."""

    def links(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray]:
        from .hyperminhash import BUCKETS, estimate

        ra, rb = (np.frombuffer(b"".join(x["regs"]), np.uint16).reshape(len(x), BUCKETS) for x in (a, b))
        na, nb = a["n"].to_numpy(), b["n"].to_numpy()
        equal = np.zeros((len(a), len(b)), np.int16)
        for i in range(0, len(a), 32):
            equal[i : i + 32] = (ra[i : i + 32, None, :] == rb[None]).sum(-1, dtype=np.int16)
        low = floor(na[:, None], nb, num / den, errors)
        maybe = equal >= BUCKETS * low
        i, j = np.nonzero(maybe & (den * np.minimum(na[:, None], nb) >= num * np.maximum(na[:, None], nb)))
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            # registers equal by chance only add to the count above: here they are taken off
            keep = estimate(equal[i, j], na[i], nb[j]) >= low[i, j]
            i, j = i[keep], j[keep]
        if not len(i):
            return i, j
        us, i2 = np.unique(i, return_inverse=True)
        vs, j2 = np.unique(j, return_inverse=True)
        sa, sb = ([np.sort(np.asarray(s, np.int64)) for s in x["shingles"].iloc[k]] for x, k in ((a, us), (b, vs)))
        both = overlaps(sa, sb)[i2, j2]
        keep = den * both >= num * (na[i] + nb[j] - both)
        return i[keep], j[keep]

    return links


def _dealt(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """``members`` (fam, node, ...) with the group grp and the pair of blocks lo, hi of it that each is compared in, and its own block."""
    spark = members.sparkSession
    total = sizes.agg(F.sum("size")).first()[0] or 0
    groups = max(spark.sparkContext.defaultParallelism * 4, total // (4 * block))
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = members.join(sizes, "fam").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        own.withColumn("other", F.explode(other))
        .withColumn("lo", F.least("mine", "other"))
        .withColumn("hi", F.greatest("mine", "other"))
        .withColumn("grp", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("fam"), F.lit(groups))).otherwise(F.xxhash64("fam", "lo", "hi")))
        .drop("size", "blocks", "other")
    )


def compare(members: DataFrame, sizes: DataFrame, link: Callable, block: int = BLOCK) -> DataFrame:
    """``members``: fam, node and what ``link`` reads; ``sizes``: fam, size. Returns edges (a, b): in each group a forest of the links found.

    The number of groups follows the rows; a group holds at most 2 * block members of one family.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, one in rows.groupby(["fam", "lo", "hi"], sort=False):
            if len(one) < 2:
                continue
            lo, hi = one["lo"].iloc[0], one["hi"].iloc[0]
            a, b = (one, one) if lo == hi else (one[one["mine"] == lo], one[one["mine"] == hi])
            i, j = link(a, b, lo == hi)
            if len(i):
                found.append(_forest(np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()]), i, len(a) + j))
        return pd.concat(found) if found else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return _dealt(members, sizes, block).groupBy("grp").applyInPandas(run, "a long, b long")
