"""Embedding near-dedup (operator 6): random projections decoded to points of the E8 lattice, in several tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .families import BLOCK, forest
from .filters import in_filter, seed_filter
from .scratch import cut
from .words import mix

#: Measured on random directions: pairs of cosine 0.9 meet in a table 97 times in 100, of 0.95 always (tests/llm).
TABLES, PROBES, SCALE = 10, 20, 0.6


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, float)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum (D8)."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) % 2)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.argmax(np.abs(gap), axis=1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] < 0, -1, 1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: the nearer of those in D8 and in D8 + 1/2."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Tables:
    """``tables`` hashes of a vector; each joins the cells of ``blocks`` lattices of eight random directions."""

    def __init__(self, dim: int, tables: int = TABLES, blocks: int = 2, scale: float = SCALE, probes: int = PROBES, seed: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.directions = rng.standard_normal((tables * blocks * 8, dim)) * scale
        self.offsets = rng.random(tables * blocks * 8) * 2
        self.salt = rng.integers(1, 2**63, (blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _part(self, points: np.ndarray, block: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(((points * 2).astype(np.int64).astype(np.uint64) * self.salt[block]).sum(-1, dtype=np.uint64) + np.uint64(block))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors: own cell [n, tables] and cells to probe [n, tables, 1 + probes], own first, nearest next."""
        n = len(unit)
        # rounded, so that the order of additions, which depends on the batch, can't choose another cell
        y = np.rint((unit @ self.directions.T + self.offsets) * 2**20) / 2**20
        own = np.zeros((n, self.tables), np.uint64)
        near = np.zeros((n, self.tables, 1 + self.probes), np.uint64)
        for t in range(self.tables):
            parts, moved, gains = [], [], []
            for b in range(self.blocks):
                z = y[:, (t * self.blocks + b) * 8 :][:, :8]
                q = decode(z)
                parts.append(self._part(q, b))
                # moving to the neighbour q + v costs 2 - 2 v.(z - q) more squared distance
                gain = (z - q) @ ROOTS.T
                best = np.argpartition(-gain, self.probes - 1, axis=1)[:, : self.probes] if self.probes else np.zeros((n, 0), np.int64)
                gains.append(np.take_along_axis(gain, best, 1))
                moved.append(self._part(q[:, None, :] + ROOTS[best], b))
            with np.errstate(over="ignore"):
                total = np.sum(parts, axis=0, dtype=np.uint64)
                own[:, t] = near[:, t, 0] = mix(total + np.uint64(t))
                if self.probes:
                    all_gain = np.concatenate(gains, 1)
                    all_key = np.concatenate([total[:, None] - parts[b][:, None] + moved[b] for b in range(self.blocks)], 1)
                    best = np.argsort(-all_gain, axis=1, kind="stable")[:, : self.probes]
                    near[:, t, 1:] = mix(np.take_along_axis(all_key, best, 1) + np.uint64(t))
        return own.astype(np.int64), near.astype(np.int64)


def _units(rows: list) -> np.ndarray:
    """The unit vectors (in doubles) of the rows that have one; null for those that are null, empty, zero or not finite."""
    out = np.empty(len(rows), object)
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(rows):
        if v is not None and len(v):
            by_size.setdefault(len(v), []).append(i)
    for which in by_size.values():
        x = np.array([rows[i] for i in which], float)
        top = np.abs(x).max(1)
        ok = np.isfinite(top) & (top > 0)
        x = x[ok] / top[ok, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        for i, u in zip(np.array(which)[ok], x, strict=True):
            out[i] = u
    return out


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id, cls (of equal vectors; null for one that links with nothing), vector (as given: floats stay floats)."""
    kind = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = part.column("embedding").to_pylist()
            some = [i for i, u in enumerate(_units(rows)) if u is not None]
            cls: list = [None] * len(rows)
            with np.errstate(over="ignore"):
                for i in some:
                    raw = np.array(rows[i], float).view(np.uint64)
                    cls[i] = int((mix(raw + np.arange(len(raw), dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                keys = mix(np.array([c or 0 for c in cls], np.uint64) + np.array([len(r or ()) for r in rows], np.uint64)).astype(np.int64)
            cls = [None if c is None else int(k) for c, k in zip(cls, keys, strict=True)]
            vector = [r if c is not None else None for r, c in zip(rows, cls, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cls, pa.int64()), pa.array(vector, pa.list_(pa.float32() if kind == "float" else pa.float64()))], names=["vec_id", "cls", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"))
    return rows.mapInArrow(run, f"vec_id long, cls long, vector array<{kind}>")


def _cells(classes: DataFrame) -> DataFrame:
    """cls, own (a cell for each table), near (cells to probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for part in batches:
            rows = _units(part.column("vector").to_pylist())
            for size in sorted({len(r) for r in rows}):
                which = [i for i, r in enumerate(rows) if len(r) == size]
                tables = known.setdefault(size, Tables(size))
                own, near = tables.cells(np.array([rows[i] for i in which]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls").take(pa.array(which)), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(near.reshape(len(which), -1)), pa.list_(pa.int64()))], names=["cls", "own", "near"]
                )

    return classes.select("cls", "vector").mapInArrow(run, "cls long, own array<long>, near array<long>")


def _visits(cells: DataFrame, residents: DataFrame) -> DataFrame:
    """cls, cell of the cells to probe, without most of those that no vector lives in: a filter of fixed size goes to the tasks."""
    bits = cells.sparkSession.sparkContext.broadcast(seed_filter(residents.select(F.col("cell").alias("seed"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            near = part.column("near")
            flat = near.flatten().to_numpy()
            owner = np.repeat(np.arange(part.num_rows), np.diff(near.offsets.to_numpy()))
            hit = in_filter(bits.value, mix(flat.view(np.uint64)))
            yield pa.RecordBatch.from_arrays([part.column("cls").take(pa.array(owner[hit])), pa.array(flat[hit])], names=["cls", "cell"])

    return cells.select("cls", "near").mapInArrow(run, "cls long, cell long")


def _meets(tables: Tables, units: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows of ``units``, in each table: does low probe high's cell, does high probe low's."""
    some, place = np.unique(np.concatenate([low, high]), return_inverse=True)
    own, near = tables.cells(np.stack(units[some]))
    low, high = place[: len(low)], place[len(low) :]
    forth, back = (np.zeros((len(low), own.shape[1]), bool) for _ in range(2))
    for k in range(0, len(low), 8192):
        a, b = low[k : k + 8192], high[k : k + 8192]
        forth[k : k + 8192] = (near[a] == own[b][:, :, None]).any(2)
        back[k : k + 8192] = (near[b] == own[a][:, :, None]).any(2)
    return forth, back


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding).

    Two vectors are linked if a table brings them together and their cosine, in doubles, is ``least`` or more.
    n_links counts the other rows linked directly; component_id is the smallest vec_id reachable; kept says that
    it is the row's own. Equal vectors are one class and link with each other. A vector that is null, empty, zero,
    or holds a null or a value that isn't finite links with nothing; vectors of different length don't meet.
    A null vec_id is ignored for the smallest. Other columns are ignored.

    Visitors and residents of a cell are compared in blocks; a pair that meets in more than one table counts in
    the first only, which its two vectors show by themselves. From a block come sums and a forest of its links.
    Vectors travel as they were given, and become doubles where they are compared.
    """
    spark = vectors.sparkSession
    rows = cut(_classes(vectors), "vectors")
    classes = cut(rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("vector").alias("vector")), "classes")
    cells = cut(_cells(classes), "cells")
    residents = cells.select("cls", F.posexplode("own").alias("t", "cell"))
    homes = residents.groupBy("cell").agg(F.count("*").alias("nr"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min("t").alias("t"))
    visits = _visits(cells, residents).join(homes, "cell").where("lo < hi or cls <> lo")
    visits = cut(visits.select("cell", "cls", "t", "nr"), "visits")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    buckets = cut(visits.groupBy("cell", "t", "nr").agg(F.count("*").alias("nv")).withColumns({"br": parts("nr"), "bv": parts("nv")}), "buckets")
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = residents.select("cls", "cell").join(buckets, "cell").withColumn("r", mine("br")).withColumn("v", all_of("bv")).withColumn("visitor", F.lit(False))
    here = visits.select("cls", "cell").join(buckets, "cell").withColumn("v", mine("bv")).withColumn("r", all_of("br")).withColumn("visitor", F.lit(True))
    entries = there.unionByName(here)
    total = buckets.agg(F.sum(F.col("nr") + F.col("nv"))).first()[0] or 0
    groups = max(spark.sparkContext.defaultParallelism * 4, total // (8 * BLOCK))
    entries = entries.withColumn("grp", F.when((F.col("br") == 1) & (F.col("bv") == 1), F.pmod(F.xxhash64("cell"), F.lit(groups))).otherwise(F.xxhash64("cell", "r", "v")))
    entries = entries.select("grp", "cell", "t", "r", "v", "visitor", "cls").join(classes.select("cls", "m", "vector"), "cls")

    def compare(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(bucket=f.groupby(["cell", "r", "v"], sort=False).ngroup()).sort_values(["visitor", "bucket"], kind="stable")
        seen = f["visitor"].to_numpy(bool)
        bucket, cls, m, t = (f[c].to_numpy() for c in ("bucket", "cls", "m", "t"))
        split = len(f) - int(seen.sum())
        lo, hi = (np.searchsorted(bucket[split:], bucket[:split], side=s) for s in ("left", "right"))
        units = _units(f["vector"].tolist())
        counts, left, right = {}, [], []
        tables: dict[int, Tables] = {}
        ends = np.cumsum(hi - lo)
        at = 0
        while at < split:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 50_000, side="right")))
            n = (hi - lo)[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            j = np.repeat(lo[at:stop] - np.cumsum(n) + n, n) + np.arange(int(n.sum())) + split
            at = stop
            keep = cls[i] != cls[j]
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            cos = np.einsum("ij,ij->i", np.stack(units[i]), np.stack(units[j]))
            i, j = i[cos >= least], j[cos >= least]
            if not len(i):
                continue
            size = len(units[i[0]])
            low_is_visitor = cls[j] < cls[i]
            low, high = np.where(low_is_visitor, j, i), np.where(low_is_visitor, i, j)
            forth, back = _meets(tables.setdefault(size, Tables(size)), units, low, high)
            first = np.argmax(forth | back, axis=1)
            by_low = forth[np.arange(len(first)), first]
            keep = (first == t[i]) & (by_low == low_is_visitor)
            i, j = i[keep], j[keep]
            for a, b in ((i, j), (j, i)):
                for c, k in zip(cls[a].tolist(), m[b].tolist(), strict=True):
                    counts[c] = counts.get(c, 0) + k
            left.append(cls[i])
            right.append(cls[j])
        out = [pd.DataFrame({"a": list(counts), "b": list(counts.values()), "link": False})]
        if left:
            names, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
            half = len(place) // 2
            label = forest(place[:half], place[half:], len(names))
            moved = label != np.arange(len(names))
            out.append(pd.DataFrame({"a": names[moved], "b": names[label[moved]], "link": True}))
        return pd.concat(out).astype({"a": "int64", "b": "int64", "link": "bool"})

    found = cut(entries.groupBy("grp").applyInPandas(compare, "a long, b long, link boolean"), "links")
    reached = components(found.where("link").select("a", "b")).select(F.col("node").alias("cls"), "comp")
    links = found.where("not link").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("others"))
    named = classes.select("cls", "least", "m").join(reached, "cls", "left").join(links, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = cut(named.join(smallest, "comp").select("cls", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "named")
    out = rows.select("vec_id", "cls").join(named, "cls", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))
