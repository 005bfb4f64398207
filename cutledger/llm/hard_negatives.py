"""Hard-negative mining (operator 12): angles to reference directions bound scores; only what may matter is scored."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tiles
from .scratch import cut

#: Reference directions, the rows (those of smallest hash) from which they are chosen, rows of a run, and groups of labels.
REFERENCES, SAMPLE, RUN, GROUPS = 12, 512, 32, 16
#: Angles are stored in single precision; bounds are widened by this much, far more than they can be off.
SAFE = 1e-5
LEAST = -(1 << 63)


def references(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Unit rows of ``sample`` that are far from each other: each next one has the smallest greatest cosine to those before."""
    x = sample[np.abs(sample).max(1) > 0].astype(np.float64) if len(sample) else sample
    if not len(x):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < min(most, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def angles(x: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The angle of each row to each direction; not a number for a zero row."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.arccos(np.clip((x @ directions.T) / norms[:, None], -1, 1)).astype(np.float32)


def intervals(mine: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of each row with all rows of each run.

    ``mine``: the rows' angles; ``low``, ``high``: the least and the greatest angle in each run; then the run's least and
    greatest norm. On the sphere an angle between two directions is no less than the difference of their angles to a
    third, and no more than their sum, or than what that sum leaves to the whole circle.
    """
    least, most = np.zeros((len(mine), len(low))), np.full((len(mine), len(low)), np.pi)
    for a, lo, hi in zip(mine.T, low.T, high.T, strict=True):
        a = a[:, None].astype(np.float64)
        with np.errstate(invalid="ignore"):
            least = np.fmax(least, np.fmax(a - hi, lo - a))
            most = np.fmin(most, np.fmin(a + hi, 2 * np.pi - a - lo))
    near, far = np.cos(np.maximum(least - SAFE, 0)), np.cos(np.minimum(most + SAFE, np.pi))
    size = norms[:, None]
    pad = size * longest * 1e-6 + 1e-3
    return size * far * np.where(far < 0, longest, shortest) - pad, size * near * np.where(near < 0, shortest, longest) + pad


def scores(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products of integer rows, as longs; ``longest``: a bound on the product of two norms, and so on each partial sum."""
    kind = np.float32 if longest < 2**24 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


_FIELDS = {"h": "int64", "g": "int64", "label": "int64", "norms": "float64", "angles": "float32"}
_ASKED = _FIELDS | {"x": "int32", "windows": "int64", "starts": "int64"}
_FOUND = _FIELDS | {"x": "int32", "ids": "int64", "starts": "int64", "low": "float32", "high": "float32", "shortest": "float64", "longest": "float64"}


def _runs(block: dict) -> dict:
    """``block`` with its rows in the order of their nearest reference and the angle to it, and the bounds of each run."""
    a = np.where(np.isnan(block["angles"]), np.float32(9), block["angles"])
    order = np.lexsort((a.min(1), a.argmin(1))) if a.size else np.arange(len(block["norms"]))
    counts = np.diff(block["starts"])[order]
    at = np.repeat(block["starts"][:-1][order] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    out = {k: block[k][order] for k in (*_FIELDS, "x")} | {"ids": block["ids"][at], "starts": np.concatenate([[0], np.cumsum(counts)])}
    begins = np.arange(0, len(order), RUN)
    kept = out["angles"]
    out["low"] = np.minimum.reduceat(np.where(np.isnan(kept), np.float32(np.inf), kept), begins, axis=0)
    out["high"] = np.maximum.reduceat(np.where(np.isnan(kept), np.float32(-np.inf), kept), begins, axis=0)
    empty = out["low"] > out["high"]
    out["low"][empty], out["high"][empty] = 0, np.pi
    return out | {"shortest": np.minimum.reduceat(out["norms"], begins), "longest": np.maximum.reduceat(out["norms"], begins)}


class Heaps:
    """For each of ``n`` owners the ``most`` entries of highest score, ties by smaller id."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.n = most, n
        self.owner, self.score, self.id, self.cls = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(n, LEAST)

    def add(self, owner: np.ndarray, score: np.ndarray, block: dict, row: np.ndarray) -> None:
        """All ids of the rows, of which only the first ``most`` are there."""
        counts = np.diff(block["starts"])[row]
        ids = block["ids"][np.repeat(block["starts"][:-1][row] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]
        new = np.repeat(owner, counts), np.repeat(score, counts), ids, np.repeat(block["h"][row], counts)
        self.owner, self.score, self.id, self.cls = (np.concatenate(p) for p in zip((self.owner, self.score, self.id, self.cls), new, strict=True))
        keep = tiles.best(self.owner, [-self.score, self.id], self.most)
        self.owner, self.score, self.id, self.cls = self.owner[keep], self.score[keep], self.id[keep], self.cls[keep]
        full = np.flatnonzero(np.bincount(self.owner, minlength=self.n) >= self.most)
        self.least[full] = self.score[np.searchsorted(self.owner, full, side="right") - 1]


def _scored(asked: dict, block: dict, wanted: np.ndarray) -> np.ndarray:
    """Scores of the rows with the runs that ``wanted`` marks; LEAST elsewhere."""
    out = np.full((asked["n"], block["n"]), LEAST)
    longest = float(asked["norms"].max() * block["norms"].max()) * (1 + 1e-9)
    for r in np.flatnonzero(wanted.any(0)):
        mine = np.flatnonzero(wanted[:, r])
        part = slice(r * RUN, min((r + 1) * RUN, block["n"]))
        out[mine, part] = scores(asked["x"][mine], block["x"][part], longest)
    return out


def _into(heaps: Heaps, owner: np.ndarray, values: np.ndarray, ok: np.ndarray, block: dict) -> None:
    """The best of the marked values of each row go into the heap of ``owner``."""
    if not ok.any():
        return
    if values.shape[1] > heaps.most and ok.sum() > 8 * heaps.most * len(values):
        values = np.where(ok, values, LEAST)
        cut_at = np.partition(values, -heaps.most, axis=1)[:, -heaps.most]
        ok &= values >= cut_at[:, None]
    i, j = np.nonzero(ok)
    heaps.add(owner[i], values[i, j], block, j)


def alike(asked: dict, blocks: list[dict], most: int) -> tuple[Heaps, int]:
    """The rows of the same label with the highest scores, and how many pairs were scored."""
    heaps, pairs = Heaps(asked["n"], most), 0
    for block in blocks:
        _, high = intervals(asked["angles"], asked["norms"], block["low"], block["high"], block["shortest"], block["longest"])
        same = asked["label"][:, None] == block["label"]
        wanted = (high >= heaps.least[:, None]) & np.logical_or.reduceat(same, np.arange(0, block["n"], RUN), axis=1)
        values = _scored(asked, block, wanted)
        pairs += int(wanted.sum()) * RUN
        _into(heaps, np.arange(asked["n"]), values, same & (values >= heaps.least[:, None]) & (values > LEAST), block)
    return heaps, pairs


def unlike(asked: dict, blocks: list[dict], most: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[Heaps, int]:
    """For each window of each row the rows of other labels with the highest scores in it, and how many pairs were scored.

    A window holds the scores s with low * positive <= s <= high * positive, as fractions; it shrinks from below as
    its heap fills. A run is scored for the rows with a window that its bounds overlap.
    """
    counts = np.diff(asked["starts"])
    owner, of = np.repeat(np.arange(asked["n"]), counts), asked["windows"]
    floor, top = -((-of * low[0]) // low[1]), (of * high[0]) // high[1]
    heaps, pairs = Heaps(len(of), most), 0
    ranks = np.arange(len(of)) - np.repeat(asked["starts"][:-1], counts)
    for block in blocks:
        first, last = intervals(asked["angles"], asked["norms"], block["low"], block["high"], block["shortest"], block["longest"])
        differs = asked["label"][:, None] != block["label"]
        any_differs = np.logical_or.reduceat(differs, np.arange(0, block["n"], RUN), axis=1)
        bottom = np.maximum(floor, heaps.least)
        wanted = np.zeros(first.shape, bool)
        for r in range(int(ranks.max(initial=-1)) + 1):
            w = np.flatnonzero(ranks == r)
            wanted[owner[w]] |= (last[owner[w]] >= bottom[w, None]) & (first[owner[w]] <= top[w, None])
        wanted &= any_differs
        values = _scored(asked, block, wanted)
        pairs += int(wanted.sum()) * RUN
        for r in range(int(ranks.max(initial=-1)) + 1):
            w = np.flatnonzero(ranks == r)
            mine = values[owner[w]]
            ok = (mine >= bottom[w, None]) & (mine <= top[w, None]) & differs[owner[w]] & (mine > LEAST)
            _into(heaps, w, mine, ok, block)
    return heaps, pairs


def integers(vector: str, scale: float) -> Column:
    """floor(scale * x) of each component, in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def mine(vectors: DataFrame, anchors: Column, scale: float = 256, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for the rows of ``vectors``
    (vec_id, embedding, label) that ``anchors`` (a condition on vec_id) marks.

    Components become floor(scale * x); a score is the inner product of those, exact. An anchor's positives are its
    ``positives`` other rows of the same label with the highest scores; for each of them come the ``negatives`` rows of other
    labels with the highest scores from low to high (fractions) of the positive's. Ties go to the smaller vec_id.

    Rows without vec_id, label or vector, with an empty vector, with a null or a value that isn't finite, or with integers
    whose squares add up to 2**53 or more (doubles would not hold their scores) take no part. Zero vectors do. Vectors of different length
    don't meet. A repeated row counts once; an id that stands for several vectors or labels names several rows. Other columns
    are ignored. Empty tables give no rows.

    Rows are dealt in blocks by groups of labels and by a hash, so a label with a third of the rows has more blocks, not
    larger ones. References are rows of a sample of fixed size; each row's angles to them are stored in its block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("_label"), F.col("embedding").cast("array<double>" if _double(vectors) else "array<float>").alias("_v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("_label").isNotNull() & tiles.sound("_v", zero=True))
    rows = rows.where(F.aggregate("_v", F.lit(0.0), lambda t, x: t + F.pow(F.floor(x.cast("double") * float(scale)).cast("double"), 2)) < 2.0**53)
    rows = rows.select("vec_id", F.xxhash64("_label").alias("label"), integers("_v", scale).alias("vector"))
    most = positives + 1
    found = tiles.classes(rows, ["vector", "label"], max(most, negatives)).withColumn("dim", F.size("vector"))
    found = cut(found.withColumn("part", F.pmod("label", F.lit(GROUPS)).cast("int")), "classes")
    own = rows.where(anchors).select(F.xxhash64("vector", "label").alias("h"), F.hash("vector", "label").alias("g"), F.col("vec_id").alias("anchor_id"))
    own = cut(own.distinct(), "anchors")
    asked = found.join(own.select("h", "g").distinct(), ["h", "g"], "left_semi").drop("ids")
    asked = cut(asked, "asked")

    sizes = {r["part"]: r for r in found.groupBy("part").agg(F.count("*").alias("n"), F.max("dim").alias("dim")).collect()}
    n_asked = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = list(range(GROUPS))
    blocks = [ceil(sizes[p]["n"] / tiles.ROWS) if p in sizes else 0 for p in parts]
    queries = [ceil(n_asked.get(p, 0) / tiles.ASKED) for p in parts]
    before, asked_before = np.concatenate([[0], np.cumsum(blocks)]).tolist(), np.concatenate([[0], np.cumsum(queries)]).tolist()
    wide = max([0, *(r["dim"] for r in sizes.values())])
    known: dict[int, np.ndarray] = {}
    sample = [r["vector"] for r in found.orderBy("h", "g").select("vector").limit(SAMPLE).collect()]
    for size in {len(v) for v in sample}:
        known[size] = references(np.array([v for v in sample if len(v) == size], np.int64))
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("part") + 1)
    dealt = lambda df, name, counts, starts: df.withColumn(name, (of(starts) + F.pmod("h", F.greatest(of(counts), F.lit(1)))).cast("int"))

    def basic(table: pa.Table) -> dict[str, np.ndarray]:
        out = {c: table[c].to_numpy() for c in ("h", "g", "label")} | {"x": tiles.matrix(table["vector"], np.int32)}
        real = out["x"].astype(np.float64)
        out["norms"] = np.sqrt((real * real).sum(1))
        out["angles"] = angles(real, out["norms"], known.get(real.shape[1], np.zeros((0, real.shape[1]))))
        return out

    def pack_asked(table: pa.Table) -> dict[str, np.ndarray]:
        out = basic(table)
        out["windows"], out["starts"] = tiles.ragged(table["windows"])
        return out

    def pack_found(table: pa.Table) -> dict[str, np.ndarray]:
        out = basic(table)
        out["ids"], out["starts"] = tiles.ragged(table["ids"])
        return _runs(out)

    def opened(table: pa.Table, fields: dict[str, str]) -> list[dict]:
        out = tiles.unpacked(table, fields)
        for b in out:
            b["x"], b["angles"] = b["x"].reshape(b["n"], -1), b["angles"].reshape(b["n"], -1)
            for c in ("low", "high"):
                if c in b:
                    b[c] = b[c].reshape(len(b["longest"]), -1)
        return out

    schema = "h long, g long, positive_score long, vec_id long, cls long, score long"

    def table_of(block: dict, owner: np.ndarray, of: np.ndarray, heaps: Heaps) -> pa.Table:
        return pa.table([pa.array(c) for c in (block["h"][owner], block["g"][owner], of, heaps.id, heaps.cls, heaps.score)], names=[c.split()[0] for c in schema.split(", ")])

    none = np.zeros(0, np.int64)

    def first_run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        for block in opened(mine, _ASKED) if theirs.num_rows else []:
            heaps, _ = alike(block, opened(theirs, _FOUND), most)
            return table_of(block, heaps.owner, np.zeros(len(heaps.owner), np.int64), heaps)
        return table_of({"h": none, "g": none}, none, none, Heaps(0, 1))

    def second_run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        for block in opened(mine, _ASKED) if theirs.num_rows else []:
            heaps, _ = unlike(block, opened(theirs, _FOUND), negatives, low, high)
            owner = np.repeat(np.arange(block["n"]), np.diff(block["starts"]))
            return table_of(block, owner[heaps.owner], block["windows"][heaps.owner], heaps)
        return table_of({"h": none, "g": none}, none, none, Heaps(0, 1))

    right = cut(tiles.packed(dealt(found, "j", blocks, before), ["dim", "part", "j"], _FOUND, pack_found), "blocks")
    n_strips = tiles.strips(before[-1], asked_before[-1], wide, spark.sparkContext.defaultParallelism)

    def left(windows: DataFrame) -> DataFrame:
        return tiles.packed(dealt(windows, "i", queries, asked_before), ["dim", "i"], _ASKED, pack_asked)

    span = lambda a, n: F.when(n > 0, F.sequence(a, a + F.greatest(n, F.lit(1)) - 1))
    same = span(of(asked_before[:-1]), of(queries))
    firsts = tiles.join(left(asked.withColumn("windows", F.expr("cast(array() as array<long>)"))), right, same, n_strips, first_run, schema)
    near = _first(firsts, ["h", "g"], most)
    lists = near.groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "cls"))).alias("near"))
    other = F.filter("near", lambda x: (x["vec_id"] != F.col("anchor_id")) | (x["cls"] != F.col("h")))
    pairs = own.join(lists, ["h", "g"]).select("h", "g", "anchor_id", F.explode(F.slice(other, 1, positives)).alias("x"))
    pairs = cut(pairs.select("h", "g", "anchor_id", F.col("x.vec_id").alias("positive_id"), (-F.col("x.minus")).alias("positive_score")), "positives")

    windows = pairs.where("positive_score >= 0").groupBy("h", "g").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))
    every = F.sequence(F.lit(0), F.lit(max(asked_before[-1], 1) - 1))
    seconds = tiles.join(left(asked.join(windows, ["h", "g"])), right, every, n_strips, second_run, schema)
    chosen = _first(seconds, ["h", "g", "positive_score"], negatives).groupBy("h", "g", "positive_score")
    chosen = cut(chosen.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("far")), "negatives")
    out = pairs.join(chosen, ["h", "g", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("far").alias("rank", "x"))
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.minus")).alias("negative_score"))


def _double(vectors: DataFrame) -> bool:
    kind = vectors.schema["embedding"].dataType
    return not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType))


def _first(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` rows of highest score of each ``by``, ties by smaller vec_id."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
