"""Quality classifier (operator 1): document evidence with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut
from .words import _ALNUM, Words, chunks, mix, text_bytes

#: Labelled documents that the document classifier is fitted on at most (those with the least hash of doc_id).
SAMPLE = 20_000
NAMES = ["words", "word_len", "upper", "digits", "symbols", "stops", "rare_marks", "distinct", "same_lines", "same_runs", "glued"]
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 3
_CLASS[list(b".,;:'\"()-?")] = 4
_CLASS[33] = 5


def features(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text, each in 0..1 but for the first two (log of words, word length over 10)."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    size = np.maximum(np.diff(offsets), 1)
    kind = _CLASS[data]
    share = [np.diff(np.concatenate([[0], np.cumsum(kind == k)])[offsets]) / size for k in range(1, 6)]
    words = Words(texts)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    last = words.end - 1
    glued = np.bincount(owner, (~_ALNUM[data[last]] & (kind[last] != 4)) if len(last) else None, n) / some
    length = np.bincount(owner, words.end - words.start, n) / some
    runs, whole = words.shingles(3)
    distinct, same_runs = np.ones(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b > a:
            # long texts repeat words anyway: of each 200 words
            distinct[i] = len(np.unique(words.hash[a:b] ^ mix(np.arange(b - a) // 200))) / (b - a)
        if b - a > 3:
            same_runs[i] = 1 - len(np.unique(runs[a : b - 2])) / (b - a - 2)
    same_lines = np.zeros(n)
    if len(data):
        mark = np.concatenate([[0], np.cumsum(data == 10)])
        line = mark[words.start] if len(words.start) else np.zeros(0, np.int64)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
        first = np.flatnonzero(new)
        if len(first):
            with np.errstate(over="ignore"):
                place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
                key = mix(np.add.reduceat(words.hash * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), first))
            who = owner[first]
            pair = np.unique(np.stack([who.astype(np.uint64), key], 1), axis=0)
            lines = np.bincount(who, minlength=n)
            same_lines = 1 - np.bincount(pair[:, 0].astype(np.int64), minlength=n) / np.maximum(lines, 1)
            same_lines[lines == 0] = 0
    cols = [np.log1p(count), np.minimum(length, 50) / 10, share[0], share[1], share[2], share[3], share[4], distinct, same_lines, same_runs, glued]
    return np.stack(cols, 1)


@dataclass
class Model:
    """Logistic regression on hinges of each feature; ``prior`` is the share of good texts in the sample."""

    knots: np.ndarray
    weights: np.ndarray
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return _hinges(x, self.knots) @ self.weights


def _hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The constant, each feature, and its excess over each of its knots, scaled by the features' spread."""
    spread = np.maximum(knots[-1] - knots[0], 1e-3)
    parts = [np.ones((len(x), 1))] + [np.clip((x - k) / spread, -3, 3) if i == 0 else np.clip((x - k) / spread, 0, 3) for i, k in enumerate(knots[:-1])]
    return np.concatenate(parts, 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Newton steps; without both labels the log odds are those of the prior alone."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        knots = np.zeros((2, len(NAMES)))
        return Model(knots, np.append(np.log(prior / (1 - prior)), np.zeros(len(NAMES))), prior)
    knots = np.quantile(x, [0.02, 0.25, 0.5, 0.75, 0.9, 0.98], axis=0)
    h = _hinges(x, knots)
    w = np.zeros(h.shape[1])
    w[0] = np.log(prior / (1 - prior))
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(h @ w, -30, 30)))
        step = np.linalg.solve((h * (p * (1 - p) + 1e-9)[:, None]).T @ h + np.diag(keep), h.T @ (y - p) - keep * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return Model(knots, w, prior)


def site(source: Column) -> tuple[Column, Column]:
    """Host and path of a source or URL: what stands before the first slash (after a scheme), and the folder after it; '' for none."""
    bare = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.substring_index(bare, "/", 1)), F.regexp_extract(bare, r"^[^/]*(/(?:[^/?#]*/)*)", 1)


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """All columns of ``rows`` and ``_odds``, the log odds of the text in its column ``_row``, a struct."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_odds", T.DoubleType())])
    index = rows.columns.index("_row")
    field = rows.schema["_row"].dataType.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pc.struct_field(batch.column(index), [field]).cast(pa.string())], names=["text"])
            odds = [model.log_odds(features(part.column("text"))) for part in chunks(iter([texts]))]
            odds = np.concatenate(odds) if odds else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds)], names=[*batch.schema.names, "_odds"])

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the document classifier on at most ``sample`` rows of ``labels`` (doc_id, quality 0/1)."""
    ids = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    ids = ids.orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            x = features(part.column("text"))
            at = (np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, x.ravel())], names=["quality", "x"])

    got = rows.mapInArrow(run, "quality int, x array<double>").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    return fit(x, got["quality"].to_numpy(float))


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the mean of all, and how many rows a group's prior is worth (at least 1, at most 1e4), by moments.

    ``groups``: the sum s and count n of each group, and those of its parent, t and m. Spread of group means around
    their own parent's mean, beyond what rows that are drawn from that mean would show, is spread between groups.
    """
    mean = F.col("t") / F.col("m")
    noise = mean * (1 - mean)
    out = groups.agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("q"),
        F.sum(noise * (1 - F.col("n") / F.col("m"))).alias("expected"),
        F.sum(F.col("n") * (1 - F.col("n") / F.col("m"))).alias("free"),
        F.sum(F.col("n") * noise).alias("noise"),
    )
    between = F.greatest((F.col("q") - F.col("expected")) / F.greatest("free", F.lit(1e-9)), F.lit(1e-6))
    worth = F.when(F.col("free") > 1e-9, F.least(F.greatest(F.col("noise") / F.col("n") / between, F.lit(1.0)), F.lit(1e4))).otherwise(1e4)
    return out.select((F.col("s") / F.col("n")).alias(f"{name}_mean"), worth.alias(f"{name}_worth"))


def posteriors(scored: DataFrame) -> DataFrame:
    """``scored``: host, path, p (what is known or believed of each text). Returns host, path, their sums, and the priors' strengths.

    Counts are partial sums before the shuffle. Hosts are compared around the mean of all rows, paths around the mean
    of their own host.
    """
    paths = cut(scored.groupBy("host", "path").agg(F.sum("p").alias("ps"), F.count("*").cast("double").alias("pn")), "paths")
    hosts = cut(paths.groupBy("host").agg(F.sum("ps").alias("hs"), F.sum("pn").alias("hn")), "hosts")
    every = hosts.agg(F.sum("hs").alias("t"), F.sum("hn").alias("m"))
    both = paths.join(hosts, "host")
    of_hosts = _strength(hosts.select(F.col("hs").alias("s"), F.col("hn").alias("n")).crossJoin(F.broadcast(every)), "all")  # tables of one row
    of_paths = _strength(both.select(F.col("ps").alias("s"), F.col("pn").alias("n"), F.col("hs").alias("t"), F.col("hn").alias("m")), "path").select("path_worth")
    return cut(both.crossJoin(F.broadcast(of_hosts)).crossJoin(F.broadcast(of_paths)), "sites")


def judge(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE, text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without its text, if not ``text``), then ``_doc`` (text evidence alone), ``_site`` (the site's shrunken posterior), ``_good`` (both), ``_kept``.

    A document's own belief is taken out of its site's sums, the path's mean is shrunk to the host's and the
    host's to the mean of all, each by the strength that the spread between groups shows; a path that is its whole
    host has the host's mean. The posterior odds of the site take the place of the classifier's prior odds.
    ``_kept`` = ``_good`` >= ``least``. Without ``text`` the texts are read once.

    A null text counts as empty, a null source as site ''. Repeated rows count each. Without labels the
    classifier says 1/2 of every text and all are kept. Empty tables give empty results. Other columns pass
    unchanged; a column of ``docs`` that has one of the four names is replaced.
    """
    model = train(docs, labels, sample)
    host, path = site(F.col("source"))
    # the row travels as one struct, so that none of its names can clash with those used here
    packed = docs.select(F.struct(*docs.columns).alias("_row"), host.alias("_host"), path.alias("_path"))
    columns = [c for c in docs.columns if text or c != "text"]
    slim = F.col("_row") if text else F.struct(*[F.col("_row")[c].alias(c) for c in columns], F.lit(0).alias("_none"))
    odds = evidence(packed, model).select(slim.alias("_row"), "_host", "_path", "_odds")
    # whole texts aren't written once more: with them, the odds are worked out again for the result
    odds = odds if text else cut(odds, "odds")
    odds = odds.withColumn("_doc", 1 / (1 + F.exp(-F.col("_odds"))))
    sites = posteriors(cut(odds.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_doc").alias("p")), "beliefs"))
    sites = sites.withColumnsRenamed({c: f"_{c}" for c in sites.columns})
    both = odds.join(sites, ["_host", "_path"])
    mine = F.col("_doc")
    host_mean = (F.col("_hs") - mine + F.col("_all_worth") * F.col("_all_mean")) / (F.col("_hn") - 1 + F.col("_all_worth"))
    path_mean = (F.col("_ps") - mine + F.col("_path_worth") * host_mean) / (F.col("_pn") - 1 + F.col("_path_worth"))
    path_mean = F.when(F.col("_pn") == F.col("_hn"), host_mean).otherwise(path_mean)
    at = F.least(F.greatest(path_mean, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds_all = F.col("_odds") - float(np.log(model.prior / (1 - model.prior))) + F.log(at / (1 - at))
    out = both.withColumn("_site", at).withColumn("_good", 1 / (1 + F.exp(-odds_all))).withColumn("_kept", F.col("_good") >= least)
    new = ["_doc", "_site", "_good", "_kept"]
    return out.select(*[F.col("_row")[c].alias(c) for c in columns if c not in new], *new)
