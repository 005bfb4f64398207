"""Language ID (operator 3): rank-order profiles of character n-grams, compared by out-of-place distance."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import chunks

#: n-grams in a language's profile, and most frequent n-grams of a text that are ranked.
PROFILE, RANKED = 400, 300
#: Partial counts that a task holds before it hands them on.
_HELD = 1 << 20
MOST_LANGUAGES = 10_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or a blank where it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.int64)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the 1- to 3-grams of letters of all texts, ordered by text within each n; and slices for texts.

    Runs of other characters count as one blank. A gram holds at most a leading or a trailing blank.
    Returns (keys, bounds[3, n + 1]): text i has keys[bounds[m, i]:bounds[m, i + 1]] for m = 0, 1, 2.
    """
    lens = np.array([len(t) for t in texts])
    joined = " " + " ".join(texts) + " "
    code = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    begins = np.cumsum(np.append(1, lens + 1))  # text i begins at begins[i]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    at = np.flatnonzero(keep)
    code = code[keep]
    owner = np.searchsorted(begins, at, side="right") - 1
    blank = code == 32
    one = np.flatnonzero(~blank)
    two = np.arange(len(code) - 1)
    three = np.flatnonzero(~blank[1:-1]) if len(code) > 2 else np.zeros(0, np.int64)
    keys = [code[one], code[:-1] << 21 | code[1:], code[three] << 42 | code[three + 1] << 21 | code[three + 2]]
    owners = [owner[one], np.where(blank[two], owner[two + 1], owner[two]), owner[three + 1]]
    shift, bounds = 0, []
    for o in owners:
        bounds.append(np.searchsorted(o, np.arange(len(texts) + 1)) + shift)
        shift += len(o)
    return np.concatenate(keys), np.array(bounds)


def _of(keys: np.ndarray, bounds: np.ndarray, i: int) -> np.ndarray:
    return np.concatenate([keys[b[i] : b[i + 1]] for b in bounds])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    rows = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
            held[lang] = [(keys, n)]
        return iter(())

    for part in chunks(batches):
        langs = np.array(part.column("lang").to_pylist(), object)
        texts = part.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            keys, _ = ngrams([texts[i] for i in np.flatnonzero(langs == lang)])
            held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
        rows = sum(len(p[0]) for x in held.values() for p in x)
        if rows > _HELD:
            merged()
            if sum(len(x[0][0]) for x in held.values()) > _HELD // 2:
                yield from _emit(held)
                held = {}
    merged()
    yield from _emit(held)


def _emit(held: dict) -> Iterator[pa.RecordBatch]:
    for lang, ((keys, n),) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])


def profiles(train: DataFrame, top: int = PROFILE) -> DataFrame:
    """lang, gram, rank (0 is the most frequent; ties by gram), counted over all rows of ``train`` (text, lang)."""
    counts = train.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(16)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < top).select("lang", "gram", "rank")


def identify(docs: DataFrame, train: DataFrame, top: int = PROFILE, ranked: int = RANKED) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``; other columns of ``docs`` that start with ``held`` pass.

    A text's ``ranked`` most frequent n-grams (ties by n-gram) are compared with each profile: an n-gram costs the
    difference of its ranks, or ``top`` where the profile lacks it. The language with the least sum wins, ties by
    name. score = 1 - sum / largest possible sum. A null text or one without a letter gives 'und', 0. Without a
    training row every text gives 'und', 0. Texts are used whole.
    """
    table = profiles(train, top).limit(MOST_LANGUAGES * top + 1).toPandas()
    if len(table) > MOST_LANGUAGES * top:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(table["lang"].unique())
    grams = np.unique(table["gram"].to_numpy()) if len(table) else np.zeros(0, np.int64)
    ranks = np.full((len(langs), len(grams) + 1), top, np.int64)
    for k, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        ranks[k, np.searchsorted(grams, own["gram"].to_numpy())] = own["rank"].to_numpy()
    missing = len(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            keys, bounds = ngrams(texts)
            pred, score = [], np.zeros(len(texts))
            for i in range(len(texts)):
                if not langs or bounds[0, i] == bounds[0, i + 1]:
                    pred.append("und")
                    continue
                own, n = np.unique(_of(keys, bounds, i), return_counts=True)
                own = own[np.argsort(-n, kind="stable")[:ranked]]
                at = np.minimum(np.searchsorted(grams, own), missing - 1)
                at = np.where(grams[at] == own, at, missing)
                theirs = ranks[:, at]
                cost = np.where(theirs == top, top, np.abs(theirs - np.arange(len(own)))).sum(1)
                best = int(np.argmin(cost))
                pred.append(langs[best])
                score[i] = 1 - cost[best] / (top * len(own))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.col("held_out") if "held_out" in docs.columns else F.lit(None).cast("boolean").alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
