"""Benchmark decontamination (operator 10): spaced-seed hashes, joined, then overlaps verified along their diagonals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import in_filter, seed_filter
from .scratch import cut
from .words import Words, chunks, mix, powers

#: Fixed masks over a window of words: 1 is compared, 0 ignored. Eight words are compared in each. Any LEAST_WORDS words
#: or more of which LEAST_SHARE are equal hold eight equal words in one of them (tests go through all such parts).
MASKS = (
    "11111111", "1111011101", "110110101101", "1011001110011", "1110010011011", "11100011111", "11111100101",
    "1101010100111", "1101101100101", "1100011010111", "101011101011", "1111110011", "111111100001",
)
#: A part of this many words at least, this share of them equal, is an overlap; an item of fewer words counts whole.
LEAST_WORDS, LEAST_SHARE = 13, 0.8


def short_masks(size: int, share: float) -> list[str]:
    """Masks over a whole item of ``size`` words: at least one compares only equal words if ``share`` of all are equal.

    The words are cut into four blocks more than words may differ; each mask leaves out as many blocks as may differ.
    """
    others = int(size * (1 - share) + 1e-9)
    blocks = np.array_split(np.arange(size), min(size, others + 4) if others else 1)
    out = []
    for left in combinations(range(len(blocks)), others):
        gone = {int(i) for k in left for i in blocks[k]}
        out.append("".join("0" if i in gone else "1" for i in range(size)))
    return out


def _seeds(words: Words, short: dict[int, list[str]], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Seed hashes and places (word index in the batch) for each mask and window inside one text.

    ``short`` has the masks of items of each size under LEAST_WORDS; they apply to texts of that size only if ``whole``.
    """
    counts = np.diff(words.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    power = powers(LEAST_WORDS + 1)
    masks = [(mask, 0) for mask in MASKS] + [(mask, size) for size, those in short.items() for mask in those]
    # a sum over each 1, 2, ... words in a row; no closure that refers to itself, which would hold them till a collection of cycles
    sums = [words.hash]
    for size in range(2, min(max(len(r) for mask, _ in masks for r in re.findall("1+", mask)), len(words.hash)) + 1):
        sums.append(sums[-1][:-1] + words.hash[size - 1 :] * power[size - 1])
    for number, (mask, size) in enumerate(masks):
        m = len(words.hash) - len(mask) + 1
        if m <= 0:
            continue
        at = owner[:m] == owner[len(mask) - 1 :]
        if size and whole:
            at &= counts[owner[:m]] == size
        at = np.flatnonzero(at)
        # the salt depends on the mask alone, not on which other sizes are sought
        salt = (1000 * size + int(mask, 2) if size else number + 1) * 0xA24BAED4963EE407
        total = np.full(m, np.uint64(salt % 2**64))
        for r in re.finditer("1+", mask):
            total += sums[r.end() - r.start() - 1][r.start() : r.start() + m] * power[r.start()]
        yield mix(total[at]), at


def _table(bench: DataFrame, short: dict[int, list[str]]) -> DataFrame:
    """item, words (hashes), seeds (hash, place): of each distinct text of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words = Words(part.column("text"), alnum=True)
            found = list(_seeds(words, short, whole=True)) or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            seeds, places = (np.concatenate(x) for x in zip(*found, strict=True))
            owner = np.searchsorted(words.first, places, side="right") - 1
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("item_id"),
                    pa.ListArray.from_arrays(words.first.astype(np.int32), words.hash.astype(np.int64)),
                    pa.ListArray.from_arrays(bounds, seeds[order].astype(np.int64)),
                    pa.ListArray.from_arrays(bounds, (places - words.first[owner])[order].astype(np.int32)),
                ],
                names=["item_id", "item_words", "seed", "place"],
            )

    return bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, item_words array<long>, seed array<long>, place array<int>")


def overlap(words: np.ndarray, item: np.ndarray, shift: int, least: int, share: float) -> tuple[int, int, int] | None:
    """A part of the diagonal word[i + shift] = item[i] with ``share`` equal words: (first of item, words, equal), or None if none is long enough.

    Each equal word weighs 1 - share, each other word -share. The part of the largest sum is taken if it has ``least``
    words or the whole item, else the longest part whose sum is not negative.
    """
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    floor = min(least, len(item))
    if high - low < max(floor, 1):
        return None
    same = words[low + shift : high + shift] == item[low:high]
    # whole numbers; the + 1 prefers the longer of equal sums and can't make a negative sum positive
    weight = round(share * 10_000)
    total = np.concatenate([[0], np.cumsum(np.where(same, 10_000 - weight, -weight) * (len(same) + 1) + 1)])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    start = int(np.argmin(total[: end + 1]))
    if end - start < floor:
        starts = np.searchsorted(-lowest, -total)
        end = int(np.argmax(np.arange(len(total)) - starts))
        start = int(starts[end])
    n = end - start
    if n < floor:
        return None
    return low + start, n, int(same[start:end].sum())


def contaminated(docs: DataFrame, bench: DataFrame, least: int = LEAST_WORDS, share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, text_key, item_id, doc_word, item_word, n_words, n_equal: the longest overlap of each document with each item.

    Words are runs of letters and digits, lower-cased (A-Z). An overlap is a part of ``least`` words or more, or of the
    whole item, of which ``share`` are equal; none is missed at LEAST_WORDS and LEAST_SHARE or above. text_key is
    xxhash64 of the text, which with doc_id finds the row again. Null and empty texts, and items without words,
    overlap with nothing. Rows that repeat give one row. Only a filter of fixed size goes to all tasks; seeds that
    pass it are joined, so a larger benchmark costs more work, never memory.
    """
    short = {size: short_masks(size, share) for size in range(1, LEAST_WORDS)}
    items = cut(_table(bench, short), "items")
    seeds = cut(items.select("item_id", F.explode(F.arrays_zip("seed", "place")).alias("s")).select("item_id", "s.seed", F.col("s.place").alias("item_place")), "seeds")
    # shorter items are looked for whole; there are LEAST_WORDS - 1 such lengths at most
    sizes = [r[0] for r in items.select(F.size("item_words")).where(F.size("item_words").between(1, LEAST_WORDS - 1)).distinct().collect()]
    sought = {size: short[size] for size in sizes}
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(seeds, mixed=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for part in chunks(batches):
            words = Words(part.column("text"), alnum=True)
            hits = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for found, places in _seeds(words, sought, whole=False):
                hit = in_filter(table, found)
                hits.append((found[hit], places[hit]))
            found, places = (np.concatenate(x) for x in zip(*hits, strict=True))
            if not len(found):
                continue
            owner = np.searchsorted(words.first, places, side="right") - 1
            order = np.argsort(owner, kind="stable")
            found, places, owner = found[order], places[order], owner[order]
            docs_hit, first = np.unique(owner, return_index=True)
            ends = np.append(first[1:], len(owner))
            rows = {
                "doc_id": [part.column("doc_id")[int(i)].as_py() for i in docs_hit],
                "text_key": [part.column("text_key")[int(i)].as_py() for i in docs_hit],
                "words": [words.hash[words.first[i] : words.first[i + 1]].astype(np.int64) for i in docs_hit],
                "seed": [found[a:b].astype(np.int64) for a, b in zip(first, ends, strict=True)],
                "place": [(places[a:b] - words.first[i]).astype(np.int32) for i, a, b in zip(docs_hit, first, ends, strict=True)],
            }
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))
    near = cut(keyed.mapInArrow(run, "doc_id long, text_key long, words array<long>, seed array<long>, place array<int>"), "hits")
    hits = near.select("doc_id", "text_key", F.explode(F.arrays_zip("seed", "place")).alias("s")).select("doc_id", "text_key", "s.seed", "s.place")
    lines = hits.join(seeds, "seed").select("doc_id", "text_key", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    # words depend on the text alone, so copies need one
    texts = near.select("text_key", "words").dropDuplicates(["text_key"])
    pairs = lines.select("text_key", "item_id", "shift").distinct().join(items.select("item_id", "item_words").dropDuplicates(["item_id", "item_words"]), "item_id").join(texts, "text_key")
    # of a text only the words along the item go on, and where they start
    low = F.greatest("shift", F.lit(0)).cast("int")
    pairs = pairs.withColumn("low", low).withColumn("words", F.slice("words", F.col("low") + 1, (F.size("item_words") + F.col("shift") - F.col("low")).cast("int")))
    pairs = pairs.select("text_key", "item_id", "shift", "low", "words", "item_words")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, item, shift, low, words, own in zip(f["text_key"], f["item_id"], f["shift"], f["low"], f["words"], f["item_words"], strict=True):
                if got := overlap(np.asarray(words), np.asarray(own), shift - low, least, share):
                    rows.append((key, item, got[0] + shift, *got))
            yield pd.DataFrame(rows, columns=["text_key", "item_id", "doc_word", "item_word", "n_words", "n_equal"]).astype("int64")

    sure = pairs.mapInPandas(verify, "text_key long, item_id long, doc_word long, item_word long, n_words long, n_equal long")
    best = sure.groupBy("text_key", "item_id").agg(F.max(F.struct("n_equal", F.negative("n_words"), F.negative("doc_word"), F.negative("item_word"))).alias("b"))
    best = best.select("text_key", "item_id", F.negative("b.col3").alias("doc_word"), F.negative("b.col4").alias("item_word"), F.negative("b.col2").alias("n_words"), "b.n_equal")
    return lines.select("doc_id", "text_key", "item_id").distinct().join(best, ["text_key", "item_id"]).select("doc_id", "text_key", "item_id", "doc_word", "item_word", "n_words", "n_equal")
