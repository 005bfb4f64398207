"""Periodic runs (operator 13): suffix classes united by falling LCP; positions that become neighbours within it seed runs."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

#: The shortest run, and how often its period has to fit into it.
LEAST, TIMES = 6, 4


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words of one text and never for words of two; n + 1 offsets of the texts."""
    ids, ends, known = [], [0], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        ids += [seen.setdefault(w, known + len(seen)) for w in words]
        known += len(seen)
        ends.append(len(ids))
    return np.array(ids, np.int64), np.array(ends, np.int64)


def suffixes(ids: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, of those only that share ``least`` words or more with a neighbour there, and
    the number of words that each shares with the one before it, or 0.

    Ranks by the first 1, 2, 4 ... words; a suffix whose rank is its own is done with. Texts hold no common number, so
    all texts of a batch are sorted at once. Shared words are counted in the order of the text, each from its
    forerunner's less one.
    """
    n = len(ids)
    stop = np.repeat(ends[1:], np.diff(ends))

    def ranked(which: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``which`` in the order of (first, second), the start of each entry's group there, and the group sizes."""
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(order)))
        return which[order], np.repeat(begins, sizes), np.repeat(sizes, sizes)

    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    everything = np.arange(n)
    which, group, sizes = ranked(everything, ids, np.zeros(n, np.int64))
    rank = np.empty(n, np.int64)
    rank[which] = group
    active, width = which[sizes > 1], 1
    kept, common = (active.copy(), width) if width * 2 > least else (None, width)
    while len(active):
        after = active + width
        second = np.where(after < stop[active], rank[np.minimum(after, n - 1)], -1)
        first = rank[active]
        which, group, sizes = ranked(active, first, second)
        base = rank[which]
        starts = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
        offset = group - np.repeat(group[starts], np.diff(np.append(starts, len(base))))
        rank[which] = base + offset
        active, width = which[sizes > 1], width * 2
        if width * 2 > least and kept is None:
            kept, common = active.copy(), width  # all that share so many words with another; ``least`` is under twice as many
    if kept is None or not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = kept[np.argsort(rank[kept], kind="stable")]
    return order, _shared(ids, stop, order, common)


def _shared(ids: np.ndarray, stop: np.ndarray, order: np.ndarray, common: int) -> np.ndarray:
    """How many words each suffix of ``order`` shares with the one before it. All that share ``common`` with another are there,
    so a suffix shares with its neighbour at least what its forerunner does less one, if that is no less than ``common``."""
    before = dict(zip(order[1:].tolist(), order[:-1].tolist(), strict=True))
    words, limit, out, last, size = ids.tolist(), stop.tolist(), {}, -2, 0
    for i in sorted(before):
        j = before[i]
        size = size - 1 if i == last + 1 and size > common else 0
        most = min(limit[i] - i, limit[j] - j)
        while size < most and words[i + size] == words[j + size]:
            size += 1
        out[i], last = size, i
    return np.array([out.get(i, 0) for i in order.tolist()], np.int64)


def runs(ids: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, starts counted over the whole batch.

    Kruskal by falling LCP: two classes that share ``size`` words are united, the smaller into the larger one's ordered
    positions. Positions x < y that become neighbours share exactly ``size`` words. If (times - 1) * (y - x) <= size, the
    words from x to y + size have the period y - x, and no smaller one, since that would have put a position between. They
    start a run where the words before x and y differ; with equal ones before, x - 1 and y - 1 have told it already.
    """
    # a run shares its length less its period with itself, one period on: least - 1 words for a period of 1, else more
    shortest = max(1, min(max(least - q, (times - 1) * q) for q in range(1, least + 1)))
    order, shared = suffixes(ids, ends, shortest)
    edges = np.flatnonzero(shared >= shortest)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    first = set(ends.tolist())
    words, found = ids.tolist(), []
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for a, b, size in zip(order[edges - 1].tolist(), order[edges].tolist(), shared[edges].tolist(), strict=True):
        a, b = find(a), find(b)
        large, small = members.setdefault(a, [a]), members.setdefault(b, [b])
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        root[b] = a
        del members[b]
        if len(small) * 8 > len(large):
            inside = set(small)
            large += small
            large.sort()
            near = [(x, y) for x, y in zip(large, large[1:], strict=False) if (x in inside) != (y in inside)]
        else:
            for x in small:
                insort(large, x)
            near = []
            for x in small:  # only when all are in are neighbours neighbours
                at = bisect_left(large, x)
                near += [(large[at - 1], x)] * (at > 0) + [(x, y) for y in large[at + 1 : at + 2]]
        for x, y in near:
            gap = y - x
            if gap * (times - 1) <= size and gap + size >= least and (x in first or words[x - 1] != words[y - 1]):
                found.append((x, gap + size, gap))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def _kept(n: int, mine: list[tuple[int, int, int]]) -> list[int]:
    """Places of the words that no run holds after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in mine:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.flatnonzero(np.cumsum(gone[:n]) == 0).tolist()


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed (the text without repeats).

    Words are stretches without white space (0x20, 0x09-0x0D), numbered from 0, compared byte by byte. A run is a stretch
    with smallest period q, at least ``least`` words and ``times`` periods long, that no neighbouring word extends; runs may
    overlap. collapsed holds the words, joined by one space, that no run holds after its first q words. A null text
    counts as empty: no words, no runs, an empty text. Each row stands for itself, repeated or not; a null doc_id stays null.
    Other columns are ignored. An empty table gives no rows. A text is one task's, of n log n steps and memory of about 200
    bytes a word; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            ids, ends = numbered(texts)
            found = runs(ids, ends, least, times)
            of = np.searchsorted(ends[1:], [r[0] for r in found], side="right").tolist()
            mine: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for i, (start, length, period) in zip(of, found, strict=True):
                mine[i].append((start - int(ends[i]), length, period))
            collapsed = [b" ".join([w[k] for k in _kept(len(w), r)] if r else w).decode() for w, r in zip(texts, mine, strict=True)]
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in one] for one in mine]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.array(rows, _RUNS), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
