"""Token counts (operator 9): a segment tree of pre-tokens for each document; an edit re-encodes only what it touches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import chunks

#: Format: the pattern that cuts text into pre-tokens for byte-level BPE of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a leaf holds when the tree is built, and words whose counts a task remembers.
LEAF, REMEMBERED = 64, 1 << 19
MOST_BYTES = 64 << 20


class Counter:
    """Tokens of a pre-token, by BPE ranks; each distinct pre-token is encoded once while it is remembered."""

    def __init__(self, ranks: bytes) -> None:
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.bpe.encode_ordinary(piece))
        return n

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)


@lru_cache(maxsize=2)
def _counter(ranks: bytes) -> Counter:
    """One for all tasks of a Python worker."""
    return Counter(ranks)


class Tree:
    """Leaves of pre-tokens; above them sums of characters and of tokens.

    ``edit`` finds the leaves by descent, re-cuts from the first pre-token that the edit can change until a
    boundary of old pre-tokens comes again, encodes only those, and adds the difference up to the root.
    """

    def __init__(self, text: str, counter: Counter, leaves: tuple[list[list[int]], list[list[int]]] | None = None) -> None:
        """With ``leaves``, the sizes and token counts kept from before, nothing of the text is cut or encoded."""
        self.text, self.counter, self.encoded = text, counter, 0
        if leaves is None:
            pieces = counter.pieces(text)
            leaves = ([len(p) for p in pieces], [counter.count(p) for p in pieces])
            leaves = tuple([x[i : i + LEAF] for i in range(0, len(x), LEAF)] for x in leaves)
        self.sizes, self.counts = (x or [[]] for x in leaves)
        self.width = 1 << (len(self.sizes) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (s, c) in enumerate(zip(self.sizes, self.counts, strict=True)):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(s), sum(c)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def _set(self, leaf: int) -> None:
        i = self.width + leaf
        dc, dt = sum(self.sizes[leaf]) - self.chars[i], sum(self.counts[leaf]) - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i >>= 1

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character before ``place`` (the first leaf for 0), and where that leaf starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place > start + self.chars[i] and start + self.chars[i] < start + self.chars[i] + self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` in the place of the characters start to end (clamped to the text). Returns the change in tokens."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        before = self.total()
        # a pre-token depends on two characters after it at most: the first that ends less than two before the edit
        leaf, at = self._find(max(start - 1, 0))
        k = 0
        while k < len(self.sizes[leaf]) and at + self.sizes[leaf][k] < start - 1:
            at += self.sizes[leaf][k]
            k += 1
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # old boundaries from the edit's end on, walked along with the new pre-tokens
        old_leaf, old_k, old_at = leaf, k, at
        fresh: list[tuple[int, int]] = []
        place = at
        joined = False
        while place < len(text):
            while old_at + shift < place or old_at < end:
                if old_leaf >= len(self.sizes):
                    break
                if old_k >= len(self.sizes[old_leaf]):
                    old_leaf, old_k = old_leaf + 1, 0
                    continue
                old_at += self.sizes[old_leaf][old_k]
                old_k += 1
            if old_at >= end and old_at + shift == place and place >= start + len(new) and (fresh or start == end and not new):
                joined = True
                break
            piece = self.counter.cut.match(text, place).group()
            fresh.append((len(piece), self.counter.count(piece)))
            self.encoded += 1
            place += len(piece)
        if not joined:
            old_leaf, old_k = len(self.sizes), 0
        sizes, counts = [s for s, _ in fresh], [c for _, c in fresh]
        if old_leaf == leaf:
            self.sizes[leaf][k:old_k] = sizes
            self.counts[leaf][k:old_k] = counts
        else:
            self.sizes[leaf][k:] = sizes
            self.counts[leaf][k:] = counts
            for mid in range(leaf + 1, min(old_leaf, len(self.sizes))):
                self.sizes[mid], self.counts[mid] = [], []
                self._set(mid)
            if old_leaf < len(self.sizes):
                del self.sizes[old_leaf][:old_k], self.counts[old_leaf][:old_k]
                self._set(old_leaf)
        self._set(leaf)
        self.text = text
        return self.total() - before


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data


_LEAVES = "sizes array<array<int>>, counts array<array<int>>"


def _lists(leaves: list[list[list[int]]]) -> pa.Array:
    return pa.array(leaves, pa.list_(pa.list_(pa.int32())))


def _leaves(column: pa.Array) -> list[list[list[int]]]:
    """The nested lists of a column, by way of all its numbers at once."""

    def cut(values: list, sizes: pa.Array) -> list:
        ends = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy())]).tolist()
        return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    inner = column.flatten()
    return cut(cut(inner.flatten().to_numpy().tolist(), pc.list_value_length(inner)), pc.list_value_length(column))


def trees(docs: DataFrame, ranks_path: str) -> DataFrame:
    """All columns of ``docs`` but those named below, then n_tokens, sizes, counts: the segment tree of each text, to be kept.

    sizes and counts hold, leaf by leaf, the characters and the tokens of each pre-token; a null text counts as empty.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(_bytes(ranks_path))
    rest = docs.select(*[c for c in docs.columns if c not in ("n_tokens", "sizes", "counts")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value)
        for part in chunks(batches):
            built = [Tree(t or "", counter) for t in part.column("text").to_pylist()]
            new = [pa.array([t.total() for t in built], pa.int64()), _lists([t.sizes for t in built]), _lists([t.counts for t in built])]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "n_tokens", "sizes", "counts"])

    schema = T.StructType([*rest.schema.fields, T.StructField("n_tokens", T.LongType()), *T.StructType.fromDDL(_LEAVES).fields])
    return rest.mapInArrow(run, schema)


def edited(kept: DataFrame, ranks_path: str, keep: bool = True) -> DataFrame:
    """``kept``: doc_id, text, sizes, counts as of ``trees``, and edits (array of struct start, finish, added, applied in order, each to the text left by the last).

    Returns doc_id, n_pre_tokens, n_tokens (before any edit), n_after (after all), n_encoded (pre-tokens that the edits
    had encoded), the text after them and, with ``keep``, its sizes and counts, to be kept in place of the old ones. Only
    what an edit touches, and what stands beside it, is encoded. Null edits count as none, a null or negative place as
    0, one past the end as the end, null new text as empty. Characters are code points.
    """
    ranks = kept.sparkSession.sparkContext.broadcast(_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value)
        for part in chunks(batches):
            numbers, done = [], []
            texts, edits = (part.column(c).to_pylist() for c in ("text", "edits"))
            for text, sizes, counts, changes in zip(texts, _leaves(part.column("sizes")), _leaves(part.column("counts")), edits, strict=True):
                tree = Tree(text or "", counter, (sizes, counts))
                first, n = tree.total(), sum(map(len, tree.sizes))
                for e in changes or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["finish"] or 0, e["added"] or "")
                numbers.append((n, first, tree.total(), tree.encoded))
                done.append(tree)
            columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)), pa.array([t.text for t in done], pa.string())]
            names = ["doc_id", "n_pre_tokens", "n_tokens", "n_after", "n_encoded", "text"]
            if keep:
                columns += [_lists([t.sizes for t in done]), _lists([t.counts for t in done])]
                names += ["sizes", "counts"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "array<struct<start:int,finish:int,added:string>>"
    rows = kept.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("sizes").cast("array<array<int>>"), F.col("counts").cast("array<array<int>>"), F.col("edits").cast(kind))
    return rows.mapInArrow(run, "doc_id long, n_pre_tokens long, n_tokens long, n_after long, n_encoded long, text string" + f", {_LEAVES}" * keep)


def counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``docs``: doc_id, text, edits. The tree of each text is built, and the edits are made on it.

    Returns doc_id, n_pre_tokens, n_tokens, n_after, n_encoded as ``edited``, and text_sha (sha2 of the edited text).
    Repeated rows give a row each; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "edits")
    out = edited(trees(rows, ranks_path), ranks_path, keep=False)
    return out.withColumn("text_sha", F.sha2("text", 256)).drop("text")
