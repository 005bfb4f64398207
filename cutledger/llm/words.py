"""Words, shingles and their 64-bit hashes, for whole Arrow batches of texts at once.

A word is a run of bytes other than white space (0x20, 0x09-0x0D); A-Z are lower-cased.
Everything here works on the UTF-8 bytes, so no character is cut: separators are ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and digits and every byte of a longer character.
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_BYTE = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MUL = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _MUL)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (strings, or bytes without nulls), and n + 1 offsets; a null is an empty text."""
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text, so that work arrays stay small; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


class Words:
    """The words of a batch: ``hash``, ``start`` and ``end`` (bytes in the batch), and ``first`` (n + 1 indexes: text i has words first[i] to first[i + 1])."""

    def __init__(self, texts: pa.Array, alnum: bool = False) -> None:
        data, offsets = text_bytes(texts)
        inside = _ALNUM[data] if alnum else ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(begins)
        within = np.flatnonzero(inside)
        lens = np.diff(np.append(np.searchsorted(within, self.start), len(within)))
        self.end = self.start + lens
        self.first = np.searchsorted(self.start, offsets)
        if len(self.start):
            at = np.cumsum(lens) - lens
            place = np.arange(len(within)) - np.repeat(at, lens)
            with np.errstate(over="ignore"):
                part = _BYTE[LOWER[data[within]]] * powers(int(lens.max()))[place]
                self.hash = mix(np.add.reduceat(part, at) + lens.astype(np.uint64) * _MUL)
        else:
            self.hash = np.zeros(0, np.uint64)

    def prefixes(self, size: int) -> np.ndarray:
        """A hash of the first ``size`` bytes of each word; 0 for words of no more than ``size`` bytes."""
        out = np.zeros(len(self.hash), np.uint64)
        some = np.flatnonzero(self.end - self.start > size)
        p = powers(size)
        with np.errstate(over="ignore"):
            total = np.full(len(some), np.uint64(size) * np.uint64(0xA24BAED4963EE407))
            for j in range(size):
                total += _BYTE[LOWER[self.data[self.start[some] + j]]] * p[j]
        out[some] = mix(total)
        return out

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash at each word for the k words from it, and whether those are all of one text."""
        n = len(self.hash)
        whole = np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        if n >= k:
            m = n - k + 1
            total = np.zeros(m, np.uint64)
            with np.errstate(over="ignore"):
                for j, p in enumerate(powers(k + 1)[1:]):
                    total += self.hash[j : j + m] * p
                out[:m] = mix(total + _U(k))
            owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
            whole[:m] = owner[:m] == owner[k - 1 :]
        return out, whole

    def sets(self, k: int) -> list[np.ndarray]:
        """For each text its sorted distinct shingle hashes; a text of under k words has its whole sequence as one."""
        out, whole = self.shingles(k)
        sets = []
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            if b - a >= k:
                sets.append(np.unique(out[a : b - k + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    total = (self.hash[a:b] * powers(int(b - a) + 1)[1:]).sum(dtype=np.uint64) + _U(b - a)
                sets.append(mix(np.array([total], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
        return sets
