"""HyperMinHash sketches: one pass of one hash, 128 buckets, each a leading-zero count and ten mantissa bits.

The upper 7 bits of a shingle's hash choose a bucket; of the rest the least value stays, as (leading zeros,
ten bits after the first one) in 16 bits. An empty bucket takes the register of another bucket of the same set,
found by a fixed sequence of tries, so that small sets have 128 comparable registers too. Equal registers of two
sets then are as likely as their Jaccard similarity, besides chance collisions, which ``estimate`` takes off.
"""

from __future__ import annotations

import numpy as np

BUCKETS = 128
MANTISSA = 10
#: 4 registers a band, 32 bands: sets of similarity 0.8 share no band once in 2e7 times.
ROWS = 4
BANDS = BUCKETS // ROWS
_TRIES = np.random.default_rng(7).integers(0, BUCKETS, (BUCKETS, 4 * BUCKETS))
_BAND = np.random.default_rng(11).integers(1, 2**63, BANDS, dtype=np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 128 uint16 registers for each sorted set of 64-bit hashes; zeros for an empty set."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    key = owner * BUCKETS + (values >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))  # sets are sorted: the first of a bucket is its least
    rest = (values[first] & np.uint64((1 << 57) - 1)) >> np.uint64(5)  # 52 bits: exact as a float
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    zeros = 52 - length
    shift = length - 1 - MANTISSA
    kept = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64))
    packed = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (kept & np.uint64((1 << MANTISSA) - 1))
    filled = np.zeros(out.shape, bool)
    out.ravel()[key[first]] = packed.astype(np.uint16)
    filled.ravel()[key[first]] = True
    open_row, open_bucket = np.nonzero(~filled & (sizes > 0)[:, None])
    for t in range(_TRIES.shape[1]):
        if not len(open_row):
            break
        source = _TRIES[open_bucket, t]
        hit = filled[open_row, source]
        out[open_row[hit], open_bucket[hit]] = out[open_row[hit], source[hit]]
        open_row, open_bucket = open_row[~hit], open_bucket[~hit]
    for r, b in zip(open_row, open_bucket, strict=True):  # next filled bucket from a fixed place
        source = (int(_TRIES[b, 0]) + np.arange(BUCKETS)) % BUCKETS
        out[r, b] = out[r, source[np.argmax(filled[r, source])]]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """For each row its 32 band keys (int64); four registers fill one key before it is mixed."""
    from .words import mix

    packed = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)
    with np.errstate(over="ignore"):
        return mix(packed * np.uint64(0xD6E8FEB86659FD93) + _BAND).astype(np.int64)


def chance(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """How likely registers of unrelated sets of these sizes are equal: same leading zeros, same mantissa."""
    k = np.arange(0, 53, dtype=float)

    def share(n: np.ndarray) -> np.ndarray:
        at_least = 1 - (1 - 2.0 ** -k) ** np.maximum(n[..., None] / BUCKETS, 1)
        return at_least - np.concatenate([at_least[..., 1:], np.zeros((*n.shape, 1))], axis=-1)

    return (share(n1) * share(n2)).sum(-1) / 2**MANTISSA


def estimate(equal: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, chance collisions taken off."""
    c = chance(np.asarray(n1, float), np.asarray(n2, float))
    return np.clip((equal / BUCKETS - c) / (1 - c), 0, 1)
