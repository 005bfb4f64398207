"""A membership filter of fixed size, built by an aggregate, that may go to every task whatever the data's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

#: 2 MiB. A full filter lets everything through: slower, never wrong.
BITS = 1 << 24


def _spots(seeds: np.ndarray) -> list[np.ndarray]:
    """The three places of a hash: its bits 0-23, 20-43 and 40-63."""
    return [(seeds >> np.uint64(20 * i)) & np.uint64(BITS - 1) for i in range(3)]


def seed_filter(keys: DataFrame, mixed: bool = False) -> np.ndarray:
    """The filter of ``keys`` (seed: long), which are mixed first unless they are ``mixed`` hashes already.

    The aggregate sends a row for each of BITS / 64 words at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seeds = b.column("seed").drop_null().to_numpy().astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(seeds).astype(np.int64))], names=["seed"])

    hashes = keys.select("seed") if mixed else keys.select("seed").mapInArrow(run, "seed long")
    places = F.explode(F.array(*[F.shiftrightunsigned("seed", 20 * i).bitwiseAND(BITS - 1) for i in range(3)]))
    words = hashes.select(places.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def in_filter(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each mixed hash whether it may be among the keys."""
    hit = np.ones(len(hashes), bool)
    for i in range(3):
        spot = _spots(hashes[hit])[i]
        hit[hit] = (table[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return hit
