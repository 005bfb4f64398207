"""MinHash near-dedup (operator 8): HyperMinHash registers, banded; exact links on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .families import compare, families, near_links
from .hyperminhash import bands, registers
from .scratch import cut, drop
from .words import Words, chunks, mix

_SKETCH = "doc_id long, text_key long, n long, cls long, regs binary, bands array<long>"


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for each set: equal sets have equal keys."""
    out = np.zeros(len(sets), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            out[i] = mix(s).sum(dtype=np.uint64) ^ (np.bitwise_xor.reduce(s) * np.uint64(0x9E3779B97F4A7C15)) if len(s) else 0
        return mix(out + np.array([len(s) for s in sets], np.uint64)).astype(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n (set size), cls (key of the set), regs, bands (none for an empty set); one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sets = Words(part.column("text")).sets(k)
            regs = registers(sets)
            keys = bands(regs)
            n = np.array([len(s) for s in sets], np.int64)
            some = n > 0
            at = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)
            raw = [r.tobytes() for r in regs]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(n), pa.array(set_keys(sets)), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(at, keys[some].ravel())],
                names=["doc_id", "text_key", "n", "cls", "regs", "bands"],
            )

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, _SKETCH)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """cls, shingles (all of them) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sets = Words(part.column("text")).sets(k)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets)), pa.ListArray.from_arrays(at, flat)], names=["cls", "shingles"])

    return docs.select("text").mapInArrow(run, "cls long, shingles array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, errors: float = 6.0) -> DataFrame:
    """Documents whose sets of k-word shingles have Jaccard similarity of num/den or more are linked.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept;
    then text_key (xxhash64 of the text) and group_key (one for each component, null for an empty set).
    Equal sets are one class before anything is compared, so thousands of copies cost one member. Candidates
    share a band of registers. Pairs of a band whose registers agree often enough (within ``errors`` standard errors of
    num/den) hold families together; inside one the collision-corrected estimate and then the full sets decide each
    pair, block by block.

    Null or blank texts have an empty set, n_shingles 0, and link with nothing; a null doc_id is ignored when
    the smallest id is taken, and is its own (null) component if nothing else is reached. A repeated row is
    linked with itself. Other columns are ignored, whatever their names.
    """
    sk = cut(sketches(docs, k), "sketches")
    # one row stands for its class: one with a doc_id if there is one
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n", "regs", "bands")
    classes = sk.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(row).alias("r"))
    classes = cut(classes.select("cls", "least", "r.text_key", "r.n", "r.regs", "r.bands"), "classes")
    named = classes.withColumnRenamed("cls", "node")
    fam = families(named.select("node", F.explode("bands").alias("bucket")), named.select("node", "n", "regs"), num, den, errors)
    # that row gives the full set; beside the text's key its doc_id (null if no row of the class has one) leaves other copies out
    wanted = cut(classes.join(fam.withColumnRenamed("node", "cls"), "cls").select("cls", "least", "text_key", "n", "regs", F.col("comp").alias("fam")), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ones = wanted.select("least", F.col("text_key").alias("_key")).hint("merge")
    texts = texts.join(ones, F.col("doc_id").eqNullSafe(F.col("least")) & (F.xxhash64("text") == F.col("_key")), "left_semi")
    sets = full_sets(texts, k).dropDuplicates(["cls"])
    members = wanted.join(sets, "cls").select("fam", F.col("cls").alias("node"), "n", "regs", "shingles")
    sizes = cut(wanted.groupBy("fam").agg(F.count("*").alias("size")), "sizes")
    links = cut(compare(members, sizes, near_links(num, den, errors)), "links")
    reached = components(links).select(F.col("node").alias("cls"), "comp")
    named = classes.select("cls", "least").join(reached, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = cut(named.join(least, "comp").select("cls", "component_id", F.col("comp").alias("group_key")), "named")
    drop(classes, wanted, sizes, links)
    out = sk.select("doc_id", "text_key", "n", "cls").join(named, "cls", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "text_key", F.when(F.col("n") > 0, F.col("group_key")).alias("group_key"))
