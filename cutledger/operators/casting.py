"""Casting with motifs: slots filled in order, where a motif's later slots take what its first one took."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join
from .search import candidate_rank, evidence_matches

#: What using a segment, or a source, once more costs, in tenths.
AGAIN, SAME_SOURCE = 30, 10

_OUT = {"plan_id": pa.int64(), "pos": pa.int64(), "shot": pa.int32(), "segment_id": pa.int64(), "score": pa.int64(), "status": pa.string()}


def _cast_one(slots: list[tuple], tokens: Callable[[int, str], set]) -> list[tuple]:
    """The shots of one plan: pos, shot, segment_id, score, status.

    A slot: pos, motif, occurrence, shots_min, shots_max, continuity, preselected, candidates by rank; a candidate: rank,
    segment_id, asset_id, score, place; ``tokens`` gives those of a place for a key.
    """
    used: set = set()
    sources: set = set()
    registry: dict = {}
    out: list[tuple] = []
    for pos, motif, occurrence, shots_min, shots_max, continuity, preselected, pool in slots:
        low = max(1, shots_min or 1)
        high = max(low, shots_max or low)
        again = motif is not None and occurrence > 1 and motif in registry
        if again:
            pool, high, low = [registry[motif]], 1, 1
        elif preselected is not None:
            pool, high, low = [c for c in pool if c[1] == preselected], 1, 1
        if not pool:
            out.append((pos, None, None, None, "uncast"))
            continue
        first, n = None, 0
        while pool and n < high:
            if motif is not None:
                # a motif's slots take the first by rank, others the best after what is spent
                best, value = pool[0], pool[0][3]
            else:
                best, value = None, 0
                for c in pool:
                    v = c[3] - AGAIN * (c[1] in used) - SAME_SOURCE * (c[2] in sources)
                    if best is None or v > value:
                        best, value = c, v
            segment = best[1]
            out.append((pos, n, segment, value, "motif again" if again else "used again" if motif is None and segment in used else "cast"))
            used.add(segment)
            sources.add(best[2])
            if motif is not None and occurrence == 1:
                registry.setdefault(motif, best)
            first = first or best
            n += 1
            if n < high:
                # what was taken before is gone from the pool, and what is left goes with the first shot unless this is it
                pool = [c for c in pool if c[1] != segment and (n > 1 or all(tokens(first[4], k) & tokens(c[4], k) for k in continuity))]
        if n < low:
            out.append((pos, None, None, None, "too few shots"))
    return out


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _bounds(lists: pa.Array) -> list[int]:
    """Where each list begins in the flattened lists, and the end; a null counts as an empty one."""
    return [0, *np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()]


def _tokens_of(maps: pa.MapArray) -> Callable[[int, str], set]:
    """(place, key) -> the tokens there."""
    entry, at = maps.offsets.to_pylist(), maps.items.offsets.to_pylist()
    keys, words = maps.keys.to_pylist(), maps.items.values.to_pylist()
    return lambda place, key: {w for i in range(entry[place], entry[place + 1]) if keys[i] == key for w in words[at[i] : at[i + 1]]}


def _cast_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans, slots, pools = batch.column("plan_id").to_pylist(), batch.column("slots"), batch.column("pool")
        slot_at, pool_at = _bounds(slots), _bounds(pools)
        slots, pools = slots.flatten(), pools.flatten()
        slot = list(zip(*[_values(slots.field(c)) for c in ("pos", "motif", "occurrence", "shots_min", "shots_max", "continuity", "preselected")], strict=True))
        places = _values(pools.field("pos"))
        candidates = list(zip(*[_values(pools.field(c)) for c in ("rank", "segment_id", "asset_id", "score")], range(len(places)), strict=True))
        tokens = functools.cache(_tokens_of(pools.field("tokens")))
        out: list[tuple] = []
        for n, plan in enumerate(plans):
            by_pos: dict = {}
            for i in range(pool_at[n], pool_at[n + 1]):
                by_pos.setdefault(places[i], []).append(candidates[i])
            for found in by_pos.values():
                found.sort(key=operator.itemgetter(0))
            mine = sorted(slot[slot_at[n] : slot_at[n + 1]], key=operator.itemgetter(0))
            out += [(plan, *r) for r in _cast_one([(*s, by_pos.get(s[0], ())) for s in mine], tokens)]
        columns = list(zip(*out, strict=True)) or [()] * len(_OUT)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.values(), strict=True)], names=list(_OUT))


def cast_plans(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """plan_id, pos, shot (from 0), segment_id, score, status: what each slot of each plan is filled with, in order.

    ``slots``: plan_id, pos, motif, occurrence, shots_min, shots_max, continuity (array of keys), preselected (a segment, or
    null). ``candidates``: plan_id, pos, rank, segment_id, asset_id, score (tenths), tokens (map of key -> array).

    A slot takes shots_min to shots_max shots, each the best candidate after AGAIN for a segment and SAME_SOURCE for a source
    that the plan has used (ties by rank). The shots after the first share a token with it for every continuity key. A
    motif's first occurrence fixes its segment; later ones take that, one shot, whatever else there is, and its slots
    pay nothing. status: cast, used again (the corpus is smaller than the plan), motif again (a sanctioned reuse); rows
    without a segment say uncast or too few shots. Greedy order can't be split within a plan, which has tens of slots and
    some candidates each: a plan is a row, dealt by its id alone, and many rows are a batch.
    """
    none = F.array().cast("array<string>")
    slot = F.struct(
        F.col("pos").cast("long").alias("pos"), "motif", F.coalesce("occurrence", F.lit(1)).cast("long").alias("occurrence"), F.col("shots_min").cast("long").alias("shots_min"), F.col("shots_max").cast("long").alias("shots_max"),
        F.coalesce("continuity", none).alias("continuity"), F.col("preselected").cast("long").alias("preselected"),
    )
    one = F.struct(F.col("pos").cast("long").alias("pos"), F.col("rank").cast("long").alias("rank"), F.col("segment_id").cast("long").alias("segment_id"), F.col("asset_id").cast("long").alias("asset_id"), F.col("score").cast("long").alias("score"), "tokens")
    plans = slots.where("plan_id is not null").groupBy("plan_id").agg(F.collect_list(slot).alias("slots"))
    rows = plans.join(candidates.groupBy("plan_id").agg(F.collect_list(one).alias("pool")), "plan_id", "left")
    return rows.select(F.col("plan_id").cast("long").alias("plan_id"), "slots", "pool").mapInArrow(_cast_batches, "plan_id long, pos long, shot int, segment_id long, score long, status string")


def gather_candidates(pool: DataFrame, facet_hits: DataFrame, similar: DataFrame, slots: DataFrame, k: int = 8, bucket: int = 10_000) -> DataFrame:
    """slot_id, segment_id, pos, via, value: each slot's k best candidates from three channels.

    ``pool``: what evidence search gives for a slot (slot_id, segment_id, asset_id, s, e, score, tokens of its evidence, energy).
    ``facet_hits`` (slot_id, asset_id, s, e, facet) and ``similar`` (slot_id, segment_id) tag members of the pool that they
    overlap, or name, and raise them; they add none. ``slots``: slot_id, need and withhold (arrays of terms), intensity: a
    candidate without a needed term, or with a withheld one, isn't there. via: context_search, facet:<kind>, similar. Ties
    go to the smaller segment_id. Hits meet the pool by slot, source and time bucket.
    """
    own = lambda df: df.withColumn("asset_id", F.struct("slot_id", "asset_id"))
    met = overlap_join(own(pool.select("slot_id", "asset_id", "segment_id", "s", "e")), own(facet_hits).select("asset_id", "s", "e", "facet"), bucket)
    tags = met.groupBy("slot_id", "segment_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("facet:"), "facet"))).alias("_facets"))
    rows = pool.join(tags, ["slot_id", "segment_id"], "left").join(similar.select("slot_id", "segment_id").distinct().withColumn("_similar", F.lit(True)), ["slot_id", "segment_id"], "left").join(slots, "slot_id")
    none = F.array().cast("array<string>")
    facets, like = F.coalesce("_facets", none), F.coalesce("_similar", F.lit(False))
    fit = evidence_matches(F.col("tokens"), F.coalesce("need", none)) & ~F.arrays_overlap("tokens", F.coalesce("withhold", none))
    rows = rows.where(fit).withColumn("via", F.concat(F.array(F.lit("context_search")), facets, F.when(like, F.array(F.lit("similar"))).otherwise(none)))
    rows = rows.withColumn("value", candidate_rank(F.col("score"), F.size(facets), like, F.col("energy"), F.col("intensity")).cast("double"))
    order = Window.partitionBy("slot_id").orderBy(F.col("value").desc(), "segment_id")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("slot_id", "segment_id", "pos", "via", "value")
