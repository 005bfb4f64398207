"""Edit programs: each plan's own operations, applied in order, with what they name looked up at that moment.

A plan's items and operations are arrays, and a program is a fold over its operations that carries the items: one
shuffle for all plans, however many operations each has. A plan is a row, many rows are a batch. Plans have tens of items.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import UNIT_HEAD, UNIT_TAIL

_UNITS = "array<struct<s:bigint,e:bigint>>"
_ITEM = {"slot_id": "string", "beat_id": "string", "role": "string", "segment_id": "bigint", "asset_id": "bigint", "start": "bigint", "cap": "bigint", "fit": "bigint", "units": _UNITS, "changed": "boolean"}
_FOUND = {"segment_id": "bigint", "asset_id": "bigint", "s": "bigint", "e": "bigint", "units": _UNITS}
_OP = {"i": "bigint", "op": "string", "on": "string", "by": "string", "factor_milli": "bigint", "target_ms": "bigint"}
_ENTRY = {"i": "bigint", "op": "string", "outcome": "string", "at": "bigint", "segment_id": "bigint"}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), _UNITS: pa.list_(pa.struct({"s": pa.int64(), "e": pa.int64()}))}


def _ddl(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"


def _held(table: DataFrame, fields: dict[str, str]) -> Column:
    """The columns as a struct; those that the table lacks are null."""
    return F.struct(*[(F.col(c) if c in table.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()]).cast(_ddl(fields))


def place_of(items: Column, ref: Column) -> Column:
    """Where the item named by ``ref`` is (from 0), or null: a number (from the end if negative), else the first with that slot, beat or segment id."""
    n, number = F.size(items), ref.try_cast("bigint")
    by_number = F.when(number < 0, n + number).otherwise(number)
    same = lambda c: F.coalesce(c.cast("string") == ref, F.lit(False))
    named = F.transform(items, lambda x: same(x["slot_id"]) | same(x["beat_id"]) | same(x["segment_id"]))
    at = F.array_position(named, F.lit(True))
    return F.when(number.isNotNull(), F.when((by_number >= 0) & (by_number < n), by_number)).otherwise(F.when(at > 0, at - 1)).cast("bigint")


def in_region(items: Column, target: Column, item: Column, i: Column) -> Column:
    """Whether the item at place i is in the region: all, opening, middle, ending (a third each, one at least; a middle that is empty is the item half way), [first, last], or a slot's or beat's name."""
    n = F.size(items)
    third = F.greatest(F.lit(1), F.floor(n / 3))
    ends = F.from_json(target, "array<int>")
    middle = F.when(n - third > third, (i >= third) & (i < n - third)).otherwise(i == F.floor(n / 2))
    known = F.when(F.startswith(target, F.lit("[")), (i >= ends[0]) & (i <= ends[1])).when(target == "all", True).when(target == "opening", i < third).when(target == "ending", i >= n - third).when(target == "middle", middle)
    return F.coalesce(known, F.coalesce(item["slot_id"] == target, F.lit(False)) | F.coalesce(item["beat_id"] == target, F.lit(False)))


class Item(NamedTuple):
    """An item of a plan, as ``_ITEM`` has it."""

    slot_id: str | None
    beat_id: str | None
    role: str | None
    segment_id: int | None
    asset_id: int | None
    start: int | None
    cap: int | None
    fit: int | None
    units: list[dict] | None
    changed: bool = False


class Found(NamedTuple):
    """A segment that a search gives, as ``_FOUND`` has it."""

    segment_id: int | None
    asset_id: int | None
    s: int | None
    e: int | None
    units: list[dict] | None


class Op(NamedTuple):
    """An operation, as ``_OP`` has it."""

    i: int
    op: str | None
    on: str | None
    by: str | None
    factor_milli: int | None
    target_ms: int | None
    number: int | None
    first: int | None
    last: int | None


def _least(*values: int | None) -> int | None:
    return min((v for v in values if v is not None), default=None)


def _div(a: int, b: int) -> int:
    return a // b if a >= 0 else -(-a // b)


def _place(items: list[Item], op: Op) -> int | None:
    """As ``place_of``."""
    n, ref = len(items), op.on
    if op.number is not None:
        at = op.number + n if op.number < 0 else op.number
        return at if 0 <= at < n else None
    return next((at for at, x in enumerate(items) if ref is not None and (ref in (x.slot_id, x.beat_id) or ref == str(x.segment_id) and x.segment_id is not None)), None)


def _region(items: list[Item], op: Op) -> list[bool]:
    """As ``in_region``, for each item."""
    n, target = len(items), op.on
    third, named = max(1, n // 3), [target is not None and target in (x.slot_id, x.beat_id) for x in items]
    if target is not None and target.startswith("["):
        if op.first is None or op.last is None:
            return [x and (op.first is None or i >= op.first) and (op.last is None or i <= op.last) for i, x in enumerate(named)]
        return [op.first <= i <= op.last for i in range(n)]
    middle = (third, n - third) if n - third > third else (n // 2, n // 2 + 1)
    ends = {"all": (0, n), "opening": (0, third), "ending": (n - third, n), "middle": middle}.get(target)
    return [ends[0] <= i < ends[1] for i in range(n)] if ends else named


def _guarded(start: int, end: int, cap: int | None, units: list[dict]) -> int:
    """As ``respect_word_units``."""
    for u in units:
        if u is not None and u["s"] is not None and u["e"] is not None and u["s"] < end < u["e"]:
            end = u["e"] + UNIT_TAIL if cap is not None and u["e"] + UNIT_TAIL <= start + cap else max(start + 500, u["s"] - UNIT_HEAD)
    return end


def _retimed(x: Item, op: Op, now: int | None) -> Item:
    if op.factor_milli is not None:
        scaled = None if x.fit is None else _div(x.fit * op.factor_milli, 1000)
    elif now is not None and now > 0:
        scaled = None if x.fit is None or op.target_ms is None else _div(x.fit * op.target_ms, now)
    else:
        scaled = x.fit
    fit = _least(x.cap, max(500, scaled or 0))
    if x.units is not None and x.start is not None:
        fit = _guarded(x.start, x.start + fit, x.cap, x.units) - x.start
    return x._replace(fit=fit, changed=True)


def _recast(old: Item, found: Found) -> Item:
    """The item with another segment: slot, role and time budget stay; the clip fits what the segment has (operator sequence_item)."""
    length = None if found.s is None or found.e is None else found.e - found.s
    raw = max(100, length or 0)
    goal = max(1000, old.fit or raw)
    fit = min(raw, max(2000, goal), max(2000, old.fit or 0))
    return Item(old.slot_id, old.beat_id, old.role, found.segment_id, found.asset_id, found.s, _least(old.cap or goal * 150 // 100, length), fit, found.units, True)


def _apply(items: list[Item], op: Op, found: list[Found]) -> tuple[list[Item], tuple]:
    """The items after one operation, and its log entry. One that finds nothing leaves the items and says so in the log."""
    kind = op.op
    if kind == "retime":
        hits = _region(items, op)
        fits = [x.fit for x, hit in zip(items, hits, strict=True) if hit]
        now = None if None in fits else sum(fits)
        return [_retimed(x, op, now) if hit else x for x, hit in zip(items, hits, strict=True)], (op.i, kind, "retimed" if fits else "no items", None, None)
    at = len(items) - 1 if kind == "swap_ending" and items else _place(items, op) if kind not in (None, "swap_ending") else None
    if at is None:
        return items, (op.i, kind, "no item", None, None)
    old = items[at]
    if kind == "drop_item":
        return items[:at] + items[at + 1 :], (op.i, kind, "dropped", at, old.segment_id)
    used = {x.segment_id for x in items}
    pinned = kind == "replace_item" and op.by not in (None, "recast")
    others = [c for c in found if None not in (c.segment_id, old.segment_id) and c.segment_id != old.segment_id]
    fresh = lambda some: [c for c in some if None not in used and c.segment_id is not None and c.segment_id not in used]
    if pinned:
        picks = found
    elif kind == "replace_item":
        picks = fresh(others) or others
    else:
        picks = others if kind == "swap_ending" else fresh(found) if kind == "insert_beat" else []
    if not picks:
        return items, (op.i, kind, "no such segment" if pinned else "no candidate", at, None)
    new = _recast(old, picks[0])
    if kind == "insert_beat":
        name = f"inserted_{op.i}"
        return [*items[: at + 1], new._replace(slot_id=name, beat_id=name, role="inserted"), *items[at + 1 :]], (op.i, kind, "inserted", at, new.segment_id)
    return [*items[:at], new, *items[at + 1 :]], (op.i, kind, "replaced" if kind == "replace_item" else "swapped", at, new.segment_id)


def _values(column: pa.Array) -> list:
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_nested(column.type):
        return column.to_pylist()
    if pa.types.is_string(column.type) or not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    known = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [v if k else None for v, k in zip(column.fill_null(0).to_numpy(zero_copy_only=False).tolist(), known, strict=True)]


def _rows(lists: pa.Array) -> tuple[list[int], pa.StructArray]:
    """Where each list begins in the flattened lists, and the end (a null counts as an empty one); the flattened lists."""
    return [0, *np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()], lists.flatten()


def _fields(rows: pa.StructArray, names: Iterable[str]) -> Iterable[tuple]:
    return zip(*[_values(pc.struct_field(rows, n)) for n in names], strict=True)


def _listed(lists: list[list[tuple]], fields: dict[str, str]) -> pa.ListArray:
    columns = list(zip(*[r for rows in lists for r in rows], strict=True)) or [()] * len(fields)
    rows = pa.StructArray.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), rows)


def _edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item_at, items = _rows(batch.column("items"))
        op_at, ops = _rows(batch.column("ops"))
        found_at, found = _rows(batch.column("found"))
        places = _values(pc.struct_field(items, "pos"))
        ranked = [(i, rank, segment is not None, segment or 0) for i, rank, segment in _fields(found, ("i", "rank", "segment_id"))]
        item = list(map(Item._make, ((*r, False) for r in _fields(items, Item._fields[:-1]))))
        op, candidate = list(map(Op._make, _fields(ops, Op._fields))), list(map(Found._make, _fields(found, Found._fields)))
        edited, logs = [], []
        for n in range(batch.num_rows):
            now = [item[k] for k in sorted(range(item_at[n], item_at[n + 1]), key=places.__getitem__)]
            log, of_op = [], {}
            for k in sorted(range(found_at[n], found_at[n + 1]), key=ranked.__getitem__):
                of_op.setdefault(ranked[k][0], []).append(candidate[k])
            for k in sorted(range(op_at[n], op_at[n + 1]), key=lambda k: op[k].i):
                now, entry = _apply(now, op[k], of_op.get(op[k].i, []))
                log.append(entry)
            edited.append(now)
            logs.append(log)
        yield pa.RecordBatch.from_arrays([batch.column("plan_id"), _listed(edited, _ITEM), _listed(logs, _ENTRY)], names=["plan_id", "items", "log"])


def edit_plans(items: DataFrame, programs: DataFrame, found: DataFrame, most: int = 24) -> DataFrame:
    """plan_id, items, log: each plan after its own program.

    ``items``: plan_id, pos and what is known of slot_id, beat_id, role, segment_id, asset_id, start, cap, fit, units.
    ``programs``: plan_id, i (the order), op, on, by, factor_milli or target_ms, as of ``programs_of``; an entry with a problem
    isn't there. ``found``: plan_id, i, rank, segment_id, asset_id, s, e, units: what a search gives for the i-th operation
    (the best ``most`` count), or the one segment that it names.

    retime scales a region within cap, 500 ms at least, no word unit cut; drop_item, replace_item (by the best candidate
    that the plan doesn't use, else the best other one; a named segment as it is), swap_ending, insert_beat (the best unused
    candidate after an item). Whatever an operation names is looked up among the items as earlier operations left them.
    A plan without a program stays untouched, with an empty log; a log entry says what came of each operation.
    """
    fields = {"pos": "bigint"} | {k: v for k, v in _ITEM.items() if k != "changed"}
    packed = items.groupBy("plan_id").agg(F.collect_list(_held(items, fields)).alias("items"))
    places = {"i": "bigint", "rank": "bigint"}
    best = found.where(F.col("rank") <= most).groupBy("plan_id").agg(F.collect_list(_held(found, places | _FOUND)).alias("found"))
    # what an operation names is read here as a number, and as the first and last place
    ends = F.when((F.col("op") == "retime") & F.startswith("on", F.lit("[")), F.from_json("on", "array<int>"))
    read = {"number": F.when(F.col("op") != "retime", F.col("on").try_cast("bigint")), "first": F.get(ends, F.lit(0)).cast("bigint"), "last": F.get(ends, F.lit(1)).cast("bigint")}
    op = F.struct(*[F.col(c).cast(t).alias(c) for c, t in _OP.items()], *[c.alias(n) for n, c in read.items()])
    ops = programs.groupBy("plan_id").agg(F.collect_list(op).alias("ops"))
    list_of = lambda fields: f"array<{_ddl(fields)}>"
    whole = packed.join(ops, "plan_id", "left").join(best, "plan_id", "left").select("plan_id", "items", "ops", "found")
    return whole.mapInArrow(_edit_batches, f"plan_id {dict(items.dtypes)['plan_id']}, items {list_of(_ITEM)}, log {list_of(_ENTRY)}")


def edited_items(edited: DataFrame) -> DataFrame:
    """plan_id, pos (from 1), at and the columns of each item of ``edit_plans``."""
    at = F.transform("items", lambda x, i: F.aggregate(F.slice("items", F.lit(1), i), F.lit(0).cast("bigint"), lambda t, y: t + y["fit"]))
    return edited.withColumn("_at", at).select("plan_id", F.posexplode(F.arrays_zip("items", "_at")).alias("pos", "x")).select("plan_id", (F.col("pos") + 1).cast("long").alias("pos"), "x.items.*", F.col("x._at").alias("at"))


def programs_of(scripts: DataFrame) -> DataFrame:
    """plan_id, i, op, on, by, factor_milli, target_ms: what can be applied of scripts (reply_id as plan_id) as ``conform_scripts`` gives them.

    ``timed_by`` says whether ``by`` of a retime is a factor or a length in seconds.
    """
    number = F.when(F.col("op") == "retime", F.col("by").try_cast("double"))
    milli = F.round(number * 1000).cast("long")
    factor = F.col("timed_by") == "factor"
    return scripts.where("problem is null").select(F.col("reply_id").alias("plan_id"), "i", "op", "on", "by", F.when(factor, milli).alias("factor_milli"), F.when(~factor, milli).alias("target_ms"))
