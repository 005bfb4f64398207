"""Prefix scans in two levels: rows of a key in order, where one key may hold most of all rows.

A window over a key is one task a key. Here a key is cut in bands of its order; a window runs within (key, band), what
each band adds up to is a small table, which is scanned per key, and what comes before a band is joined back. Rows are
shuffled once, by key and band, for any number of scans; only the table of bands, a row each, is dealt by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Milliseconds of a band on a timeline.
BAND = 60_000


def time_band(column: str = "s", width: int = BAND) -> Column:
    return F.floor(F.col(column) / width)


def scan(rows: DataFrame, order: list[str], key: str = "asset_id", band: Column | None = None, keep: bool = False, **measures: tuple[str, Column]) -> DataFrame:
    """``rows`` with a column for each of ``measures``: name=(kind, value).

    Kinds: max_before (greatest value of the rows before), sum_to (sum up to and with the row), lag and lead (the value of
    the row before, of the row after). ``order``: the columns that order a key's rows; ``band`` has to rise with it
    (default: time_band of s). ``keep`` writes the rows with what is known within their bands to the shared folder before
    they are read twice, so that scans upon scans don't double the plan each time. Nulls count as the window functions have it. Rows without a neighbour have null.
    """
    rows = rows.withColumn("_band", time_band() if band is None else band)
    by = Window.partitionBy(key, "_band").orderBy(*order)
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    values = {f"_v_{name}": value for name, (_, value) in measures.items()}
    local = {"_first": F.lag(F.lit(1)).over(by).isNull(), "_last": F.lead(F.lit(1)).over(by).isNull()}
    for name, (kind, _) in measures.items():
        v = f"_v_{name}"
        if kind == "max_before":
            local |= {f"_l_{name}": F.max(v).over(before), f"_t_{name}": F.max(v).over(upto)}
        elif kind == "sum_to":
            local |= {f"_l_{name}": F.sum(v).over(upto), f"_t_{name}": F.sum(v).over(upto)}
        elif kind == "lag":
            local |= {f"_l_{name}": F.lag(v).over(by), f"_t_{name}": F.col(v)}
        elif kind == "lead":
            local |= {f"_l_{name}": F.lead(v).over(by), f"_t_{name}": F.first(v).over(upto)}
        else:
            raise ValueError(kind)
    rows = rows.withColumns(values).withColumns(local).drop(*values)
    if keep:  # of what a band adds up to only its last row is read
        rows = written(rows.withColumns({f"_t_{n}": F.when(F.col("_last"), F.col(f"_t_{n}")) for n in measures}), "scan")
    along = Window.partitionBy(key).orderBy("_band")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = {"max_before": lambda c: F.max(c).over(earlier), "sum_to": lambda c: F.sum(c).over(earlier), "lag": lambda c: F.lag(c).over(along), "lead": lambda c: F.lead(c).over(along)}
    bands = rows.where("_last").select(key, "_band", *[f"_t_{n}" for n in measures])
    bands = bands.select(key, "_band", *[carry[kind](f"_t_{n}").alias(f"_c_{n}") for n, (kind, _) in measures.items()])
    out = rows.join(bands, [key, "_band"], "left")
    done = {}
    for name, (kind, _) in measures.items():
        mine, brought = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "max_before":
            done[name] = F.greatest(mine, brought)
        elif kind == "sum_to":
            done[name] = F.when(brought.isNull(), mine).otherwise(F.coalesce(mine, F.lit(0)) + brought)
        else:
            done[name] = F.when(F.col("_first" if kind == "lag" else "_last"), brought).otherwise(mine)
    extra = ["_band", "_first", "_last", *(f"_{p}_{n}" for p in "ltc" for n in measures)]
    return out.withColumns(done).drop(*extra)
