"""Each query of the library against its SQL in DuckDB, and those without SQL against simple rules."""

from __future__ import annotations

import pytest

from cutledger import catalog

from .compare import connect, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    got = QUERIES[name](spark, data).toPandas()
    same(got, con.execute(SQL[name]).df())
    assert len(got)


def test_novelty_against_a_loop(spark, data):
    from pyspark.sql import functions as F

    from cutledger.sources import views as V

    got = {(r.plan_id, r.pos): (r.segment_id, r.score) for r in QUERIES["q15_novelty_assign"](spark, data).collect()}
    items = V.plan_items(spark, data).where(F.col("plan_id") < 40).collect()
    plans: dict = {}
    for i in items:
        for k in range(4):
            plans.setdefault(i.plan_id, {}).setdefault(i.pos, []).append((i.segment_id % 50 + k * 7, (i.asset_id + k) % 9, i.target % 97 + k * 5))
    assert plans
    for plan, slots in plans.items():
        segments, assets = set(), set()
        for pos in sorted(slots):
            score, seg, asset = max(((s - 30 * (g in segments) - 10 * (a in assets)), -g, a) for g, a, s in slots[pos])
            assert got[plan, pos] == (-seg, score)
            segments.add(-seg)
            assets.add(asset)


def test_entry_and_catalog(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_removal_plans_partition_each_asset(spark, data):
    from cutledger.sources import views as V

    length = {r.asset_id: r.duration_ms for r in V.word_assets(spark, data).collect()}
    parts: dict = {}
    for r in QUERIES["q33_subtract_plan"](spark, data).collect():
        parts.setdefault((r.q, r.asset_id), []).append((r.s, r.e, r.kept))
    directives = len({q for q, _ in parts})
    assert directives > 1 and len(parts) == directives * len(length) and any(not k for v in parts.values() for *_, k in v)
    for (_, asset), v in parts.items():
        v.sort()
        assert v[0][0] == 0 and v[-1][1] == length[asset]
        assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(v, v[1:], strict=False))
