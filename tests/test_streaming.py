"""Streams over replayed events give what the batch operators give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cutledger.plans.work_queries import _drain, _stream
from cutledger.sources import views as V
from cutledger.streaming import feeds


def test_open_windows_come_out_when_the_end_is_told(spark, data):
    """With an end row all windows, without one all but the last."""
    rows = _drain(spark, lambda s: feeds.tumbling_activity(s, "1 hour", "0 seconds"), data)
    want = V.table(spark, data, "events").groupBy(F.col("user_id").alias("asset_id"), F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).count()
    assert {(r.asset_id, r.start): r.n for r in rows.collect()} == {(r.asset_id, r.w.start): r["count"] for r in want.collect()}


def test_state_store_setting_is_left_as_it_was(spark, data):
    from cutledger.catalog import queries

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    assert queries()["r04_pair_stream"](spark, data).count()
    assert spark.conf.get(name) == before


def test_ingest_is_idempotent(spark, data, tmp_path):
    from cutledger.sources.ingest import replace_by_source

    out = f"{tmp_path}/{uuid.uuid4().hex}"
    seen = []

    def apply(df):
        fresh = df.select("asset_id", F.lit("s").alias("source"), "obs_id")
        seen.append(replace_by_source(fresh, fresh).count())
        fresh.write.mode("append").parquet(out)

    feeds.ingest(_stream(spark, data), apply, f"{out}-c").awaitTermination()
    feeds.ingest(_stream(spark, data), apply, f"{out}-c").awaitTermination()
    assert sum(seen) == spark.read.parquet(out).count() == V.table(spark, data, "events").count()
