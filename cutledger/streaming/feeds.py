"""Streaming twins of the windowed and stateful operators. Input rows: asset_id, obs_id, ts, reason or facet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling_activity(stream: DataFrame, width: str, late: str) -> DataFrame:
    """asset_id, start, n of each window of ``width``; rows later than ``late`` are dropped."""
    out = stream.withWatermark("ts", late).groupBy("asset_id", F.window("ts", width)).agg(F.count("*").alias("n"))
    return out.select("asset_id", F.col("window.start").alias("start"), "n")


def speech_sessions(stream: DataFrame, gap_ms: int, late: str) -> DataFrame:
    """asset_id, start, finish, n of runs of events less than ``gap_ms`` apart (a session window merges at its gap: one ms less)."""
    out = stream.withWatermark("ts", late).groupBy("asset_id", F.session_window("ts", f"{gap_ms - 1} milliseconds")).agg(F.count("*").alias("n"))
    return out.select("asset_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


class _Pairs(StatefulProcessor):
    """Keeps the last opening of an asset; a closing gives a range from it, the asset's end one only if something is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        found = []
        # an asset's rows of one batch, in order of time; a batch has as many files as the source is told to take
        batch = pd.concat(list(rows)).sort_values(["t", "obs_id"])
        since = self.open.get()[0] if self.open.exists() else None
        for t, reason in batch[["t", "reason"]].itertuples(index=False):
            if reason == "gap_start":
                since = int(t)
            elif reason == "gap_end" or since is not None:
                found.append((key[0], since or 0, int(t)))
                since = None
        if since is None:
            self.open.clear()
        else:
            self.open.update((since,))
        yield pd.DataFrame(found, columns=["asset_id", "s", "e"])

    def close(self) -> None:
        pass


def pair_stream(stream: DataFrame) -> DataFrame:
    """asset_id, s, e (ms since 1970) from openings to closings, or to the asset's end (reason 'end'); needs the RocksDB state store."""
    rows = stream.where("reason in ('gap_start', 'gap_end', 'end')").select("asset_id", "obs_id", F.unix_millis("ts").alias("t"), "reason")
    return rows.groupBy("asset_id").transformWithStateInPandas(statefulProcessor=_Pairs(), outputStructType="asset_id long, s long, e long", outputMode="Append", timeMode="None")


def join_streams(words: DataFrame, windows: DataFrame, late: str, width: str) -> DataFrame:
    """Words (asset_id, ts) with the windows (asset_id, start) of ``width`` that they fall in."""
    a = words.withWatermark("ts", late).alias("a")
    b = windows.withWatermark("start", late).alias("b")
    return a.join(b, F.expr(f"a.asset_id = b.asset_id and a.ts >= b.start and a.ts < b.start + interval {width}")).select("a.asset_id", "a.ts", "b.start")


def first_replies(stream: DataFrame, late: str) -> DataFrame:
    """Each (asset_id, obs_id) once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["asset_id", "obs_id"])


def ingest(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):  # noqa: ANN201
    """Runs ``apply`` on each batch of a file source, with progress kept in ``checkpoint``: a batch that is seen twice must give the same table (``replace_by_source``, ``upsert``)."""
    return stream.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_slices(stream: DataFrame, table: str, checkpoint: str):  # noqa: ANN201
    """Keeps replies (asset_id, source, version, i, ...) of a stream in ``table``, where the newest version of a slice (asset_id, source) stands for it.

    Late versions and replays may come at any time, after any watermark: nothing is kept as state. Each batch is a folder of
    the table, written over if the batch is run again, so a failure between two steps leaves no row twice.
    """
    return stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{table}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_slices(kept: DataFrame) -> DataFrame:
    """The rows of a table of ``replace_slices`` that hold: those of each slice's greatest version, each item i once."""
    newest = kept.groupBy("asset_id", "source").agg(F.max("version").alias("version"))
    return kept.drop("batch").join(newest, ["asset_id", "source", "version"]).dropDuplicates(["asset_id", "source", "version", "i"])
