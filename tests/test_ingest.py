from __future__ import annotations

from cutledger.sources import ingest


def test_discover(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("one.MP4", "a/two.mov", "a/notes.txt", "none"):
        (tmp_path / name).write_bytes(name.encode())
    got = ingest.discover(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == ["one.MP4", "two.mov"]
    assert all(len(r.sha) == 64 and r.size > 0 for r in got)


def test_pending_with_a_limit_gets_through(spark):
    from cutledger.operators.work import pending

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "asset_id long, path string")
    done: list[int] = []
    for _ in range(4):
        got = pending(rows, spark.createDataFrame([(i,) for i in done], "asset_id long"), 2).collect()
        done += [r.asset_id for r in got]
    assert done == list(range(7))


def test_pages_may_be_a_folder_of_files(spark, data, tmp_path):
    from cutledger import catalog

    query = catalog.queries()["r01_incremental_ingest"]
    spark.read.parquet(f"{data}/pages.parquet").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(query(spark, str(tmp_path)).collect()) == sorted(query(spark, data).collect())
