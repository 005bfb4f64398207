"""The folder that all machines share, for checkpoints and the tables of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, unless a folder is set for them."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on one machine."""
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[context.applicationId]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table in the shared folder, where it is written now: what follows reads it as often as it likes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
