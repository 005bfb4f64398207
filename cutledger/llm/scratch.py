"""Tables written to the folder that the cluster shares, to cut lineage.

A lost executor costs nothing that was written here: later stages read the files again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on one machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-scratch-")
    return _OWN[app]


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` and returns it as read back: columns prune, sizes are known to the optimizer."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, when all that was made of them is written too, and lets go of the shuffles behind them.

    Spark deletes the files of a shuffle when the driver's garbage collector finds that nothing refers to it.
    """
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()
