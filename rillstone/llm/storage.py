"""Where the operators keep what later jobs read again.

The shared folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a
local session, as in tests, gets a folder of its own, and a cluster an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillstone-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs start from files, not from lineage."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """`rows` (of a few numbers each), to be broadcast in a join if there are at most `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
