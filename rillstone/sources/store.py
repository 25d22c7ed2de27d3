"""The folder that all executors share, and tables kept there between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names; a local session without it gets a folder of its own, a cluster an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillstone-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders that this process has kept, by application: results may read them until they are written themselves.
_KEPT: dict[str, list[str]] = {}


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """`rows` written to the shared folder and read from there; :func:`swept` deletes it."""
    path = fresh_path(rows.sparkSession, name)
    _KEPT.setdefault(rows.sparkSession.sparkContext.applicationId, []).append(path)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small(rows: DataFrame, most_bytes: int = 32 << 20, each: int = 64) -> DataFrame:
    """`rows` (of about `each` bytes), to be broadcast in a join if all of them take at most `most_bytes`; else as they are."""
    from pyspark.sql import functions as F

    most = most_bytes // each
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def swept(spark: SparkSession) -> int:
    """Deletes what :func:`kept` has written for this application so far; how many folders. For after a result is written."""
    paths = _KEPT.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)
