"""Tables that change from one whole version to the next at once.

Versions are folders beside each other; one small file names the current one and is replaced by a single rename.
A reader that has looked at the file reads one version, whatever happens meanwhile; a writer that dies leaves
the old version current and a folder that nobody names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files in a folder, or the file itself; none if there is nothing."""
    _, at, fs = _store(spark, path)
    if not fs.exists(at):
        return []
    return [x.getPath().toString() for x in fs.listStatus(at) if x.isFile() and not x.getPath().getName().startswith(".")]


def read_small(spark: SparkSession, path: str) -> str:
    jvm, at, fs = _store(spark, path)
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _written(spark: SparkSession, path: str, text: str) -> None:
    _, at, fs = _store(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _renamed(spark: SparkSession, source: str, target: str, overwrite: bool) -> None:
    """One atomic rename by the file system's own contract; without `overwrite` it fails if the target is there."""
    jvm, at, _ = _store(spark, source)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if overwrite else jvm.org.apache.hadoop.fs.Options.Rename.NONE
    to = jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(at, to, options)


def make_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all; an error if it already was."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    _written(spark, draft, text)
    _renamed(spark, draft, path, overwrite=False)


def publish_version(rows: DataFrame, path: str, least: int = 1, fail: Callable[[str], None] | None = None) -> str:
    """Writes `rows` as a version of the table at `path` and makes it current, unless it has fewer than `least` rows.

    `fail` is called with "written" and "drafted", for tests of what a death there leaves.
    """
    spark = rows.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    n = spark.read.schema(rows.schema).parquet(f"{path}/{version}").count()
    if n < least:
        raise ValueError(f"{n} rows, but {least} are wanted: the version before stays current")
    if fail:
        fail("written")
    draft = f"{path}/.current-{uuid.uuid4().hex}"
    _written(spark, draft, version)
    if fail:
        fail("drafted")
    _renamed(spark, draft, f"{path}/_current", overwrite=True)
    return version


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at `path`."""
    if not files_of(spark, f"{path}/_current"):
        raise FileNotFoundError(f"no version of {path} is published")
    return spark.read.parquet(f"{path}/{read_small(spark, f'{path}/_current')}")


def swept(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes versions that are neither current nor among the `keep` latest others; how many went."""
    _, at, fs = _store(spark, path)
    current = read_small(spark, f"{path}/_current")
    others = sorted((x.getModificationTime(), x.getPath().toString()) for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith("v-") and x.getPath().getName() != current)
    old = others[: max(0, len(others) - keep)]
    for _, folder in old:
        fs.delete(_store(spark, folder)[1], True)
    return len(old)
