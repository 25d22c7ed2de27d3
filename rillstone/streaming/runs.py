"""Streams that run to the end of what is there, and a sink that keeps each row once.

A micro-batch is written to a folder of its own and counts from the moment its entry in the commit log exists, which is
one file made at once. A run that dies between the two leaves a folder that nobody reads; the batch is then written again.
A batch that comes again after its entry was made is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillstone.sources.published import files_of, make_once, read_small


def once(path: str, fail: Callable[[int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that adds each batch to the table at `path` exactly once.

    `fail` is called with the batch and "written" or "committed", for tests of what a death there leaves.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        entry = f"{path}/_commits/{batch:020d}"
        if files_of(spark, entry):
            return
        folder = f"part-{batch:020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        if fail:
            fail(batch, "written")
        make_once(spark, entry, folder)
        if fail:
            fail(batch, "committed")

    return write


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the batches whose entries stand in the commit log; of an empty log none."""
    folders = [f"{path}/{read_small(spark, entry)}" for entry in sorted(files_of(spark, f"{path}/_commits"))]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def run_out(stream: DataFrame, path: str, checkpoint: str, fail: Callable[[int, str], None] | None = None) -> None:
    """Runs `stream` over what has come since its checkpoint, into the table at `path`."""
    query = stream.writeStream.foreachBatch(once(path, fail)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def in_slices(rows: DataFrame, slices: list, build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """`build` run as a stream over `rows` that come in `slices` (conditions), restarted from its checkpoint at each."""
    spark = rows.sparkSession
    source = f"{folder}/in"
    schema = None
    for part in slices:
        rows.where(part).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(rows.schema).parquet(source))
        schema = stream.schema
        run_out(stream, f"{folder}/out", f"{folder}/checkpoint")
    return committed(spark, f"{folder}/out", schema)
