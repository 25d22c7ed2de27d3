"""Readers, validated joins, the streaming limiter and text functions on small cases."""

import gzip

import pytest
from pyspark.sql import functions as F

from rillstone.functions import text as T
from rillstone.operators import relational as R
from rillstone.sources import files
from rillstone.streaming import limits


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"id": "a", "n": 1}\n\n{broken\n{"id": "b", "n": 2}\n')
    path, schema = str(tmp_path / "a.jsonl.gz"), "id string, n long"
    assert sorted(r.id for r in files.jsonl(spark, path, schema, malformed="DROPMALFORMED").collect()) == ["a", "b"]
    assert files.jsonl(spark, path, schema, malformed="PERMISSIVE").where("_corrupt_record is not null").cache().count() == 1
    with pytest.raises(Exception):
        files.jsonl(spark, path, schema).collect()
    (tmp_path / "m.txt").write_text("a=1\nnote\nb = x=y\n")
    assert {r.key: r.value for r in files.manifest(spark, str(tmp_path / "m.txt")).collect()} == {"a": "1", "b": "x=y"}
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "id string, n int")
    with pytest.raises(ValueError):
        files.unique(rows, "id")
    files.write_jsonl(rows, str(tmp_path / "out"), by=("n",))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert files.markdown(rows.orderBy("n"), ["id", "n"]).splitlines()[-1] == "| a | 2 |"


def test_validated_join(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(2, 3)], "k int, y int")
    with pytest.raises(ValueError):
        R.validated_join(a, b, "k")
    assert R.validated_join(a, a.withColumnRenamed("x", "y"), "k").collect()[0].y == 2


def test_answers(spark):
    rows = spark.createDataFrame([("The Cat!", ["a cat"]), ("", [""]), (None, ["x"]), ("big red cat", ["red cat"])], "p string, g array<string>")
    got = rows.select(T.exact_match(F.col("p"), F.col("g")), T.token_f1(F.col("p"), F.col("g")), T.cover_match(F.col("p"), F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(True, 1.0, True), (True, 1.0, False), (False, 0.0, False), (False, 0.8, True)]


def test_limiter(spark, tmp_path):
    rows = [(i, 1, f"2024-01-01 00:00:0{i}") for i in range(4)] + [(9, 1, "2024-01-01 00:01:30")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = limits.limited(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), most=2, seconds=60)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the clock's batches never end
    q = stream.writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [r.allowed for r in spark.sql("select * from limited order by event_id").collect()] == [True, True, False, False, True]
