"""Queries that write tables in each format to the shared folder, read them back and sum them up."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstone.operators import relational as R
from rillstone.plans.registry import query
from rillstone.sources import files
from rillstone.sources import formats as X
from rillstone.sources import published
from rillstone.sources.store import fresh_path

EVENT = "event_id long, user_id long, event_type string, value double"


def _events(read):
    return read("events").select("event_id", "user_id", "event_type", "value")


def _sums(rows, name):
    return rows.groupBy("event_type").agg(F.lit(name).alias("format"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_FORMATS = ("jsonl", "jsonl_gz", "array", "parquet", "csv", "tsv", "shards")


@query("SELECT f.format, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([" + ", ".join(f"'{f}'" for f in _FORMATS) + "]) AS format) f GROUP BY 1, 2")
def format_round_trips(read):
    e = _events(read)
    spark, at = e.sparkSession, fresh_path(e.sparkSession, "formats")
    files.write_jsonl(e, f"{at}/a.jsonl")
    e.write.option("compression", "gzip").json(f"{at}/b.jsonl")
    # An array a file: one file for each of a few groups of users, so no file holds all rows.
    arrays = e.groupBy((F.col("user_id") % 8).alias("k"), F.floor(F.col("event_id") / 1000).alias("c")).agg(F.to_json(F.collect_list(F.struct(*e.columns))).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(f"{at}/c.json")
    e.write.parquet(f"{at}/d.parquet")
    files.write_table(e, f"{at}/e.csv", e.columns)
    files.write_table(e, f"{at}/f.tsv", e.columns, sep="\t")
    for i in range(2):
        files.write_jsonl(e.where(F.col("event_id") % 2 == i), f"{at}/g/shard_{i}.jsonl")
    found = {
        "jsonl": files.jsonl(spark, f"{at}/a.jsonl", EVENT), "jsonl_gz": X.sniffed(spark, f"{at}/b.jsonl", EVENT), "array": X.json_parts(spark, [f"{at}/c.json", f"{at}/missing.json"], EVENT), "parquet": X.sniffed(spark, f"{at}/d.parquet", EVENT),
        "csv": files.table(spark, f"{at}/e.csv", EVENT), "tsv": files.table(spark, f"{at}/f.tsv", EVENT, sep="\t"), "shards": files.jsonl(spark, f"{at}/g/shard_*.jsonl", EVENT),
    }
    out = None
    for name, rows in found.items():
        one = _sums(rows, name)
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT count(*) FILTER (event_id % 10 > 0) AS n_good, count(*) FILTER (event_id % 10 = 0) AS n_broken, count(*) FILTER (event_id % 10 > 0) AS n_again, (SELECT array_to_string(list(event_id + 1 ORDER BY event_id), ',') FROM (SELECT event_id FROM events WHERE event_id % 10 = 0 ORDER BY event_id LIMIT 5)) AS first_broken FROM events""")
def malformed_lines(read):
    e = _events(read)
    spark, at = e.sparkSession, fresh_path(e.sparkSession, "lines")
    whole = F.to_json(F.struct(*e.columns))
    # Files by ranges of ids, so that line numbers through all of them are ids and 1.
    line = F.when(F.col("event_id") % 10 == 0, F.left(whole, F.lit(9))).otherwise(whole).alias("value")
    e.repartitionByRange(-(-e.count() // 1_000_000) or 1, "event_id").sortWithinPartitions("event_id").select(line).write.text(f"{at}/a.jsonl")
    X.without_broken(spark, f"{at}/a.jsonl", EVENT, f"{at}/b.jsonl")
    good = files.jsonl(spark, f"{at}/a.jsonl", EVENT, malformed="DROPMALFORMED").agg(F.count("event_id").alias("n_good"))
    bad = spark.read.text(f"{at}/a.jsonl").where(F.from_json("value", f"{EVENT}, _corrupt_record string")["_corrupt_record"].isNotNull()).agg(F.count("*").alias("n_broken"))
    again = files.jsonl(spark, f"{at}/b.jsonl", EVENT).agg(F.count("event_id").alias("n_again"))
    first = X.broken_lines(spark, f"{at}/a.jsonl", EVENT, through=True).agg(F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda x: x.cast("string")), ",").alias("first_broken"))
    return good.join(bad).join(again).join(first)


@query("""SELECT (SELECT count(*) FROM events) AS n_first, 0::BIGINT AS n_second, (SELECT count(*) FROM events) AS n_all, (SELECT array_to_string(list(event_id ORDER BY event_id), ',') FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 4 OFFSET 10)) AS slice, (SELECT count(*) FROM events WHERE event_id IN (SELECT DISTINCT user_id FROM events)) AS n_fetched""")
def resumable_output(read):
    e = _events(read)
    spark, at = e.sparkSession, fresh_path(e.sparkSession, "resumed")
    half = X.append_pending(e.where("event_id % 2 = 0"), f"{at}/out.jsonl", ["event_id"])
    rest = X.append_pending(e, f"{at}/out.jsonl", ["event_id"])
    none = X.append_pending(e, f"{at}/out.jsonl", ["event_id"])
    published.publish_version(e.where("event_id < 10"), f"{at}/final")
    published.publish_version(files.jsonl(spark, f"{at}/out.jsonl", EVENT), f"{at}/final")
    rows = published.published(spark, f"{at}/final")
    part = X.row_slice(rows, ["event_id"], 10, 4).agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("slice"))
    got = X.fetched(rows, rows.select(F.col("user_id").alias("event_id")), "event_id").agg(F.count("*").alias("n_fetched"))
    return X.verified_count(rows, 1, "events").agg(F.lit(half + rest).cast("long").alias("n_first"), F.lit(none).cast("long").alias("n_second"), F.count("*").alias("n_all")).join(part).join(got)


@query("""SELECT split, lang, count(*) AS n, count(*) FILTER (r <= 3) AS n_sample FROM (SELECT *, CASE WHEN ('0x' || substr(md5('7:' || doc_id), 1, 8))::UBIGINT / 4294967295.0 < 0.1 THEN 'dev' ELSE 'train' END AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) GROUP BY 1, 2""")
def split_files(read):
    d = read("documents").select("doc_id", "lang", "text")
    spark, at = d.sparkSession, fresh_path(d.sparkSession, "split")
    files.write_jsonl(d.withColumn("split", R.split_of("7", F.col("doc_id"), 0.1)), f"{at}/all", by=("split",))
    X.first_of_each(d, "lang", ["doc_id"], 3, f"{at}/samples")
    rows = spark.read.schema("doc_id long, lang string, text string, split string").json(f"{at}/all")
    sample = spark.read.schema("doc_id long, text string, lang string").json(f"{at}/samples").select("doc_id", F.lit(1).alias("s"))
    return rows.join(sample, "doc_id", "left").groupBy("split", "lang").agg(F.count("*").alias("n"), F.count("s").alias("n_sample"))


@query("""WITH t AS (SELECT event_id, value, user_id FROM events) SELECT count(*) AS n_logged, round(avg(value), 4) AS mean_loss, 3::BIGINT AS n_settings, 'x=y' AS setting FROM t""")
def log_and_manifest(read):
    e = _events(read)
    spark, at = e.sparkSession, fresh_path(e.sparkSession, "logs")
    e.select(F.concat(F.lit("step done {'step': "), F.col("event_id").cast("string"), F.lit(", 'loss': "), F.col("value").cast("string"), F.lit("} ok")).alias("value")).write.text(f"{at}/train.log")
    spark.createDataFrame([("a=1",), ("# note",), ("b = x=y",), ("c=",)], "value string").write.text(f"{at}/run.txt")
    m = files.manifest(spark, f"{at}/run.txt")
    logged = X.log_metrics(spark, f"{at}/train.log", "step long, loss double").agg(F.count("*").alias("n_logged"), F.round(F.avg("loss"), 4).alias("mean_loss"))
    return logged.join(m.agg(F.count("*").alias("n_settings"), F.max(F.when(F.col("key") == "b", F.col("value"))).alias("setting")))


@query("""SELECT (SELECT count(DISTINCT vec_id // 100) FROM embeddings) AS n_written, 0::BIGINT AS n_again, 1::BIGINT AS n_mended, (SELECT count(*) FROM embeddings) AS n_vectors, (SELECT round(sum(embedding[1]::DOUBLE), 4) FROM embeddings) AS first_sum""")
def embedding_chunks(read):
    v = read("embeddings").select("vec_id", "embedding")
    spark, path = v.sparkSession, fresh_path(v.sparkSession, "chunks")
    less = X.write_chunks(v.where("vec_id <> 5"), "vec_id", 100, path)
    mended = X.write_chunks(v, "vec_id", 100, path)  # the chunk that lacked a row is written again, and no other
    again = X.write_chunks(v, "vec_id", 100, path)
    rows = spark.read.parquet(path)
    return rows.agg(F.lit(less).cast("long").alias("n_written"), F.lit(again).cast("long").alias("n_again"), F.lit(mended).cast("long").alias("n_mended"), F.count("*").alias("n_vectors"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("first_sum"))


@query("""SELECT conv_id, md5(string_agg('data: {"type":"' || role || '","value":' || turn || '}' || chr(10) || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def event_stream_lines(read):
    e = X.event_lines(read("conversations"), "conv_id", ["turn"], "role", "turn")
    return e.select("conv_id", F.md5(F.col("lines").cast("binary")).alias("digest"))


@query("""SELECT count(*) AS n, max(n_chars)::BIGINT AS longest, count(*) FILTER (doc_id % 2 = 0) AS n_even FROM documents""")
def reported(read):
    d = read("documents")
    spark, at = d.sparkSession, fresh_path(d.sparkSession, "report")
    X.json_report(d.agg(F.count("*").alias("n"), F.max("n_chars").cast("long").alias("longest")), f"{at}/meta.json")
    d.select(F.col("doc_id").cast("string").alias("title"), F.lit("x").alias("contents")).where("doc_id % 2 = 0").write.parquet(f"{at}/corpus/part.parquet")
    meta = spark.read.schema("n long, longest long").json(f"{at}/meta.json")
    n_even = spark.read.parquet(f"{at}/corpus/part.parquet").select("title").agg(F.count("*").alias("n_even"))
    return meta.join(n_even)
