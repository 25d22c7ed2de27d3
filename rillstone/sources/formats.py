"""More readers and writers: sniffed formats, tolerant parts, line numbers, logs, slices, resumable and checked outputs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.sources import files


def _fs(spark: SparkSession, path: str):
    """The path's Hadoop file system and path object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.globStatus(p))


@dataclass(frozen=True)
class Paths:
    """Named paths, looked up when they are used: a missing one fails then, by name."""

    known: dict[str, str]

    def __getattr__(self, name: str) -> str:
        if name in self.known:
            return self.known[name]
        raise KeyError(f"path {name!r} is not set")


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that are there, in order; an error if none is."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of {list(paths)[:5]} exists")
    return found


def json_parts(spark: SparkSession, paths: Sequence[str], schema) -> DataFrame:
    """One JSON array a file, missing files left out."""
    return spark.read.schema(schema).option("multiLine", True).json(existing(spark, paths))


def sniffed(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet by its name, else a JSON array or JSON lines by the first character that is no space."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    first = spark.read.text(path).where("trim(value) <> ''").select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).first()
    return files.json_array(spark, path, schema) if first and first["c"] == "[" else files.jsonl(spark, path, schema)


def corpus(spark: SparkSession, folder: str, columns: Sequence[str] = ("title", "contents")) -> DataFrame:
    """Those columns of a folder's parquet shards, or of its JSON-lines file where it has none."""
    if exists(spark, f"{folder}/*.parquet"):
        return spark.read.parquet(f"{folder}/*.parquet").select(*columns)
    return files.jsonl(spark, f"{folder}/*.jsonl", ", ".join(f"{c} string" for c in columns))


def lines(spark: SparkSession, path: str, *, through: bool = False) -> DataFrame:
    """(file, number, value): text lines with their number from 1 in their file, blank ones left out after counting.

    With `through`, numbers go on from each file to the next in the order of names. Lines are numbered as they are read, in the pieces
    of files that tasks read; where each piece starts comes from one small table, so no task sorts or holds its lines.
    """
    from pyspark.sql import Window

    from rillstone.sources.store import kept, small

    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    t = kept(t, "lines")
    pieces = t.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = (Window.orderBy("file", "block") if through else Window.partitionBy("file").orderBy("block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("start"))
    return t.join(small(starts, each=256), ["file", "block"]).select("file", (F.col("start") + F.col("at")).alias("number"), "value").where("trim(value) <> ''")


def broken_lines(spark: SparkSession, path: str, schema: str, limit: int = 5, *, through: bool = False) -> DataFrame:
    """(number, value) of the first lines that are no JSON record of that schema; numbers as those of :func:`lines`."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines(spark, path, through=through).withColumn("_p", parsed).where("_p._corrupt_record is not null").orderBy("number").limit(limit).select("number", "value")


def log_metrics(spark: SparkSession, path: str, schema: str, pattern: str = r"(\{[^{}]*\})") -> DataFrame:
    """Records in log lines: literals between braces, with single quotes or double ones."""
    found = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("j"))
    return found.select(F.from_json("j", schema, {"allowSingleQuotes": "true"}).alias("r")).where("r is not null").select("r.*")


def row_slice(rows: DataFrame, order: Sequence[str], start: int, n: int) -> DataFrame:
    """n rows from place `start` on in that order, which tells rows apart; places come from ranges, so no task counts or sorts all."""
    from rillstone.operators.scans import scanned

    return scanned(rows, [], order, {"_at": ("count", F.lit(1))}).where(F.col("_at").between(start + 1, start + n)).drop("_at")


def fetched(corpus: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The corpus rows of a set of ids."""
    return corpus.join(ids.select(key).distinct(), key, "left_semi")


def verified_count(rows: DataFrame, least: int, what: str) -> DataFrame:
    """`rows`, or an error if there are fewer than `least`."""
    if (found := rows.limit(least).count()) < least:
        raise ValueError(f"{what}: {found} rows, at least {least} wanted")
    return rows


# Sinks -----------------------------------------------------------------------------------
def append_pending(rows: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends rows whose keys aren't there yet, as JSON lines; how many. What a failed job had not committed is done again."""
    spark = rows.sparkSession
    todo = rows
    if exists(spark, path):
        done = spark.read.schema(rows.schema).option("mode", "DROPMALFORMED").json(path).select(*keys).distinct()
        todo = rows.join(done, list(keys), "left_anti")
    from rillstone.sources.store import kept

    todo = kept(todo, "pending")
    n = todo.count()
    if n:
        todo.write.mode("append").json(path)
    return n


def publish(rows: DataFrame, path: str, least: int = 1) -> None:
    """Written beside `path` and renamed to it if it has `least` rows or more; what stood there goes only then."""
    spark = rows.sparkSession
    beside = f"{path.rstrip('/')}.tmp"
    rows.write.mode("overwrite").parquet(beside)
    found = spark.read.schema(rows.schema).parquet(beside).limit(least).count()
    fs, target = _fs(spark, path)
    _, source = _fs(spark, beside)
    if found < least:
        fs.delete(source, True)
        raise ValueError(f"{found} rows, at least {least} wanted: {path} stays as it was")
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"could not rename {beside}")


def without_broken(spark: SparkSession, path: str, schema: str, to: str) -> None:
    """JSON lines again without those that don't parse."""
    files.write_jsonl(files.jsonl(spark, path, schema, malformed="DROPMALFORMED"), to)


def first_of_each(rows: DataFrame, category: str, order: Sequence[str], n: int, path: str) -> None:
    """The first n rows of each category, one folder a category."""
    from rillstone.operators.relational import top_n

    top_n(rows, [category], [F.col(c) for c in order], n).drop("rank").write.mode("overwrite").partitionBy(category).json(path)


def brief_table(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A CSV table of those columns that are there, line feeds in texts become spaces."""
    names = [c for c in columns if c in rows.columns]
    flat = [F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in names]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def json_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON file of one object a row."""
    rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_chunks(vectors: DataFrame, key: str, chunk: int, path: str) -> int:
    """Vectors by chunks of `chunk` ids, one folder a chunk; chunks that are there with as many rows are left. How many are written.

    What is wanted is a table that meets the vectors in a join, so no list of chunks comes to the driver.
    """
    from rillstone.sources.store import kept

    spark = vectors.sparkSession
    own = vectors.withColumn("chunk", F.floor(F.col(key) / chunk))
    wanted = own.groupBy("chunk").agg(F.count("*").alias("n"))
    if exists(spark, f"{path}/chunk=*"):
        there = spark.read.parquet(path).groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"))
        wanted = wanted.join(there, ["chunk", "n"], "left_anti")
    wanted = kept(wanted.select("chunk"), "chunks")
    n = wanted.count()
    if n:
        own.join(wanted, "chunk", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
    return n


def event_lines(rows: DataFrame, key: str, order: Sequence[str], kind: str, payload: str) -> DataFrame:
    """(key, lines): each key's events in order as server-sent event text."""
    one = F.concat(F.lit("data: "), F.to_json(F.struct(F.col(kind).alias("type"), F.col(payload).alias("value"))), F.lit("\n\n"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, one.alias("_line")))), lambda x: x["_line"]), "").alias("lines"))


def keyed(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """A JSON array whose rows have different keys."""
    return files.unique(files.json_array(spark, path, schema), key)


def note_meta(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(file, title, one column a key) of notes: the first line without its number signs, and '- Key: value' lines; one note a file."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = [F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^- {k}:\s*(.+)$", 1)), F.lit("")).alias(k.lower()) for k in keys]
    return text.select("file", F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "^#+", "")).alias("title"), *found)


def without_comments(tex):
    """A column of TeX without its comments: from a per cent sign that isn't escaped to the line's end; a backslash escapes the character after it."""
    return F.regexp_replace(tex, r"(?m)^((?:[^%\\\n]|\\.)*)%.*$", "$1")


def arguments(tex, command: str):
    """An array with the argument of each `command` in a column of TeX: what is between the first brace after it and the one that closes that.

    Braces are counted, so arguments may hold others; an argument that isn't closed, or isn't there, is null.
    """
    after = F.slice(F.split(tex, re.escape(command)), 2, F.size(F.split(tex, re.escape(command))))
    n = F.size(after)
    tails = F.transform(after, lambda x, i: F.array_join(F.slice(after, i + 1, n), command))

    def argument(tail):
        parts = F.regexp_extract_all(tail, F.lit(r"([{}]|[^{}]+)"), F.lit(1))
        start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("first"), F.lit(0).alias("last"))

        def step(acc, part):
            opens, closes = part == "{", part == "}"
            depth = acc["depth"] + F.when(opens, 1).when(closes & (acc["first"] > 0), -1).otherwise(0)
            first = F.when((acc["first"] == 0) & opens, acc["at"] + 1).otherwise(acc["first"])
            last = F.when((acc["last"] == 0) & closes & (acc["first"] > 0) & (depth == 0), acc["at"]).otherwise(acc["last"])
            return F.struct((acc["at"] + F.length(part)).alias("at"), depth.alias("depth"), first.alias("first"), last.alias("last"))

        found = F.aggregate(parts, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
        return F.when(found["last"] > 0, F.substring(tail, found["first"], found["last"] - found["first"]))

    return F.transform(tails, argument)
