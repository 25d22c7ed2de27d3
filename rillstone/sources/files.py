"""Readers and writers of the record formats: JSON lines in three strictnesses, JSON arrays, tables, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(spark: SparkSession, path, schema, *, malformed: str = "FAILFAST") -> DataFrame:
    """JSON lines (plain or gzip): FAILFAST raises, DROPMALFORMED drops, PERMISSIVE keeps bad lines in _corrupt_record."""
    if malformed == "PERMISSIVE" and "_corrupt_record" not in str(schema):
        schema = f"{schema}, _corrupt_record string" if isinstance(schema, str) else schema.add("_corrupt_record", "string")
    return spark.read.schema(schema).option("mode", malformed).json(path)


def json_array(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def table(spark: SparkSession, path, schema, *, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def manifest(spark: SparkSession, path) -> DataFrame:
    """(key, value) of key=value lines."""
    parts = F.split("value", "=", 2)
    return spark.read.text(path).where(F.contains("value", F.lit("="))).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, or an error that names up to ten missing or repeated keys."""
    if bad := rows.groupBy(key).count().where(f"count > 1 or {key} is null").limit(10).collect():
        raise ValueError(f"missing or repeated {key}: {[r[key] for r in bad]}")
    return rows


def write_jsonl(rows: DataFrame, path: str, *, append: bool = False, by: tuple[str, ...] = ()) -> None:
    writer = rows.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_table(rows: DataFrame, path: str, columns: list[str], *, sep: str = ",") -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def markdown(rows: DataFrame, columns: list[str], limit: int = 100) -> str:
    """A Markdown table of the first rows of a report."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.select(*columns).limit(limit).collect()])
